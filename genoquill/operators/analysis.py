"""Operators of the variant analyses: trimming, clinical records, genes, tiles, offsets, loci of populations, checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import variants as V
from ..storage import stored
from . import aggregates as A
from . import ordered as O

GENOTYPE = ("contig_id", "pos", "ref", "alt")


def trim(grid: DataFrame, variants: DataFrame) -> DataFrame:
    """The rows of grid (genome_id, contig_id) that have variants."""
    return grid.join(variants.select("genome_id", "contig_id"), ["genome_id", "contig_id"], "left_semi")


def trim_counts(grid: DataFrame, variants: DataFrame) -> DataFrame:
    """One row: the contigs, and the genomes without any contig left, that trim takes away."""
    g = grid.select("genome_id", "contig_id").distinct()
    has = variants.select("genome_id", "contig_id").distinct().withColumn("_has", F.lit(1))
    t = g.join(has, ["genome_id", "contig_id"], "left").groupBy("genome_id").agg(F.count("*").alias("_all"), F.count("_has").alias("_left"))
    return t.agg(F.sum(F.col("_all") - F.col("_left")).alias("contigs_removed"), F.count_if(F.col("_left") == 0).alias("genomes_removed"))


def clinvar_join(variants: DataFrame, records: DataFrame) -> DataFrame:
    """(genome_id, gene, clndn, contig_id, pos, ref, alt, n): the clinical records that a genome's variants match, with how often it has them."""
    own = variants.groupBy("genome_id", *GENOTYPE).agg(F.count("*").alias("n"))
    return own.join(records.select(*GENOTYPE, "gene", "clndn"), list(GENOTYPE)).select("genome_id", "gene", "clndn", *GENOTYPE, "n")


def clinvar_summary(variants: DataFrame, records: DataFrame, compat: bool = True) -> DataFrame:
    """Per gene: phenotypes (distinct, sorted), genomes with a record, and genomes that are homozygous for one.

    With compat a genome counts as homozygous if two of the records that it matches stand at one place with one change, as the
    test looks at the records; without, if the genome itself has a matched variant twice.
    """
    t = clinvar_join(variants, records)
    twice = F.count("*") > 1 if compat else F.max("n") > 1
    per = t.groupBy("gene", "genome_id", *GENOTYPE).agg(twice.alias("twice")).groupBy("gene", "genome_id").agg(F.max("twice").alias("twice"))
    genomes = per.groupBy("gene").agg(F.count("*").alias("genomes"), F.count_if("twice").alias("homozygous_genomes"))
    names = records.join(variants.select(*GENOTYPE).distinct(), list(GENOTYPE), "left_semi").where("clndn IS NOT NULL").groupBy("gene").agg(F.sort_array(F.collect_set("clndn")).alias("phenotypes"))
    return genomes.join(names, "gene", "left")


def pedigree_join(rows: DataFrame, genealogy: DataFrame, individual: str = "genome_id") -> DataFrame:
    """rows with family, father, mother, sex and population of genealogy (individual, ...); individuals without a pedigree keep nulls."""
    g = genealogy.select(F.col("individual").alias("_i"), *[c for c in genealogy.columns if c != "individual" and c not in rows.columns])
    return rows.join(g, rows[individual] == g["_i"], "left").drop("_i")


def genes_of_alleles(variants: DataFrame, genes: Sequence[str] | None = None, gene: str = "gene", prefix: str = "ENSG") -> DataFrame:
    """(identifier, genes): the Ensembl genes, sorted, that each named allele is in; only those of genes if given."""
    t = variants.where((F.col("identifier") != "") & F.col(gene).startswith(prefix))
    if genes is not None:
        t = t.where(F.col(gene).isin(list(genes)))
    return t.groupBy("identifier").agg(F.sort_array(F.collect_set(gene)).alias("genes"))


def gene_characteristics(genes: DataFrame, transcripts: DataFrame) -> DataFrame:
    """genes (contig_id, gene_id, lower, upper, strand, ...) with span, number of transcripts, and of the first by name its nucleotides and exons."""
    size = F.aggregate("exons", F.lit(0).cast("long"), lambda a, x: a + x["upper"] - x["lower"])
    t = transcripts.select("contig_id", "gene_id", F.struct("transcript", size.alias("nucleotides"), F.size("exons").alias("exons")).alias("t"))
    t = t.groupBy("contig_id", "gene_id").agg(F.count("*").alias("sequences"), F.min("t").alias("t"))
    out = genes.join(t, ["contig_id", "gene_id"], "left").withColumn("span", F.col("upper") - F.col("lower"))
    return out.select(*genes.columns, "span", F.coalesce("sequences", F.lit(0)).alias("sequences"), F.col("t.transcript").alias("sequence_name"), F.coalesce("t.nucleotides", F.lit(0)).alias("nucleotides"), F.coalesce("t.exons", F.lit(0)).alias("exons"))


def tile_info(variants: DataFrame, size: int, fields: Mapping[str, Column], percentile: float, at_least: float, impacts: Sequence[str] = ("HIGH", "MODERATE")) -> DataFrame:
    """Per contig and tile: variants of the impacts, per field the value at a percentile, and variants of an af at or above at_least.

    Fields are taken of variants with a frequency; a tile without any has 0. The count of at_least is 1 at the smallest, as in geq_count.
    """
    by = ["contig_id", "tile"]
    values = {f"_{i}": v for i, v in enumerate(fields.values())}
    t = variants.select("contig_id", F.floor(F.col("pos") / size).alias("tile"), F.coalesce(F.col("impact").isin(list(impacts)), F.lit(False)).alias("_hit"), "af", *[v.alias(c) for c, v in values.items()])
    t = stored(t.groupBy(*by, "_hit", "af", *values).agg(F.count("*").alias("_w")), "tiles")  # the variants are read once
    known = t.where("af IS NOT NULL")
    some = lambda test: F.coalesce(F.sum(F.when(test, F.col("_w"))), F.lit(0))
    base = t.groupBy(*by).agg(F.sum("_w").alias("variants"), some(F.col("_hit")).alias("consequence"))
    out = base.join(known.groupBy(*by).agg(F.greatest(some(F.col("af") >= at_least), F.lit(1)).alias("at_least")), by, "left")
    for name, c in zip(fields, values, strict=True):
        p = O.percentiles(known, c, [percentile], by, "_w")
        out = out.join(p.select(*by, F.col("value").alias(name)), by, "left")
    return out.fillna(0)


def disease_alleles(citations: DataFrame, disease: DataFrame, gene_alleles: DataFrame) -> DataFrame:
    """(rsid, genes, pmids, disease_pmids): cited alleles with their genes, all their publications and how many are of the disease."""
    c = citations.select("rsid", "pmid").distinct()
    of = disease.select("pmid").distinct().withColumn("_d", F.lit(1))
    n = c.join(of, "pmid", "left").groupBy("rsid").agg(F.count("*").alias("pmids"), F.count("_d").alias("disease_pmids"))
    return n.where("disease_pmids > 0").join(gene_alleles.withColumnRenamed("identifier", "rsid"), "rsid", "left")


def genome_profiles(mutated: DataFrame) -> DataFrame:
    """(genome_id, transcripts, profile): an order-free digest of a genome's sequences; equal profiles mean equal sequences.

    mutated: genome_id, transcript, coding. Sums over hashes need no list of a genome's sequences.
    """
    tag = [F.xxhash64("transcript", F.coalesce("coding", F.lit("")), F.lit(k)) for k in (1, 2)]
    digest = F.concat_ws("-", *[F.hex(F.bit_xor(h)) for h in tag], F.hex(F.sum(F.pmod(tag[0], F.lit(1 << 31))).cast("long")))
    return mutated.groupBy("genome_id").agg(F.count("*").alias("transcripts"), digest.alias("profile"))


def population_loci(variants: DataFrame, fields: Mapping[str, str], spacing: int, lowest: float = 0.0, highest: float = 1.0, most: int | None = None) -> DataFrame:
    """(population, contig_id, pos, af): for each population spaced loci by the frequency in its own column of variants."""
    long = [variants.select(F.lit(p).alias("population"), "contig_id", "pos", F.col(c).alias("af")) for p, c in fields.items()]
    t = long[0]
    for more in long[1:]:
        t = t.union(more)
    return O.spaced_loci(t.where("af IS NOT NULL"), spacing, lowest, highest, most, keys=("population", "contig_id"))


def matrix_add(a: DataFrame, b: DataFrame) -> DataFrame:
    """Element-wise sum of two matrices (i, j, d) of the same entries; ValueError if one has an entry that the other lacks."""
    both = a.join(b.select("i", "j", F.col("d").alias("_d")), ["i", "j"], "full")
    if not both.where(F.col("d").isNull() | F.col("_d").isNull()).isEmpty():
        raise ValueError("the matrices have different entries")
    return both.select("i", "j", (F.col("d") + F.col("_d")).alias("d"))


def indel_shifts(variants: DataFrame, keys: Sequence[str] = ("genome_id", "contig_id"), order: Sequence[str] = ("pos", "vcf_line")) -> DataFrame:
    """(keys, at, change, cumulative, deleted, base): the indels of a sequence by place, the first by order at each.

    cumulative: the summed length change up to and with the indel; deleted: letters that it takes away; base: its own place in the
    modified sequence.
    """
    m = variants.withColumn("_m", V.modify_interval()).where(~V.is_snp() & (F.length("ref") != F.length("alt")))
    w = W.partitionBy(*keys, "at").orderBy(*order)
    m = m.withColumn("at", F.col("_m.lower").cast("long")).withColumn("_k", F.row_number().over(w)).where("_k = 1")
    change = (F.length("alt") - F.length("ref")).cast("long")
    t = m.select(*keys, "at", change.alias("change"))
    t = t.withColumn("cumulative", F.sum("change").over(W.partitionBy(*keys).orderBy("at").rowsBetween(W.unboundedPreceding, 0)))
    return t.select("*", F.greatest(-F.col("change"), F.lit(0)).alias("deleted"), (F.col("at") + F.col("cumulative") - F.col("change")).alias("base"))


def _latest(loci: DataFrame, shifts: DataFrame, keys: Sequence[str], place: str, by: str) -> DataFrame:
    """loci with the last of shifts whose column by is below place: an as-of join by one window."""
    tail = ["at", "cumulative", "deleted", "base"]
    row = F.struct(*loci.columns)
    events = loci.select(*keys, F.col(place).cast("long").alias("_p"), F.lit(0).alias("_kind"), row.alias("_row"), F.lit(None).cast("struct<at:bigint,cumulative:bigint,deleted:bigint,base:bigint>").alias("_s"))
    marks = shifts.select(*keys, F.col(by).alias("_p"), F.lit(1).alias("_kind"), F.lit(None).cast(events.schema["_row"].dataType).alias("_row"), F.struct(*[F.col(c).cast("long").alias(c) for c in tail]).alias("_s"))
    before = W.partitionBy(*keys).orderBy("_p", "_kind").rowsBetween(W.unboundedPreceding, -1)
    t = events.union(marks).withColumn("_last", F.last("_s", ignorenulls=True).over(before))
    return t.where("_row IS NOT NULL").select("_row.*", "_last")


def to_modified(loci: DataFrame, shifts: DataFrame, lower: Column | int = 0, keys: Sequence[str] = ("genome_id", "contig_id"), pos: str = "pos") -> DataFrame:
    """loci with modified: the place from 0 in the sequence that begins at lower, after the indels strictly before it.

    A place inside a deletion gets the place where the deletion is; null where the sequence would begin behind it.
    """
    start = lower if isinstance(lower, Column) else F.lit(lower)
    t = _latest(loci, shifts, keys, pos, "at")
    inside = F.col("_last").isNotNull() & (F.col(pos) < F.col("_last.at") + F.col("_last.deleted"))
    at = F.when(inside, F.col("_last.base")).otherwise(F.col(pos) + F.coalesce("_last.cumulative", F.lit(0))) - start
    return t.select(*loci.columns, F.when(at >= 0, at).alias("modified"))


def to_original(loci: DataFrame, shifts: DataFrame, lower: Column | int = 0, keys: Sequence[str] = ("genome_id", "contig_id"), modified: str = "modified") -> DataFrame:
    """loci with original: the contig's place of a place from 0 in the modified sequence; of inserted letters the place of the insert."""
    start = lower if isinstance(lower, Column) else F.lit(lower)
    own = shifts.withColumn("base", F.col("base") - start).withColumn("_behind", F.col("base") - 1)
    t = _latest(loci, own, keys, modified, "_behind")
    s = F.col("_last")
    grown = F.when(s.isNotNull() & (s["cumulative"] > s["base"] + start - s["at"]), s["cumulative"] - (s["base"] + start - s["at"])).otherwise(0)
    inserted = s.isNotNull() & (F.col(modified) < s["base"] + grown)
    back = F.col(modified) + start - F.coalesce(s["cumulative"], F.lit(0))
    return t.select(*loci.columns, F.when(inserted, s["at"]).otherwise(back).alias("original"))


def target_genes(annotations: DataFrame, targets: DataFrame, ic: DataFrame, cut_off: float = 0.0) -> DataFrame:
    """(gene, terms, informative): terms of each target gene, and those whose information content reaches the cut-off; 0 for unknown genes."""
    a = annotations.select("gene", "term").distinct().join(ic, "term", "left")
    n = a.groupBy("gene").agg(F.count("*").alias("terms"), F.count_if(F.col("ic") >= cut_off).alias("informative"))
    return targets.select("gene").distinct().join(n, "gene", "left").fillna(0, ["terms", "informative"])


def ontology_check(edges: DataFrame, closure: DataFrame, ic: DataFrame) -> DataFrame:
    """One row: terms, edges, roots, largest information content, and edges whose child has less of it than its parent."""
    from . import ontology as G

    child = ic.select(F.col("term").alias("child"), F.col("ic").alias("_c"))
    parent = ic.select(F.col("term").alias("parent"), F.col("ic").alias("_p"))
    e = edges.select("child", "parent").distinct()
    falling = e.join(child, "child").join(parent, "parent").agg(F.count_if(F.col("_c") < F.col("_p") - 1e-12).alias("falling"))
    return closure.agg(F.countDistinct("term").alias("terms")).crossJoin(e.agg(F.count("*").alias("edges"))).crossJoin(G.roots(e).agg(F.count("*").alias("roots"))).crossJoin(ic.agg(F.max("ic").alias("largest"))).crossJoin(falling)  # one row each


def same_parameters(results: Sequence[Mapping[str, object]], names: Sequence[str]) -> Mapping[str, object]:
    """The parameters that all results share; ValueError with the names in which they differ."""
    odd = [n for n in names if len({r.get(n) for r in results}) > 1]
    if odd:
        raise ValueError(f"results differ in {', '.join(odd)}")
    return {n: results[0].get(n) for n in names} if results else {}


def accumulate(df: DataFrame, by: Sequence[str], function, kind: str, *columns: str) -> DataFrame:
    """(by, result): a caller's function of the columns of a group, as a grouped aggregate over Arrow batches."""
    return df.groupBy(*by).agg(F.pandas_udf(function, kind, F.PandasUDFType.GROUPED_AGG)(*columns).alias("result"))


def gene_report(characteristics: DataFrame, variants: DataFrame, samples: DataFrame, populations: Sequence[str], records: DataFrame) -> DataFrame:
    """One row per gene: its characteristics, its variants' effects, carriers by population and sex, and clinical records."""
    effects = A.gene_effects(variants)
    per_gene = variants.groupBy("gene").agg(F.countDistinct(*GENOTYPE).alias("unique_variants"), F.count("*").alias("variants"))
    ethnic = A.ethnicity(variants, samples, list(populations), ["gene"]).drop("total")
    clinical = clinvar_summary(variants, records).select("gene", F.col("genomes").alias("clinvar_genomes"), F.col("homozygous_genomes").alias("clinvar_homozygous"), F.array_join("phenotypes", "&").alias("phenotypes"))
    out = characteristics.withColumnRenamed("gene_id", "gene")
    for part in (per_gene, effects, ethnic, clinical):
        out = out.join(part, "gene", "left")
    return out.fillna(0).fillna("", ["phenotypes"])
