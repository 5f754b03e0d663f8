"""Joins: intervals by bins, templates, radii, nomenclature, citations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import stored


def interval_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_bounds: tuple[str, str], right_bounds: tuple[str, str], bin_size: int = 64, contained: bool = False) -> DataFrame:
    """Rows of left and right with equal `on` whose open-right intervals intersect (or left lies in right).

    Both sides are spread over the bins that they touch and joined on (on, bin); a pair is kept in the bin in which its
    intersection begins, so it comes out once. The shuffle keys hold the bin, so a contig doesn't become one task.
    """
    (ll, lu), (rl, ru) = left_bounds, right_bounds
    bins = lambda lo, up: F.explode(F.sequence(F.floor(F.col(lo) / bin_size), F.floor((F.greatest(F.col(up), F.col(lo) + 1) - 1) / bin_size)))
    a = left.withColumn("_bin", bins(ll, lu))
    b = right.withColumn("_bin", bins(rl, ru))
    b = b.select(*[F.col(c).alias(c if c in on or c == "_bin" else f"r_{c}") for c in b.columns])
    t = a.join(b, [*on, "_bin"])
    rl, ru = f"r_{rl}", f"r_{ru}"
    test = (F.col(ll) >= F.col(rl)) & (F.col(lu) <= F.col(ru)) if contained else (F.col(ll) < F.col(ru)) & (F.col(rl) < F.col(lu))
    return t.where(test & (F.col("_bin") == F.floor(F.greatest(F.col(ll), F.col(rl)) / bin_size))).drop("_bin")


def gene_variants(variants: DataFrame, genes: DataFrame, bin_size: int = 64) -> DataFrame:
    """Variants that modify a gene's span: deletes that intersect it, others whose member interval it contains."""
    from ..functions import variants as V

    t = variants.withColumn("_m", V.member_interval()).select("*", F.col("_m.kind").alias("kind"), F.col("_m.lower").alias("lo"), F.col("_m.upper").alias("up")).drop("_m").where("up > lo")
    t = interval_join(t, genes, ["contig_id"], ("lo", "up"), ("lower", "upper"), bin_size)
    return t.where("kind = 'DELETE' OR (lo >= r_lower AND up <= r_upper)").drop("kind", "lo", "up")


def gene_carriers(variants: DataFrame, genes: DataFrame, bin_size: int = 64) -> DataFrame:
    """(gene_id, n, genomes, homozygous_genomes) over gene_variants: variants, genomes that carry one, and those that carry one twice or more.

    Variants are first collapsed to intervals with the genomes that have them as bits of 64-bit words, so that the join meets
    distinct intervals and not the variants of every genome; a gene's genomes are the union of the bits.
    """
    from ..functions import variants as V

    t = variants.withColumn("_m", V.member_interval()).select("contig_id", "genome_id", "ref", "alt", "pos", F.col("_m.kind").alias("kind"), F.col("_m.lower").alias("lo"), F.col("_m.upper").alias("up")).where("up > lo")
    per = t.groupBy("contig_id", "kind", "lo", "up", "genome_id", "pos", "ref", "alt").agg(F.count("*").alias("n"))
    per = stored(per.groupBy("contig_id", "kind", "lo", "up", "genome_id").agg(F.sum("n").alias("n"), F.max("n").alias("most")), "per-genome")
    number = per.select("genome_id").distinct().select("genome_id", (F.row_number().over(W.orderBy("genome_id")) - 1).alias("_k"))  # one row a genome
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("_k") % 64).cast("int"))
    masks = per.join(number, "genome_id").groupBy("contig_id", "kind", "lo", "up", F.floor(F.col("_k") / 64).alias("word")).agg(F.sum("n").alias("n"), F.bit_or(bit).alias("some"), F.bit_or(F.when(F.col("most") > 1, bit).otherwise(F.lit(0).cast("long"))).alias("twice"))
    met = interval_join(masks, genes.select("contig_id", "gene_id", "lower", "upper"), ["contig_id"], ("lo", "up"), ("lower", "upper"), bin_size)
    met = met.where("kind = 'DELETE' OR (lo >= r_lower AND up <= r_upper)")
    words = met.groupBy(F.col("r_gene_id").alias("gene_id"), "word").agg(F.sum("n").alias("n"), F.bit_or("some").alias("some"), F.bit_or("twice").alias("twice"))
    size = lambda c: F.sum(F.bit_count(c)).cast("long")
    return words.groupBy("gene_id").agg(F.sum("n").alias("n"), size("some").alias("genomes"), size("twice").alias("homozygous_genomes"))


def exon_variants(variants: DataFrame, exons: DataFrame, distinct: bool = False, bin_size: int = 64) -> DataFrame:
    """gene_variants over exons (gene_id, contig_id, lower, upper); shared exons count again unless distinct."""
    t = gene_variants(variants, exons, bin_size)
    return t.dropDuplicates([c for c in t.columns if c not in ("r_lower", "r_upper")]) if distinct else t


def template_semi_join(df: DataFrame, wanted: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(wanted.select(*on), list(on), "left_semi")


def windows(contigs: DataFrame, size: int = 1 << 16) -> DataFrame:
    """(contig_id, window, text): the sequences of contigs (contig_id, sequence) in pieces of size letters, window counting them from 0."""
    text = F.regexp_extract_all(F.col("sequence"), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return contigs.select("contig_id", F.posexplode(text).alias("window", "text"))


def reference_at(rows: DataFrame, contigs: DataFrame, start: str = "pos", length: Column | str = "1", size: int = 1 << 16) -> DataFrame:
    """rows with _reference: the length letters of the contig from start on, fewer at its end; null on an unknown contig.

    A place meets only the windows of the reference that it touches, by equi-join on (contig, window), never a whole contig; rows
    at one place with one length share its text, which is looked up once.
    """
    n = length if isinstance(length, Column) else F.expr(length)
    t = stored(rows.withColumn("_n", n.cast("long")), "rows")
    spots = t.select("contig_id", F.col(start).alias("_lo"), "_n").where((F.col("_lo") >= 0) & (F.col("_n") > 0)).distinct()
    lo, up = F.col("_lo"), F.col("_lo") + F.col("_n")
    touched = spots.select("*", F.explode(F.sequence(F.floor(lo / size), F.floor((up - 1) / size))).alias("window"))
    at = F.greatest(lo - F.col("window") * size, F.lit(0))
    part = F.substring(F.col("text"), (at + 1).cast("int"), (up - F.col("window") * size - at).cast("int"))
    found = touched.join(windows(contigs, size), ["contig_id", "window"]).groupBy("contig_id", F.col("_lo").alias(start), "_n").agg(F.array_sort(F.collect_list(F.struct("window", part.alias("p")))).alias("_parts"))
    found = stored(found, "texts")
    known = contigs.select("contig_id").distinct().withColumn("_known", F.lit(True))
    out = t.join(found, ["contig_id", start, "_n"], "left").join(known, "contig_id", "left")
    text = F.coalesce(F.array_join(F.transform("_parts", lambda x: x["p"]), ""), F.lit(""))
    return out.withColumn("_reference", F.when(F.col("_known"), text)).select(*rows.columns, "_reference")


def reference_check(variants: DataFrame, contigs: DataFrame, size: int = 1 << 16) -> DataFrame:
    """Per contig the variants and those whose reference text stands in the contig's sequence (contigs: contig_id, sequence)."""
    t = reference_at(variants.select("contig_id", "pos", "ref"), contigs, "pos", F.length("ref"), size)
    return t.groupBy("contig_id").agg(F.count("*").alias("total"), F.count_if(F.col("_reference") == F.col("ref")).alias("valid"))


def alias_join(df: DataFrame, aliases: DataFrame, column: str = "contig_id") -> DataFrame:
    """column replaced by its reference name where aliases (alias, name) has one."""
    a = aliases.select(F.col("alias").alias("_alias"), F.col("name").alias("_name"))
    return df.join(a, df[column] == a["_alias"], "left").withColumn(column, F.coalesce("_name", column)).drop("_alias", "_name")


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371.0) -> Column:
    """Kilometres between two places given in degrees, by the arc cosine."""
    a, b = F.radians(lat1), F.radians(lat2)
    cos = F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(F.radians(lon1) - F.radians(lon2))
    return F.acos(F.greatest(F.least(cos, F.lit(1.0)), F.lit(-1.0))) * radius


def radius_join(places: DataFrame, radius: float, name: str = "city", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Pairs of distinct places (name, lat, lon) at up to radius km, each with itself at 0; equal names are at 0.

    Places are binned by latitude, so that a place meets those of its own and the two neighbouring bands only.
    """
    p = places.select(name, lat, lon).dropDuplicates([name])
    band = max(radius / 111.0, 1e-3)
    a = p.withColumn("_band", F.floor(F.col(lat) / band))
    b = p.select(F.col(name).alias("other"), F.col(lat).alias("_lat"), F.col(lon).alias("_lon"), F.explode(F.array(*[F.floor(F.col(lat) / band) + k for k in (-1, 0, 1)])).alias("_band"))
    d = F.when(F.col(name) == F.col("other"), 0.0).otherwise(great_circle(F.col(lat), F.col(lon), F.col("_lat"), F.col("_lon")))
    return a.join(b, "_band").select(name, "other", d.alias("km")).where(F.col("km") <= radius)


def proximity(genes: DataFrame, distance: int, start: str = "lower") -> DataFrame:
    """Pairs of genes of a contig whose starts are at most distance apart; joined on bins of that width. At distance 0 all pairs of a contig."""
    if distance == 0:
        a = genes.select("contig_id", "gene_id", F.col(start).alias("at"))
        b = genes.select("contig_id", F.col("gene_id").alias("near_id"), F.col(start).alias("near_at"))
        return a.join(b, "contig_id").where(F.col("gene_id") != F.col("near_id"))
    width = max(distance, 1)
    a = genes.select("contig_id", "gene_id", F.col(start).alias("at"), F.floor(F.col(start) / width).alias("_bin"))
    b = genes.select("contig_id", F.col("gene_id").alias("near_id"), F.col(start).alias("near_at"), F.explode(F.array(*[F.floor(F.col(start) / width) + k for k in (-1, 0, 1)])).alias("_bin"))
    return a.join(b, ["contig_id", "_bin"]).where((F.col("gene_id") != F.col("near_id")) & (F.abs(F.col("at") - F.col("near_at")) <= distance)).drop("_bin")


def proximity_totals(genes: DataFrame, distance: int, start: str = "lower") -> DataFrame:
    """One row (n, apart): number of the pairs of proximity, for a distance of 1 at least, and the sum of their distances.

    Genes are counted by place and the places are joined, so that no pair of genes is a row; of those counts the pairs that share
    a name are taken off again.
    """
    g = genes.where(F.col("gene_id").isNotNull()).groupBy("contig_id", "gene_id", F.col(start).alias("at")).agg(F.count("*").alias("k"))
    g = stored(g.withColumn("_bin", F.floor(F.col("at") / distance)), "places")

    def totals(t: DataFrame, on: Sequence[str]) -> DataFrame:
        near = t.select(*on, F.col("at").alias("near_at"), F.col("k").alias("m"), F.explode(F.array(*[F.col("_bin") + i for i in (-1, 0, 1)])).alias("_bin"))
        both = t.join(near, [*on, "_bin"]).withColumn("_d", F.abs(F.col("at") - F.col("near_at"))).where(F.col("_d") <= distance)
        return both.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(n) for n, x in (("n", F.col("k") * F.col("m")), ("apart", F.col("k") * F.col("m") * F.col("_d")))])

    places = totals(g.groupBy("contig_id", "at", "_bin").agg(F.sum("k").alias("k")), ["contig_id"])
    same = totals(g, ["contig_id", "gene_id"]).withColumnsRenamed({"n": "_n", "apart": "_apart"})
    left = lambda c: (F.col(c) - F.col(f"_{c}")).cast("long")
    return places.crossJoin(same).select(left("n").alias("n"), F.when(left("n") > 0, left("apart")).alias("apart"))  # one row each


def citation_join(variants: DataFrame, citations: DataFrame) -> DataFrame:
    """Distinct identifiers of variants with the sorted pmids that cite them (citations: rsid, pmid); empty if none."""
    ids = variants.where("identifier <> ''").select("identifier").distinct()
    per = citations.groupBy(F.col("rsid").alias("identifier")).agg(F.sort_array(F.collect_set("pmid")).alias("pmids"))
    return ids.join(per, "identifier", "left").withColumn("pmids", F.coalesce("pmids", F.expr("CAST(array() AS array<bigint>)")))


def cited_by(publications: DataFrame, citations: DataFrame) -> DataFrame:
    """(pmid, cited_by) with both publications in the corpus."""
    known = publications.select("pmid")
    return citations.join(known, "pmid", "left_semi").join(known.withColumnRenamed("pmid", "cited_by"), "cited_by", "left_semi").select("pmid", "cited_by")


def or_and(rows: DataFrame, any_terms: Sequence[str], also_terms: Sequence[str], key: str = "pmid", term: str = "mesh") -> DataFrame:
    """Keys with a term of any_terms and a term of also_terms; an empty second list asks for nothing."""
    out = rows.where(F.col(term).isin(list(any_terms))).select(key).distinct()
    return out.join(rows.where(F.col(term).isin(list(also_terms))).select(key), key, "left_semi") if also_terms else out


def nomenclature(genes: DataFrame, *tables: tuple[DataFrame, str]) -> DataFrame:
    """genes left-joined to one table of identifiers after the other, each on its named column."""
    for t, on in tables:
        genes = genes.join(t, on, "left")
    return genes


def locus_join(loci: DataFrame, variants: DataFrame) -> DataFrame:
    """loci (contig_id, pos, ...) with the SNPs that each genome has there; loci without keep nulls."""
    return loci.join(variants, ["contig_id", "pos"], "left")


def pairs(df: DataFrame, key: str, include_self: bool = True) -> DataFrame:
    """(a, b) for all a <= b of a bounded set of keys, for matrices that a caller asks for in full."""
    k = df.select(key).distinct()
    a, b = k.select(F.col(key).alias("a")), k.select(F.col(key).alias("b"))
    return a.join(b, F.col("a") <= F.col("b") if include_self else F.col("a") < F.col("b"))
