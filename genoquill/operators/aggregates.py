"""Aggregations over variants: counts, genotype summaries, diversity, tiles, histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import variants as V
from .filters import with_hgvs

#: Lower and upper bounds of the allele frequency bins; fixed values.
AF_BINS = ((0.0, 0.001), (0.001, 0.002), (0.002, 0.005), (0.005, 0.01), (0.01, 0.02), (0.02, 0.05), (0.05, 0.1), (0.1, 0.2), (0.2, 0.3), (0.3, 0.5), (0.5, 1.0))


def counts(df: DataFrame, *by: str) -> DataFrame:
    """Rows, distinct variants and SNPs, in all or by the columns given."""
    return with_hgvs(df).groupBy(*by).agg(F.count("*").alias("n"), F.countDistinct("hgvs").alias("distinct_variants"), F.count_if(V.is_snp()).alias("snps"))


def unique_variants(df: DataFrame, order: Sequence[str] = ("vcf_line", "part", "supp")) -> DataFrame:
    """Per variant its first row by order, over all genomes."""
    t = with_hgvs(df)
    rest = [c for c in t.columns if c != "hgvs"]
    return t.groupBy("hgvs").agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_r")).select("hgvs", *[F.col(f"_r.{c}") for c in rest])


def compress(df: DataFrame, name: str = "Compressed", column: str = "genome_id") -> DataFrame:
    """All rows as those of one genome."""
    return df.withColumn(column, F.lit(name))


def square(df: DataFrame) -> DataFrame:
    """Every genome with every contig and the number of its rows there, 0 included."""
    g, c = df.select("genome_id").distinct(), df.select("contig_id").distinct()
    n = df.groupBy("genome_id", "contig_id").agg(F.count("*").alias("n"))
    return g.crossJoin(c).join(n, ["genome_id", "contig_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))  # two dimensions of contigs and genomes


def merge(*frames: DataFrame) -> DataFrame:
    """All rows of all frames; duplicates stay."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def genotypes(df: DataFrame) -> DataFrame:
    """(genome_id, hgvs, n): how often each genome has each variant that it has."""
    return with_hgvs(df).groupBy("genome_id", "hgvs").agg(F.count("*").alias("n"))


def _summary(g: DataFrame, by: str, size: Column) -> DataFrame:
    t = g.groupBy(by).agg(F.count_if(F.col("n") == 1).alias("minor_heterozygous"), F.count_if(F.col("n") == 2).alias("minor_homozygous"), F.count("*").alias("_present"))
    return t.withColumn("reference_homozygous", size - F.col("_present")).drop("_present")


def allele_summary_by_variant(df: DataFrame, genomes: DataFrame) -> DataFrame:
    """Per variant the genomes without it, with one and with two; other counts are left out. genomes gives all genome ids."""
    n = genomes.select("genome_id").distinct().agg(F.count("*").alias("_n"))
    return _summary_with(genotypes(df), "hgvs", n)


def allele_summary_by_genome(df: DataFrame) -> DataFrame:
    """Per genome the variants of the population that it lacks, has once and has twice."""
    g = genotypes(df)
    return _summary_with(g, "genome_id", g.select("hgvs").distinct().agg(F.count("*").alias("_n")))


def _summary_with(g: DataFrame, by: str, n: DataFrame) -> DataFrame:
    t = g.groupBy(by).agg(F.count_if(F.col("n") == 1).alias("minor_heterozygous"), F.count_if(F.col("n") == 2).alias("minor_homozygous"), F.count("*").alias("_present"))
    return t.crossJoin(F.broadcast(n)).select(by, (F.col("_n") - F.col("_present")).alias("reference_homozygous"), "minor_heterozygous", "minor_homozygous")  # one row


def population_summary(df: DataFrame) -> DataFrame:
    t = allele_summary_by_genome(df)
    return t.agg(*[F.sum(c).alias(c) for c in ("reference_homozygous", "minor_heterozygous", "minor_homozygous")])


def ratios(df: DataFrame) -> DataFrame:
    """hom_het and minor_hom_het of a summary; 0 without heterozygous."""
    het = F.col("minor_heterozygous")
    ratio = lambda x: F.when(het > 0, x / het).otherwise(0.0)
    return df.withColumns({"hom_het": ratio(F.col("reference_homozygous") + F.col("minor_homozygous")), "minor_hom_het": ratio(F.col("minor_homozygous"))})


def af_bin(af: str = "af", bins: Sequence[tuple[float, float]] = AF_BINS) -> Column:
    """Index of the bin [lower, upper) that af lies in; NULL for none."""
    out = F.lit(None).cast("int")
    for i, (lo, up) in enumerate(bins):
        out = F.when((F.col(af) >= lo) & (F.col(af) < up), i).otherwise(out)
    return out


def fws_bins(df: DataFrame) -> DataFrame:
    """Per genome and frequency bin the summary against the variants of that bin; rows without a frequency or at 1.0 are in no bin."""
    t = with_hgvs(df).withColumn("bin", af_bin()).where("bin IS NOT NULL")
    g = t.groupBy("bin", "genome_id", "hgvs").agg(F.count("*").alias("n"))
    size = t.groupBy("bin").agg(F.countDistinct("hgvs").alias("_n"))
    s = g.groupBy("bin", "genome_id").agg(F.count_if(F.col("n") == 1).alias("minor_heterozygous"), F.count_if(F.col("n") == 2).alias("minor_homozygous"), F.count("*").alias("_present"))
    return s.join(size, "bin").select("bin", "genome_id", (F.col("_n") - F.col("_present")).alias("reference_homozygous"), "minor_heterozygous", "minor_homozygous")


def zygosity(df: DataFrame, compat: bool = True) -> DataFrame:
    """Per genome and contig: total, SNPs, indels, loci with one row (heterozygous with the reference), hom and het minor rows.

    With compat the homozygous count takes the distinct variants of every locus with several rows.
    """
    locus = with_hgvs(df).groupBy("genome_id", "contig_id", "pos").agg(F.count("*").alias("n"), F.countDistinct("hgvs").alias("d"), F.count_if(V.is_snp()).alias("s"))
    many = F.col("n") > 1
    hom = F.when(many, F.col("d") if compat else F.when((F.col("n") == 2) & (F.col("d") == 1), 1).otherwise(0)).otherwise(0)
    return locus.groupBy("genome_id", "contig_id").agg(
        F.sum("n").alias("total"), F.sum("s").alias("snps"), F.sum(F.col("n") - F.col("s")).alias("indels"),
        F.count_if(~many).alias("heterozygous_reference"), F.sum(hom).cast("long").alias("homozygous"), F.sum(F.when(many & (F.col("d") > 1), F.col("d")).otherwise(0)).cast("long").alias("heterozygous_minor"),
    )


def over_samples(zyg: DataFrame, samples: DataFrame) -> DataFrame:
    """Sums of zygosity over the distinct samples of a list."""
    t = zyg.join(samples.select("genome_id").distinct(), "genome_id", "left_semi")
    return t.agg(*[F.sum(c).alias(c) for c in ("total", "snps", "indels", "heterozygous_reference", "homozygous", "heterozygous_minor")])


def location_summary(zyg: DataFrame, samples: DataFrame, near: DataFrame, monoclonal: float = 0.95) -> DataFrame:
    """Per city the samples within a radius (near: city, other), those that pass QC, their monoclonal share, and rows of variants."""
    per = zyg.groupBy("genome_id").agg(F.sum("total").alias("total"), F.sum("homozygous").alias("hom"), F.sum("heterozygous_minor").alias("het"))
    t = samples.select("genome_id", F.col("city").alias("other"), "qc_pass", "fws").join(per, "genome_id", "left")
    t = near.select("city", "other").join(t, "other")
    n_qc = F.count_if("qc_pass")
    return t.groupBy("city").agg(
        F.count("*").alias("samples"), n_qc.alias("qc_samples"),
        F.when(n_qc > 0, F.count_if(F.col("qc_pass") & (F.col("fws") >= monoclonal)) / n_qc).otherwise(0.0).alias("monoclonal"),
        F.coalesce(F.sum("total"), F.lit(0)).alias("variants"), F.when(F.sum("het") > 0, F.sum("hom") / F.sum("het")).otherwise(0.0).alias("hom_het"),
    )


def wright_fis(observed: DataFrame, cities: DataFrame, countries: DataFrame, least: int = 20) -> DataFrame:
    """(Hexp - Hobs) / Hexp per sample; the country's expectation where the city has fewer than `least` passes.

    observed: genome_id, city, country, h_obs; cities and countries: name, h_exp and passes.
    """
    c = cities.select(F.col("city"), F.col("h_exp").alias("_hc"), "passes")
    n = countries.select("country", F.col("h_exp").alias("_hn"))
    t = observed.join(c, "city", "left").join(n, "country", "left")
    h = F.when(F.coalesce("passes", F.lit(0)) >= least, F.col("_hc")).otherwise(F.col("_hn"))
    return t.select("genome_id", F.when(h > 0, (h - F.col("h_obs")) / h).otherwise(0.0).alias("fis"))


def gene_carriers(df: DataFrame, gene: str = "gene_id") -> DataFrame:
    """Per gene: genomes that carry a variant, and those that carry one twice or more."""
    t = with_hgvs(df).groupBy(gene, "genome_id", "hgvs").agg(F.count("*").alias("n"))
    t = t.groupBy(gene, "genome_id").agg(F.max("n").alias("n"))
    return t.groupBy(gene).agg(F.count("*").alias("genomes"), F.count_if(F.col("n") > 1).alias("homozygous_genomes"))


def singletons(df: DataFrame) -> DataFrame:
    """Variants that one genome only carries, with this genome."""
    return with_hgvs(df).groupBy("hgvs").agg(F.min("genome_id").alias("genome_id"), F.max("genome_id").alias("_x")).where("genome_id = _x").drop("_x")


def genotype_groups(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Genomes with the same set of variants: (by, genotype, genomes). genotype: an order-free digest of the distinct variants.

    The digest is made of sums over two 64-bit hashes and the number of variants, so no set is ever gathered.
    """
    distinct = with_hgvs(df).select(*by, "genome_id", "hgvs").distinct()
    hashes = [F.xxhash64("hgvs", F.lit(seed)) for seed in (1, 2)]
    digest = F.concat_ws("-", F.count("*").cast("string"), *[F.hex(F.bit_xor(h)) for h in hashes], F.hex(F.sum(F.pmod(hashes[0], F.lit(1 << 31))).cast("long")))
    t = distinct.groupBy(*by, "genome_id").agg(digest.alias("genotype"))
    return t.groupBy(*by, "genotype").agg(F.count("*").alias("genomes"))


def diversity(groups: DataFrame, n_genomes: int, by: Sequence[str] = (), compat: bool = True) -> DataFrame:
    """gini, hrel and iqv of group sizes, the category of genomes without variants (n_genomes less the rest) always counted.

    gini: 1 - sum|fi - fj| / (N (K - 1)) over pairs; hrel: entropy by that of K equal shares; iqv: K / (K - 1) (1 - sum p^2),
    with compat p as a share of 100 N.
    """
    order = W.partitionBy(*by).orderBy("genomes", "genotype")
    t = groups.select(*by, "genotype", "genomes")
    rest = t.groupBy(*by).agg((F.lit(n_genomes) - F.sum("genomes")).alias("genomes")).select(*by, F.lit("").alias("genotype"), "genomes")
    t = t.unionByName(rest).withColumn("_r", F.row_number().over(order))
    p = F.col("genomes") / n_genomes
    entropy = F.when(F.col("genomes") > 0, -p * F.log2(p)).otherwise(0.0)
    t = t.groupBy(*by).agg(F.count("*").alias("k"), F.sum("genomes").alias("n"), F.sum(F.col("genomes") * F.col("_r")).alias("_ranked"), F.sum(entropy).alias("_h"), F.sum(p * p).alias("_p2"))
    gap = 2 * F.col("_ranked") - (F.col("k") + 1) * F.col("n")  # sum over pairs of |fi - fj|
    scale = 1e-4 if compat else 1.0
    return t.select(*by, "k", (1 - gap / (F.col("n") * (F.col("k") - 1))).alias("gini"), (F.col("_h") / F.log2("k")).alias("hrel"), (F.col("k") / (F.col("k") - 1) * (1 - F.col("_p2") * scale)).alias("iqv"))


def ensembl_index(df: DataFrame, gene: str = "gene", prefix: str = "ENSG") -> DataFrame:
    """(gene, hgvs) for identifiers with the prefix, each once."""
    return with_hgvs(df).where(F.startswith(F.col(gene), F.lit(prefix))).select(gene, "hgvs").distinct()


def other_identifiers(df: DataFrame, gene: str = "gene", prefix: str = "ENSG") -> DataFrame:
    return df.agg(F.count_if(~F.contains(F.col(gene), F.lit(prefix))).alias("n"))


def identifier_index(df: DataFrame, by: Sequence[str] = (), order: Sequence[str] = ("vcf_line", "part", "supp")) -> DataFrame:
    """Per identifier (of each of `by`) the first variant; blanks are left out."""
    return with_hgvs(df).where("identifier <> ''").groupBy(*by, "identifier").agg(F.min_by("hgvs", F.struct(*order)).alias("hgvs"))


def value_counts(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """How often each value that isn't blank occurs."""
    return df.where(F.col(column).isNotNull() & (F.col(column) != "")).groupBy(*by, F.col(column).alias("value")).agg(F.count("*").alias("n"))


def gene_effects(df: DataFrame, gene: str = "gene", impact: str = "impact") -> DataFrame:
    """Per gene: rows of high and of moderate impact, genomes with any and genomes with one of high impact twice or more."""
    t = with_hgvs(df).groupBy(gene, "genome_id", "hgvs").agg(F.count("*").alias("n"), F.count_if(F.col(impact) == "HIGH").alias("h"), F.count_if(F.col(impact) == "MODERATE").alias("m"))
    g = t.groupBy(gene, "genome_id").agg(F.sum("h").alias("h"), F.sum("m").alias("m"), F.max(F.when(F.col("h") > 1, 1).otherwise(0)).alias("hom"))
    return g.groupBy(gene).agg(F.sum("h").alias("high"), F.sum("m").alias("moderate"), F.count_if(F.col("h") > 0).alias("high_genomes"), F.sum("hom").cast("long").alias("high_homozygous_genomes"))


def ethnicity(df: DataFrame, samples: DataFrame, populations: Sequence[str], by: Sequence[str] = ("contig_id",), column: str = "population") -> DataFrame:
    """Rows per population as columns, and by sex."""
    t = df.join(samples.select("genome_id", column, "sex"), "genome_id")
    return t.groupBy(*by).agg(*[F.count_if(F.col(column) == p).alias(p) for p in populations], F.count_if(F.col("sex") == "F").alias("female"), F.count_if(F.col("sex") == "M").alias("male"), F.count("*").alias("total"))


def sum_histograms(df: DataFrame, column: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Element-wise sums of arrays of one width."""
    return df.groupBy(*by).agg(F.array(*[F.sum(F.get(column, F.lit(i))) for i in range(bins)]).alias(column))


def age_weights(histogram: str, younger: Column, older: Column, first: float = 32.5, step: float = 5.0, low: float = 27.5, high: float = 82.5) -> Column:
    """struct(total, average) of an age histogram with its open ends, ages weighted by the middles of their bins."""
    h = F.col(histogram)
    total = F.aggregate(h, F.lit(0.0), lambda a, x: a + x) + younger + older
    ages = F.aggregate(F.transform(h, lambda x, i: x * (first + i * step)), F.lit(0.0), lambda a, x: a + x) + younger * low + older * high
    return F.struct(total.alias("total"), F.when(total > 0, ages / total).otherwise(0.0).alias("average"))


def sweep(df: DataFrame, column: str, cutoffs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Rows at or above each cutoff, in one pass: one row per cutoff (and `by`)."""
    t = df.groupBy(*by).agg(F.array(*[F.struct(F.lit(float(c)).alias("cutoff"), F.count_if(F.col(column) >= c).alias("n")) for c in cutoffs]).alias("s"))
    return t.select(*by, F.explode("s").alias("s")).select(*by, "s.*")


def tiles(df: DataFrame, size: int, length: int | None = None) -> DataFrame:
    """Per contig and tile: rows, SNPs, transitions and transversions, and loci with 1, 2, 3, 4 and 5 or more rows.

    With a length, every tile of each contig up to it is there, also empty ones and a shorter last one.
    """
    snp = F.col("s")
    locus = df.groupBy("contig_id", "pos").agg(F.count("*").alias("n"), F.count_if(V.is_snp()).alias("s"), F.count_if(V.is_snp() & V.is_transition()).alias("ti"))
    t = locus.withColumn("tile", F.floor(F.col("pos") / size)).groupBy("contig_id", "tile").agg(
        F.sum("n").alias("variants"), F.sum(snp).alias("snps"), F.sum("ti").alias("transitions"), F.sum(snp - F.col("ti")).alias("transversions"),
        *[F.count_if(F.col("n") == k if k < 5 else F.col("n") >= 5).alias(f"loci_{k}") for k in range(1, 6)],
    )
    if length is None:
        return t
    grid = df.select("contig_id").distinct().select("contig_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((length - 1) // size).cast("long"))).alias("tile"))
    return grid.join(t, ["contig_id", "tile"], "left").fillna(0)


def citation_counts(citations: DataFrame) -> DataFrame:
    return citations.groupBy("pmid").agg(F.countDistinct("cited_by").alias("citations"))


def mean_sd(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean and sample deviation; 0 and 0 for none, deviation 0 for one."""
    return df.groupBy(*by).agg(F.coalesce(F.avg(column), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_samp(column), F.lit(0.0)).alias("sd"))
