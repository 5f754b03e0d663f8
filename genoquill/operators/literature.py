"""Publication and citation statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sequence import author_key


def month_distance(a_year: Column, a_month: Column, b_year: Column, b_month: Column) -> Column:
    """Calendar months between two dates, days ignored, always positive."""
    return F.abs((a_year - b_year) * 12 + a_month - b_month)


def cited_pairs(publications: DataFrame, citations: DataFrame) -> DataFrame:
    """(pmid, cited_by, months) of distinct citations within the corpus."""
    p = publications.select("pmid", F.col("year").alias("_y"), F.col("month").alias("_m"))
    q = publications.select(F.col("pmid").alias("cited_by"), F.col("year").alias("_cy"), F.col("month").alias("_cm"))
    return citations.select("pmid", "cited_by").distinct().join(p, "pmid").join(q, "cited_by").select("pmid", "cited_by", month_distance(F.col("_cy"), F.col("_cm"), F.col("_y"), F.col("_m")).alias("months"))


def citation_months(pairs: DataFrame) -> DataFrame:
    """How many citations came how many months behind."""
    return pairs.groupBy("months").agg(F.count("*").alias("n"))


def citation_percent(pairs: DataFrame, months: int = 120) -> DataFrame:
    """(month, mean, sd): over cited publications, the share of a publication's citations that had come by each month."""
    total = pairs.groupBy("pmid").agg(F.count("*").alias("_n"))
    at = pairs.groupBy("pmid", "months").agg(F.count("*").alias("c"))
    grid = total.select("pmid", "_n", F.explode(F.sequence(F.lit(0), F.lit(months))).alias("months"))
    t = grid.join(at, ["pmid", "months"], "left")
    share = F.sum(F.coalesce("c", F.lit(0))).over(W.partitionBy("pmid").orderBy("months").rowsBetween(W.unboundedPreceding, 0)) / F.col("_n")
    return t.select(F.col("months").alias("month"), share.alias("s")).groupBy("month").agg(F.avg("s").alias("mean"), F.coalesce(F.stddev_samp("s"), F.lit(0.0)).alias("sd"))


def citation_arrivals(pairs: DataFrame, months: int = 120) -> DataFrame:
    """Citations in each of the months 1 to `months`, zeros included."""
    grid = pairs.sparkSession.range(1, months + 1).select(F.col("id").cast("int").alias("month"))
    return grid.join(pairs.groupBy(F.col("months").cast("int").alias("month")).agg(F.count("*").alias("n")), "month", "left").fillna(0)


def citation_distribution(publications: DataFrame, citations: DataFrame, last: int = 101) -> DataFrame:
    """Publications by number of citations, 0 to last, what is above in the last."""
    n = citations.select("pmid", "cited_by").distinct().groupBy("pmid").agg(F.count("*").alias("_n"))
    counted = publications.select("pmid").join(n, "pmid", "left").groupBy(F.least(F.coalesce("_n", F.lit(0)), F.lit(last)).cast("int").alias("citations")).agg(F.count("*").alias("n"))
    grid = publications.sparkSession.range(0, last + 1).select(F.col("id").cast("int").alias("citations"))
    return grid.join(counted, "citations", "left").fillna(0)


def _citation_counts(citations: DataFrame) -> DataFrame:
    return citations.select("pmid", "cited_by").distinct().groupBy("pmid").agg(F.count("*").alias("citations"))


def grouped(publications: DataFrame, citations: DataFrame, key: Column, name: str) -> DataFrame:
    """(key, publications, citations) by a key such as author, year or journal."""
    t = publications.withColumn("_k", key).join(_citation_counts(citations), "pmid", "left")
    return t.groupBy(F.col("_k").alias(name)).agg(F.count("*").alias("publications"), F.coalesce(F.sum("citations"), F.lit(0)).alias("citations"))


def by_author(publications: DataFrame, citations: DataFrame) -> DataFrame:
    return grouped(publications, citations, author_key("author", "initials"), "author")


def most_recent(publications: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The pmid of the last year and month, the largest of equal ones."""
    return publications.groupBy(*by).agg(F.max(F.struct("year", "month", "pmid")).alias("m")).select(*by, F.col("m.pmid").alias("pmid"), F.col("m.year").alias("year"), F.col("m.month").alias("month"))


def old_enough(publications: DataFrame, year: int, month: int, months: int = 120) -> DataFrame:
    return publications.where(month_distance(F.lit(year), F.lit(month), F.col("year"), F.col("month")) >= months)


def reverse_index(citations: DataFrame, rsid: str = "rsid", pmid: str = "pmid") -> DataFrame:
    """Per pmid the sorted identifiers that it cites."""
    return citations.groupBy(pmid).agg(F.sort_array(F.collect_set(rsid)).alias("rsids"))


def bibliography(style: str = "text") -> Column:
    """One line per publication: text, latex or extended."""
    a, t, j, y, p = (F.col(c).cast("string") for c in ("author", "title", "journal", "year", "pmid"))
    if style == "latex":
        return F.concat(F.lit("\\bibitem{pmid"), p, F.lit("} "), a, F.lit(", \\emph{"), t, F.lit("}, "), j, F.lit(" ("), y, F.lit(")."))
    short = F.concat(a, F.lit(" ("), y, F.lit("). "), t, F.lit(". "), j, F.lit(". PMID "), p)
    return short if style == "text" else F.concat(short, F.lit(". "), F.coalesce("abstract", F.lit("")))


def disease_genes(gene_pmids: DataFrame, disease_pmids: DataFrame) -> DataFrame:
    """Per gene its publications and those of the disease among them."""
    t = gene_pmids.select("gene", "pmid").distinct().join(disease_pmids.select("pmid", F.lit(1).alias("_d")).distinct(), "pmid", "left")
    return t.groupBy("gene").agg(F.count("*").alias("publications"), F.count("_d").alias("disease_publications"))
