"""Queries over publications and citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as P
from ..operators import joins as J
from ..operators import literature as L
from ..operators import ordered as O
from .fixtures import ctes, frame
from .registry import query

BOTH = ctes("publications", "citations") + ", pairs AS (SELECT DISTINCT c.pmid, c.cited_by, abs((q.year - p.year) * 12 + q.month - p.month) AS months FROM citations c JOIN publications p ON p.pmid = c.pmid JOIN publications q ON q.pmid = c.cited_by)"


def _both(spark, d):
    return frame(spark, d, "publications"), frame(spark, d, "citations")


def _pairs(spark, d):
    return L.cited_pairs(*_both(spark, d))


@query(f"{BOTH} SELECT months, count(*) AS n FROM pairs GROUP BY 1")
def citation_months(spark, d):
    return L.citation_months(_pairs(spark, d))


@query(f"""{BOTH}, g AS (SELECT pmid, n, CAST(m AS INT) AS month FROM (SELECT pmid, count(*) AS n FROM pairs GROUP BY 1), range(121) r(m)),
c AS (SELECT g.month, (SELECT count(*) FROM pairs p WHERE p.pmid = g.pmid AND p.months <= g.month)::DOUBLE / n AS s FROM g) SELECT month, round(avg(s), 9) AS mean, round(stddev_samp(s), 9) AS sd FROM c GROUP BY 1""")
def citation_percent(spark, d):
    t = L.citation_percent(_pairs(spark, d))
    return t.select("month", F.round("mean", 9).alias("mean"), F.round("sd", 9).alias("sd"))


@query(f"{BOTH} SELECT CAST(m AS INT) AS month, count(pmid) AS n FROM range(1, 121) r(m) LEFT JOIN pairs ON months = m GROUP BY 1")
def citation_arrivals(spark, d):
    return L.citation_arrivals(_pairs(spark, d))


@query(f"{BOTH}, k AS (SELECT pmid, count(DISTINCT cited_by) AS c FROM citations GROUP BY 1), z AS (SELECT least(coalesce(c, 0), 101) AS c FROM publications LEFT JOIN k USING (pmid)) SELECT CAST(r.i AS INT) AS citations, count(z.c) AS n FROM range(102) r(i) LEFT JOIN z ON z.c = r.i GROUP BY 1")
def citation_distribution(spark, d):
    return L.citation_distribution(*_both(spark, d))


_COUNT = "k AS (SELECT pmid, count(DISTINCT cited_by) AS c FROM citations GROUP BY 1)"


@query(f"{BOTH}, {_COUNT} SELECT concat(replace(author, ',', '_'), '_', upper(substr(initials, 1, 1))) AS author, count(*) AS publications, CAST(coalesce(sum(c), 0) AS BIGINT) AS citations FROM publications LEFT JOIN k USING (pmid) GROUP BY 1")
def author_counts(spark, d):
    return L.by_author(*_both(spark, d))


@query(f"{BOTH}, {_COUNT} SELECT year, count(*) AS publications, CAST(coalesce(sum(c), 0) AS BIGINT) AS citations FROM publications LEFT JOIN k USING (pmid) GROUP BY 1")
def year_counts(spark, d):
    return L.grouped(*_both(spark, d), F.col("year"), "year")


@query(f"{BOTH}, {_COUNT} SELECT journal, count(*) AS publications, CAST(coalesce(sum(c), 0) AS BIGINT) AS citations FROM publications LEFT JOIN k USING (pmid) GROUP BY 1")
def journal_counts(spark, d):
    return L.grouped(*_both(spark, d), F.col("journal"), "journal")


@query(f"{BOTH}, a AS (SELECT pmid, count(*) AS n FROM pairs WHERE pmid IN (SELECT pmid FROM publications WHERE (2024 - year) * 12 + 6 - month >= 120) GROUP BY 1), r AS (SELECT n AS v, row_number() OVER (ORDER BY n) - 1 AS k, count(*) OVER () AS n FROM a) SELECT p, v AS value FROM r, (SELECT CAST(unnest([0.1, 0.5, 0.9]) AS DOUBLE) AS p) q WHERE k = CAST(greatest(least(CASE WHEN n * p - 0.5 < 0 THEN -floor(-(n * p - 0.5) + 0.5) ELSE floor(n * p) END, n - 1), 0) AS BIGINT)")
def citation_quantiles(spark, d):
    p, c = _both(spark, d)
    n = L.cited_pairs(p, c).join(L.old_enough(p, 2024, 6), "pmid", "left_semi").groupBy("pmid").agg(F.count("*").alias("n"))
    return O.percentiles(n, "n", [0.1, 0.5, 0.9])


@query(f"{BOTH} SELECT DISTINCT pmid FROM publications WHERE mesh IN ('D1', 'D2', 'D3', 'D9') AND pmid IN (SELECT pmid FROM publications WHERE mesh IN ('D2', 'D9'))")
def mesh_or_and(spark, d):
    return J.or_and(frame(spark, d, "publications"), ["D1", "D2", "D3", "D9"], ["D2", "D9"])


@query(f"{BOTH} SELECT pmid FROM publications WHERE chemical IN ('ch1', 'ch5') AND contains(lower(abstract), 'the')")
def literature_filters(spark, d):
    t = frame(spark, d, "publications").withColumns({"chemicals": F.array("chemical"), "mesh": F.array("mesh")})
    return t.where(P.literature(chemicals=["ch1", "ch5"], title=["THE"])).select("pmid")


@query(f"{BOTH} SELECT pmid, cited_by FROM citations WHERE cited_by IN (SELECT pmid FROM publications) AND pmid IN (SELECT pmid FROM publications)")
def cited_by_join(spark, d):
    return J.cited_by(*_both(spark, d))


@query(f"{BOTH} SELECT journal, max(pmid) AS pmid, year, month FROM (SELECT *, rank() OVER (PARTITION BY journal ORDER BY year DESC, month DESC) AS r FROM publications) WHERE r = 1 GROUP BY journal, year, month")
def most_recent_publication(spark, d):
    return L.most_recent(frame(spark, d, "publications"), ["journal"])


@query(f"{BOTH} SELECT pmid, concat(author, ' (', CAST(year AS VARCHAR), '). ', title, '. ', journal, '. PMID ', CAST(pmid AS VARCHAR)) AS line FROM publications")
def bibliography(spark, d):
    return frame(spark, d, "publications").select("pmid", L.bibliography().alias("line"))


@query(f"{BOTH} SELECT CAST(cited_by % 50 AS BIGINT) AS gene, count(DISTINCT pmid) AS publications, count(DISTINCT CASE WHEN pmid % 17 IN (1, 2) THEN pmid END) AS disease_publications FROM citations GROUP BY 1")
def disease_gene_publications(spark, d):
    p, c = _both(spark, d)
    return L.disease_genes(c.select((F.col("cited_by") % 50).alias("gene"), "pmid"), J.or_and(p, ["D1", "D2"], []))


@query(f"{BOTH} SELECT pmid, CAST(count(DISTINCT cited_by) AS BIGINT) AS n, min(concat('rs', CAST(cited_by AS VARCHAR))) AS first FROM citations GROUP BY 1")
def citation_reverse_index(spark, d):
    t = L.reverse_index(frame(spark, d, "citations").select("pmid", F.concat(F.lit("rs"), F.col("cited_by").cast("string")).alias("rsid")))
    return t.select("pmid", F.size("rsids").cast("long").alias("n"), F.col("rsids")[0].alias("first"))
