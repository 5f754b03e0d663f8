"""Queries over the ontology relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ontology as G
from ..storage import stored
from .fixtures import ctes, frame
from .registry import query

#: Closure, depth and information content for the oracle.
BASE = (
    ctes("term_edges", "annotations")
    + """, walk(term, ancestor, distance) AS (SELECT t, t, 0 FROM (SELECT child AS t FROM term_edges UNION SELECT parent FROM term_edges)
  UNION SELECT w.term, e.parent, w.distance + 1 FROM walk w JOIN term_edges e ON e.child = w.ancestor),
paths(term, ancestor, distance) AS (SELECT t, t, 0 FROM (SELECT child AS t FROM term_edges UNION SELECT parent FROM term_edges)
  UNION ALL SELECT w.term, e.parent, w.distance + 1 FROM paths w JOIN term_edges e ON e.child = w.ancestor),
closure AS (SELECT term, ancestor, min(distance) AS distance FROM walk GROUP BY 1, 2),
depth AS (SELECT term, min(distance) AS depth FROM closure WHERE ancestor = 'ROOT' GROUP BY 1),
tot AS (SELECT ancestor AS term, count(*) AS n FROM closure JOIN annotations USING (term) GROUP BY 1),
ic AS (SELECT term, -ln(n::DOUBLE / (SELECT n FROM tot WHERE term = 'ROOT')) AS ic FROM tot),
pairs AS (SELECT DISTINCT least(a.term, b.term) AS a, greatest(a.term, b.term) AS b FROM (SELECT DISTINCT term FROM annotations WHERE CAST(substr(term, 2) AS INT) % 20 = 0) a, (SELECT DISTINCT term FROM annotations) b),
shared AS (SELECT a, b, x.ancestor FROM pairs JOIN closure x ON x.term = a JOIN closure y ON y.term = b AND y.ancestor = x.ancestor),
mica AS (SELECT a, b, greatest(max(ic), 0) AS mica FROM shared JOIN ic ON ic.term = ancestor GROUP BY 1, 2),
s AS (SELECT m.*, x.ic AS xa, y.ic AS xb, (SELECT max(ic) FROM ic) AS top FROM mica m LEFT JOIN ic x ON x.term = a LEFT JOIN ic y ON y.term = b)"""
)


def _data(spark, d):
    """Edges, annotations, closure, information content, and the annotated terms; asked are those whose number 20 divides."""
    e, a = frame(spark, d, "term_edges"), frame(spark, d, "annotations")
    c = G.closure(e)
    n = stored(a.groupBy("term").agg(F.count("*").alias("n")), "terms")
    terms = n.select("term", F.expr("coalesce(CAST(substr(term, 2) AS INT) % 20 = 0, false)").alias("asked"))  # every twentieth against all
    return e, a, c, stored(G.information_content_of(c, n, e), "ic"), terms


@query(f"{BASE} SELECT * FROM closure")
def ancestor_closure(spark, d):
    return G.closure(frame(spark, d, "term_edges"))


@query(f"{BASE} SELECT ancestor, count(*) AS descendants, max(distance) AS farthest FROM closure WHERE distance > 0 GROUP BY 1")
def descendant_counts(spark, d):
    return G.strict(G.closure(frame(spark, d, "term_edges"))).groupBy("ancestor").agg(F.count("*").alias("descendants"), F.max("distance").alias("farthest"))


@query(f"{BASE} SELECT * FROM depth")
def term_depth(spark, d):
    e = frame(spark, d, "term_edges")
    return G.depth(e, G.closure(e))


@query(f"{BASE} SELECT DISTINCT child AS term, 'leaf' AS kind FROM term_edges WHERE child NOT IN (SELECT parent FROM term_edges) UNION ALL SELECT DISTINCT parent, 'root' FROM term_edges WHERE parent NOT IN (SELECT child FROM term_edges)")
def leaves_and_roots(spark, d):
    e = frame(spark, d, "term_edges")
    return G.leaves(e).withColumn("kind", F.lit("leaf")).union(G.roots(e).withColumn("kind", F.lit("root")))


@query(f"{BASE} SELECT child, parent FROM term_edges WHERE child IN (SELECT ancestor FROM closure WHERE term = 'S7') AND parent IN (SELECT ancestor FROM closure WHERE term = 'S7')")
def induced_subgraph(spark, d):
    e = frame(spark, d, "term_edges")
    return G.induced(e, G.closure(e), "S7").select("child", "parent")


@query("""WITH RECURSIVE e AS (SELECT concat('n', n_nationkey) AS a, concat('r', n_nationkey % 7) AS b FROM nation UNION SELECT concat('s', s_suppkey), concat('n', s_nationkey) FROM supplier
  UNION SELECT concat('p', p_partkey), concat('p', p_partkey // 10) FROM part WHERE p_partkey % 10 <> 0 OR p_partkey < 10),
up AS (SELECT a, b FROM e UNION SELECT up.a, e.b FROM up JOIN e ON e.a = up.b), top AS (SELECT a AS term, b AS root FROM up WHERE b NOT IN (SELECT a FROM e WHERE a <> b) UNION SELECT b, b FROM e WHERE b NOT IN (SELECT a FROM e WHERE a <> b))
SELECT term, min(term) OVER (PARTITION BY root) AS component FROM top""")
def graph_components(spark, d):
    """Regions' nations and suppliers, and chains of parts: a graph of many parts."""
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    edge = lambda a, x, b, y: (F.concat(F.lit(a), x.cast("string")).alias("child"), F.concat(F.lit(b), y.cast("string")).alias("parent"))
    n, s, p = F.col("n_nationkey"), F.col("s_suppkey"), F.col("p_partkey")
    e = read("nation").select(*edge("n", n, "r", n % 7)).union(read("supplier").select(*edge("s", s, "n", F.col("s_nationkey"))))
    return G.components(e.union(read("part").where((p % 10 != 0) | (p < 10)).select(*edge("p", p, "p", F.floor(p / 10)))))


@query(f"{BASE} SELECT term, round(ic, 9) + 0.0 AS ic FROM ic")
def information_content(spark, d):
    return _data(spark, d)[3].select("term", (F.round("ic", 9) + 0.0).alias("ic"))


@query(f"{BASE}, t2 AS (SELECT ancestor AS term, count(*) AS n FROM paths JOIN annotations USING (term) GROUP BY 1) SELECT term, round(-ln(n::DOUBLE / (SELECT n FROM t2 WHERE term = 'ROOT')), 9) + 0.0 AS ic FROM t2")
def information_content_paths(spark, d):
    e, a = frame(spark, d, "term_edges"), frame(spark, d, "annotations")
    return G.information_content_paths(e, a).select("term", (F.round("ic", 9) + 0.0).alias("ic"))


@query(f"{BASE} SELECT a, b, round(mica, 9) + 0.0 AS mica FROM mica")
def mica(spark, d):
    _, _, c, ic, t = _data(spark, d)
    return G.among(c, t, lambda p: G.mica(c, ic, p).select("a", "b", (F.round("mica", 9) + 0.0).alias("mica")))


@query(f"{BASE} SELECT a, b, round(avg(ic), 9) + 0.0 AS info FROM shared JOIN ic ON ic.term = ancestor GROUP BY 1, 2")
def ancestor_mean_information(spark, d):
    _, _, c, ic, t = _data(spark, d)
    return G.among(c, t, lambda p: G.mean_shared(c, ic, p).select("a", "b", (F.round("info", 9) + 0.0).alias("info")))


_MEASURES = {
    "resnik": "CASE WHEN top > 0 THEN mica / top ELSE 0 END",
    "lin": "CASE WHEN a = b THEN 1 WHEN xa + xb > 0 THEN 2 * mica / (xa + xb) ELSE 0 END",
    "relevance": "CASE WHEN xa + xb > 0 AND mica > 0 THEN 2 * mica / (xa + xb) * (1 - exp(-mica)) ELSE 0 END",
    "jiang_conrath": "1 - least((xa + xb - 2 * mica) / top, 1)",
    "jiang_conrath_alternative": "CASE WHEN a = b THEN 1 ELSE 1 - (xa + xb - 2 * mica) / (2 * top) END",
}


def _measure(name):
    def run(spark, d):
        _, _, c, ic, t = _data(spark, d)
        return G.similarity_among(c, ic, t, [name]).select("a", "b", (F.round(name, 9) + 0.0).alias(name))

    run.__name__ = f"similarity_{name}"
    query(f"{BASE} SELECT a, b, round({_MEASURES[name]}, 9) + 0.0 AS {name} FROM s")(run)


for _m in _MEASURES:
    _measure(_m)

_LCA = "lca AS (SELECT a, b, ancestor AS lca, depth FROM (SELECT a, b, ancestor, depth, row_number() OVER (PARTITION BY a, b ORDER BY depth DESC, ancestor) AS k FROM shared JOIN depth ON depth.term = ancestor) WHERE k = 1)"


@query(f"{BASE}, {_LCA} SELECT * FROM lca")
def lowest_common_ancestor(spark, d):
    e, _, c, _, t = _data(spark, d)
    return G.among(c, t, lambda p: G.lowest_common_ancestor(c, G.depth(e, c), p)).select("a", "b", "lca", "depth")


@query(f"{BASE}, {_LCA} SELECT a, b, round(coalesce(depth::DOUBLE / nullif(x.distance + y.distance + depth, 0), 0), 9) AS pekar_staab FROM lca JOIN closure x ON x.term = a AND x.ancestor = lca JOIN closure y ON y.term = b AND y.ancestor = lca")
def pekar_staab(spark, d):
    e, _, c, _, t = _data(spark, d)
    return G.among(c, t, lambda p: G.pekar_staab(e, c, p).withColumn("pekar_staab", F.round("pekar_staab", 9)))


#: Term sets of genes; every twentieth is compared with the six behind it.
_SETS = "sets AS (SELECT DISTINCT gene AS \"set\", term FROM annotations), xy AS (SELECT x.\"set\" AS x, y.\"set\" AS y FROM (SELECT DISTINCT \"set\", CAST(substr(\"set\", 2) AS BIGINT) AS i FROM sets) x JOIN (SELECT DISTINCT \"set\", CAST(substr(\"set\", 2) AS BIGINT) AS i FROM sets) y ON x.i % 20 = 0 AND y.i > x.i AND y.i <= x.i + 6)"
_SETS_PAIRS = "pairs AS (SELECT DISTINCT least(p.term, q.term) AS a, greatest(p.term, q.term) AS b FROM xy JOIN sets p ON p.\"set\" = x JOIN sets q ON q.\"set\" = y)"


def _sets(a):
    s = stored(a.select(F.col("gene").alias("set"), "term").distinct(), "sets")
    k = s.select("set").distinct().withColumn("i", F.substring("set", 2, 20).cast("long"))
    x = k.where("i % 20 = 0").select(F.col("set").alias("x"), F.explode(F.sequence(F.col("i") + 1, F.col("i") + 6)).alias("i"))
    xy = stored(x.join(k.withColumnRenamed("set", "y"), "i").select("x", "y"), "xy")
    return s, xy


#: The oracle's base without the pairs that it is given for single terms.
_FRONT, _BACK = BASE.split("pairs AS (", 1)
_BACK = _BACK[_BACK.index("shared AS ("):]
_BASE_SETS = f"{_FRONT}{_SETS}, {_SETS_PAIRS}, {_BACK}"


@query(f"""{_BASE_SETS}, lin AS (SELECT a, b, {_MEASURES['lin']} AS v FROM s UNION SELECT b, a, {_MEASURES['lin']} FROM s), t AS (SELECT x, y, p.term AS a, q.term AS b, coalesce(v, 0) AS v FROM xy JOIN sets p ON p."set" = x JOIN sets q ON q."set" = y LEFT JOIN lin ON lin.a = p.term AND lin.b = q.term),
r AS (SELECT x, y, avg(m) AS av, sum(m) AS sm, count(*) AS n FROM (SELECT x, y, a, max(v) AS m FROM t GROUP BY 1, 2, 3) GROUP BY 1, 2), c AS (SELECT x, y, avg(m) AS av, sum(m) AS sm, count(*) AS n FROM (SELECT x, y, b, max(v) AS m FROM t GROUP BY 1, 2, 3) GROUP BY 1, 2), o AS (SELECT x, y, avg(v) AS pa, max(v) AS pm FROM t GROUP BY 1, 2)
SELECT x, y, round(pa, 9) AS pair_average, round(pm, 9) AS pair_maximum, round((r.av + c.av) / 2, 9) AS best_match_average, round((r.sm + c.sm) / (r.n + c.n), 9) AS average_best_match FROM o JOIN r USING (x, y) JOIN c USING (x, y)""")
def set_similarity_lin(spark, d):
    _, a, c, ic, _ = _data(spark, d)
    s, xy = _sets(a)
    t = G.set_similarity_of(s, xy, c, ic, "lin")
    return t.select("x", "y", *[F.round(k, 9).alias(k) for k in t.columns[2:]])


@query(f"""{BASE}, {_SETS}, up AS (SELECT DISTINCT "set", ancestor AS term FROM sets JOIN closure USING (term)), w AS (SELECT up.*, coalesce(ic, 0) AS ic FROM up LEFT JOIN ic USING (term)),
z AS (SELECT "set", count(*) AS n, sum(ic) AS i FROM w GROUP BY 1), zt AS (SELECT "set", count(*) AS n FROM sets GROUP BY 1), o AS (SELECT x, y, count(*) AS n, sum(p.ic) AS i FROM xy JOIN w p ON p."set" = x JOIN w q ON q."set" = y AND q.term = p.term GROUP BY 1, 2), ot AS (SELECT x, y, count(*) AS n FROM xy JOIN sets p ON p."set" = x JOIN sets q ON q."set" = y AND q.term = p.term GROUP BY 1, 2)
SELECT x, y, round(coalesce(ot.n, 0)::DOUBLE / (ta.n + tb.n - coalesce(ot.n, 0)), 9) AS jaccard, round(coalesce(o.n, 0)::DOUBLE / (a.n + b.n - coalesce(o.n, 0)), 9) AS ui, round(coalesce(o.i, 0) / (a.i + b.i - coalesce(o.i, 0)), 9) AS gic, round(2 * coalesce(o.i, 0) / (a.i + b.i), 9) AS dic, round(coalesce(o.i, 0) / greatest(a.i, b.i), 9) AS uic
FROM xy JOIN z a ON a."set" = x JOIN z b ON b."set" = y JOIN zt ta ON ta."set" = x JOIN zt tb ON tb."set" = y LEFT JOIN o USING (x, y) LEFT JOIN ot USING (x, y)""")
def set_similarity_graph(spark, d):
    _, a, c, ic, _ = _data(spark, d)
    s, xy = _sets(a)
    t = G.graph_similarity(s, xy, c, ic)
    return t.select("x", "y", *[F.round(k, 9).alias(k) for k in t.columns[2:]])


@query(f"""{BASE}, g AS (SELECT DISTINCT gene, term FROM annotations), att AS (SELECT DISTINCT gene, ancestor AS term FROM g JOIN closure USING (term)), smp AS (SELECT DISTINCT gene FROM g WHERE CAST(substr(gene, 2) AS INT) % 5 = 0),
k AS (SELECT term, count(*) AS KK, count(CASE WHEN gene IN (SELECT gene FROM smp) THEN 1 END) AS k, (SELECT count(DISTINCT gene) FROM g) AS NN, (SELECT count(*) FROM smp) AS n FROM att GROUP BY 1),
p AS (SELECT term, KK, k, sum(exp(lgamma(KK + 1) - lgamma(i + 1) - lgamma(KK - i + 1) + lgamma(NN - KK + 1) - lgamma(n - i + 1) - lgamma(NN - KK - n + i + 1) - lgamma(NN + 1) + lgamma(n + 1) + lgamma(NN - n + 1))) AS p
  FROM k LEFT JOIN range(0, 20001) r(i) ON i >= greatest(k, greatest(0, n + KK - NN) + 1) AND i <= least(n, KK) GROUP BY term, KK, k) SELECT term, KK AS population, k AS shared, round(CASE WHEN k = 0 THEN 1 ELSE coalesce(p, 0) END, 7) AS p FROM p""")
def enrichment_p(spark, d):
    e, a = frame(spark, d, "term_edges"), frame(spark, d, "annotations")
    t = G.enrichment(G.closure(e), a, a.where("CAST(substr(gene, 2) AS INT) % 5 = 0"))
    return t.withColumn("p", F.round("p", 7))


@query(None)
def disjoint_common_information(spark, d):
    e, _, c, ic, t = _data(spark, d)
    return G.among(c, t, lambda p: G.disjoint_common(e, c, ic, p))


_OWN = "own AS (SELECT a, b, ancestor AS child, count(*) AS k FROM (SELECT a, b, ancestor FROM pairs JOIN closure ON term = a UNION ALL SELECT a, b, ancestor FROM pairs JOIN closure ON term = b) GROUP BY 1, 2, 3)"


@query(f"""{BASE}, {_OWN}, apart AS (SELECT * FROM own o WHERE NOT EXISTS (SELECT 1 FROM shared s WHERE s.a = o.a AND s.b = o.b AND s.ancestor = o.child)),
t AS (SELECT a, b, parent AS ancestor FROM apart JOIN term_edges USING (child) INTERSECT SELECT * FROM shared UNION SELECT * FROM shared WHERE ancestor = a OR ancestor = b) SELECT a, b, round(avg(ic), 9) + 0.0 AS info FROM t JOIN ic ON ic.term = ancestor GROUP BY 1, 2""")
def frontier_information(spark, d):
    e, _, c, ic, t = _data(spark, d)
    return G.among(c, t, lambda p: G.frontier(e, c, ic, p).select("a", "b", (F.round("info", 9) + 0.0).alias("info")))


@query(f"""{BASE}, {_OWN}, t AS (SELECT a, b, parent AS ancestor FROM own JOIN term_edges USING (child) WHERE k = 1 AND a <> b INTERSECT SELECT * FROM shared UNION SELECT * FROM shared WHERE a = b AND ancestor = a)
SELECT a, b, round(avg(ic), 9) + 0.0 AS info FROM t JOIN ic ON ic.term = ancestor GROUP BY 1, 2""")
def exclusive_inherited_information(spark, d):
    e, _, c, ic, t = _data(spark, d)
    return G.among(c, t, lambda p: G.exclusive_inherited(e, c, ic, p).select("a", "b", (F.round("info", 9) + 0.0).alias("info")))


@query(f"{BASE} SELECT gene, count(DISTINCT term) AS terms FROM annotations GROUP BY 1")
def terms_per_gene(spark, d):
    return G.annotation_counts(frame(spark, d, "annotations"))[0]


@query(f"{BASE} SELECT term, count(DISTINCT gene) AS genes FROM annotations GROUP BY 1")
def genes_per_term(spark, d):
    return G.annotation_counts(frame(spark, d, "annotations"))[1]
