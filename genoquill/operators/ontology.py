"""Ontology operators on edge lists: closure, depth, information content, term and set similarity, enrichment.

edges: (child, parent). closure: (term, ancestor), every term its own ancestor. ic: (term, ic). annotations: (gene, term).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import stored


def _acyclic(pairs: DataFrame) -> int:
    """How many pairs there are; ValueError if one joins a term with itself."""
    row = pairs.agg(F.count("*").alias("n"), F.count_if(F.col("term") == F.col("ancestor")).alias("loops")).first()
    if row.loops:
        raise ValueError("the edges hold a cycle")
    return row.n


def closure(edges: DataFrame) -> DataFrame:
    """(term, ancestor, distance): all ancestors, self included at 0, with the shortest distance. A cycle is an error.

    Distances double: from all pairs of up to 2^k edges those of up to 2^(k + 1) follow by one join of the pairs that are
    2^k apart, as a shortest path runs through such a place. So a chain of n edges takes log2(n) rounds, each a stored table.
    """
    e = edges.select("child", "parent").where("child IS NOT NULL AND parent IS NOT NULL").distinct()
    known = stored(e.select(F.col("child").alias("term"), F.col("parent").alias("ancestor"), F.lit(1).alias("distance")), "closure")
    _acyclic(known)
    reach = 1
    while True:
        half = known.where(F.col("distance") == reach).select("term", F.col("ancestor").alias("_via"))
        rest = known.select(F.col("term").alias("_via"), "ancestor", "distance")
        found = half.join(rest, "_via").groupBy("term", "ancestor").agg((F.min("distance") + reach).alias("distance"))
        more = stored(found.join(known.select("term", "ancestor"), ["term", "ancestor"], "left_anti"), "closure")
        if not _acyclic(more):
            break
        known, reach = stored(known.union(more), "closure"), 2 * reach
    terms = e.select(F.col("child").alias("term")).union(e.select("parent")).distinct()
    return stored(known.union(terms.select("term", F.col("term").alias("ancestor"), F.lit(0).alias("distance"))), "closure")


def strict(c: DataFrame) -> DataFrame:
    return c.where("distance > 0")


def descendants(c: DataFrame, term: str) -> DataFrame:
    return c.where(F.col("ancestor") == term).select(F.col("term").alias("descendant"))


def parents(edges: DataFrame, term: str) -> DataFrame:
    return edges.where(F.col("child") == term).select("parent").distinct()


def children(edges: DataFrame, term: str) -> DataFrame:
    return edges.where(F.col("parent") == term).select("child").distinct()


def leaves(edges: DataFrame) -> DataFrame:
    """Terms without children."""
    return edges.select(F.col("child").alias("term")).distinct().join(edges.select(F.col("parent").alias("term")), "term", "left_anti")


def roots(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("parent").alias("term")).distinct().join(edges.select(F.col("child").alias("term")), "term", "left_anti")


def induced(edges: DataFrame, c: DataFrame, term: str) -> DataFrame:
    """Edges among a term and its ancestors."""
    up = c.where(F.col("term") == term).select("ancestor")
    return edges.join(up.withColumnRenamed("ancestor", "child"), "child", "left_semi").join(up.withColumnRenamed("ancestor", "parent"), "parent", "left_semi")


def of_ontology(terms: DataFrame, ontology: str) -> DataFrame:
    return terms.where(F.col("ontology") == ontology)


def lookup(terms: DataFrame, ids: DataFrame, column: str, default: str = "") -> DataFrame:
    """(term, column) for ids, default for unknown ones."""
    return ids.join(terms.select("term", column), "term", "left").withColumn(column, F.coalesce(column, F.lit(default)))


def depth(edges: DataFrame, c: DataFrame) -> DataFrame:
    """(term, depth): fewest edges to a root."""
    return c.join(roots(edges).withColumnRenamed("term", "ancestor"), "ancestor", "left_semi").groupBy("term").agg(F.min("distance").alias("depth"))


def shared(c: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, ancestor) for ancestors, selves included, of both."""
    a = c.select(F.col("term").alias("a"), "ancestor")
    b = c.select(F.col("term").alias("b"), "ancestor")
    return pairs.select("a", "b").join(a, "a").join(b, ["b", "ancestor"]).select("a", "b", "ancestor")


def classes(c: DataFrame) -> DataFrame:
    """(term, low, high): terms that share the same ancestors with any third term, as the first and the last by name of them.

    Terms without descendants that have the same ancestors at the same distances are one class, as the terms themselves are shared
    with no other; distances hold the parents, and so the paths. A term with descendants is a class of its own.
    """
    inner = strict(c).select(F.col("ancestor").alias("term")).distinct()
    up = strict(c).groupBy("term").agg(F.sort_array(F.collect_list(F.struct("ancestor", "distance"))).alias("_up")).join(inner, "term", "left_anti")
    ends = up.groupBy("_up").agg(F.min("term").alias("low"), F.max("term").alias("high"))
    return up.join(ends, "_up").select("term", "low", "high").union(inner.select("term", F.col("term").alias("low"), F.col("term").alias("high")))


#: Pairs that one task of a product makes.
PRODUCT = 1 << 21


def among(c: DataFrame, terms: DataFrame, measure: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(a, b, columns of measure, x_a and x_b of each further column x of terms): all pairs a <= b of an asked term with a term.

    terms: distinct (term, asked, ...). measure gives (a, b, ...) of pairs and must not depend on their order. It is asked for one
    pair of each two classes and for the terms with themselves; the pairs of terms are a product of two lists, each looked up by
    its classes, so that no pair is shuffled or stored.
    """
    more = [x for x in terms.columns if x not in ("term", "asked")]
    k = classes(c)
    t = terms.where("term IS NOT NULL").join(k, "term", "left").withColumns({x: F.coalesce(x, "term") for x in ("low", "high")})
    t = stored(t.select("term", "asked", "low", "high", *more), "terms")
    ends = stored(t.select("low", "high").distinct().withColumn("_k", F.row_number().over(W.orderBy("low"))), "classes")  # one row a class
    t = stored(t.join(ends.select("low", "_k"), "low").select("term", "asked", "_k", *more), "terms")
    side = lambda d, x: d.select(F.col("_k").alias(f"_k{x}")).distinct().join(ends.select(F.col("_k").alias(f"_k{x}"), F.col("low").alias(f"_low{x}"), F.col("high").alias(f"_high{x}")), f"_k{x}")
    other = F.when(F.col("_kp") == F.col("_kq"), F.col("_highq")).otherwise(F.col("_lowq"))
    met = side(t.where("asked"), "p").crossJoin(side(t, "q")).where("_kp <> _kq OR _highq <> _lowq")
    met = stored(met.select("_kp", "_kq", F.least("_lowp", other).alias("a"), F.greatest("_lowp", other).alias("b")), "classes")
    found = measure(met.select("a", "b").distinct())
    values = [x for x in found.columns if x not in ("a", "b")]
    found = stored(met.join(found, ["a", "b"]).select("_kp", "_kq", *values), "measured")

    p = t.where("asked").select(F.col("term").alias("_p"), F.col("_k").alias("_kp"), *[F.col(x).alias(f"_p_{x}") for x in more])
    parts = max(1, -(-p.count() * t.count() // PRODUCT))
    q = t.select(F.col("term").alias("_q"), "asked", F.col("_k").alias("_kq"), *[F.col(x).alias(f"_q_{x}") for x in more]).repartition(parts)
    both = q.join(p, (F.col("_p") != F.col("_q")) & (~F.col("asked") | (F.col("_p") < F.col("_q")))).join(found, ["_kp", "_kq"])
    first = F.col("_p") < F.col("_q")
    ends = [F.when(first, F.col(f"_{u}_{x}")).otherwise(F.col(f"_{v}_{x}")).alias(f"{x}_{n}") for x in more for n, u, v in (("a", "p", "q"), ("b", "q", "p"))]
    both = both.select(F.least("_p", "_q").alias("a"), F.greatest("_p", "_q").alias("b"), *values, *ends)
    own = t.where("asked").select(F.col("term").alias("a"), F.col("term").alias("b"))
    own = measure(own).join(t.select(F.col("term").alias("a"), *more), "a").select("a", "b", *values, *[F.col(x).alias(f"{x}_{n}") for x in more for n in "ab"])
    return both.union(own)


def lowest_common_ancestor(c: DataFrame, depths: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, lca, depth): the deepest shared ancestor, the first by name of equally deep ones."""
    t = shared(c, pairs).join(depths.withColumnRenamed("term", "ancestor"), "ancestor")
    best = t.groupBy("a", "b").agg(F.min(F.struct((-F.col("depth")).alias("d"), "ancestor")).alias("m"))
    return best.select("a", "b", F.col("m.ancestor").alias("lca"), (-F.col("m.d")).alias("depth"))


def information_content(c: DataFrame, annotations: DataFrame, edges: DataFrame) -> DataFrame:
    """(term, ic): -ln of the share of annotations at the term or below; a root without any counts 1; terms without any have no row."""
    return information_content_of(c, annotations.groupBy("term").agg(F.count("*").alias("n")), edges)


def information_content_of(c: DataFrame, n: DataFrame, edges: DataFrame) -> DataFrame:
    """information_content from the number of annotations of each term (term, n)."""
    total = c.join(n, "term").groupBy(F.col("ancestor").alias("term")).agg(F.sum("n").alias("n"))
    top = total.join(roots(edges), "term", "left_semi").agg(F.coalesce(F.max("n"), F.lit(1)).alias("_all"))
    return total.crossJoin(F.broadcast(top)).select("term", (-F.ln(F.col("n") / F.col("_all"))).alias("ic"))  # one row


def path_counts(edges: DataFrame) -> DataFrame:
    """(term, ancestor, paths): number of paths, one to itself. A cycle is an error.

    With A the matrix of edges the sum of its powers is the product of (1 + A), (1 + A^2), (1 + A^4) and so on; counts of a
    pair are summed in each round, so that paths are never listed.
    """
    e = edges.select(F.col("child").alias("term"), F.col("parent").alias("ancestor")).where("term IS NOT NULL AND ancestor IS NOT NULL").distinct()
    power = stored(e.withColumn("paths", F.lit(1).cast("long")), "paths")
    n, total = _acyclic(power), power

    def product(a: DataFrame, b: DataFrame) -> DataFrame:
        through = a.select("term", F.col("ancestor").alias("_via"), F.col("paths").alias("_n")).join(b.select(F.col("term").alias("_via"), "ancestor", "paths"), "_via")
        return through.groupBy("term", "ancestor").agg(F.sum(F.col("_n") * F.col("paths")).alias("paths"))

    while n:
        power = stored(product(power, power), "paths")
        n = power.count()
        if n:
            total = stored(total.union(power).union(product(total, power)).groupBy("term", "ancestor").agg(F.sum("paths").alias("paths")), "paths")
            _acyclic(total)  # all walks of fewer than twice as many edges
    terms = e.select("term").union(e.select("ancestor")).distinct()
    return total.union(terms.select("term", F.col("term").alias("ancestor"), F.lit(1).cast("long").alias("paths")))


def information_content_paths(edges: DataFrame, annotations: DataFrame) -> DataFrame:
    """(term, ic) where each child's total is added to every parent: an annotation counts once per path."""
    n = annotations.groupBy("term").agg(F.count("*").alias("n"))
    total = path_counts(edges).join(n, "term").groupBy(F.col("ancestor").alias("term")).agg(F.sum(F.col("n") * F.col("paths")).alias("n"))
    top = total.join(roots(edges), "term", "left_semi").agg(F.coalesce(F.max("n"), F.lit(1)).alias("_all"))
    return total.crossJoin(F.broadcast(top)).select("term", (-F.ln(F.col("n") / F.col("_all"))).alias("ic"))  # one row


def _with_ic(s: DataFrame, ic: DataFrame) -> DataFrame:
    return s.join(ic.withColumnRenamed("term", "ancestor"), "ancestor")


def mica(c: DataFrame, ic: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, mica): the largest information content of a shared ancestor, 0 at least."""
    t = _with_ic(shared(c, pairs), ic).groupBy("a", "b").agg(F.greatest(F.max("ic"), F.lit(0.0)).alias("mica"))
    return pairs.select("a", "b").join(t, ["a", "b"], "left").withColumn("mica", F.coalesce("mica", F.lit(0.0)))


def mean_shared(c: DataFrame, ic: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, info): mean information content of all shared ancestors."""
    return _with_ic(shared(c, pairs), ic).groupBy("a", "b").agg(F.avg("ic").alias("info"))


def exclusive_inherited(edges: DataFrame, c: DataFrame, ic: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, info): mean over shared ancestors that have a child in exactly one of the two ancestor sets."""
    s = shared(c, pairs)
    own = lambda side: pairs.select("a", "b").join(c.select(F.col("term").alias(side), F.col("ancestor").alias("child")), side).select("a", "b", "child")
    one = own("a").union(own("b")).groupBy("a", "b", "child").agg(F.count("*").alias("k")).where("k = 1").where("a <> b")
    t = one.join(edges, "child").select("a", "b", F.col("parent").alias("ancestor")).distinct().join(s, ["a", "b", "ancestor"], "left_semi")
    same = s.where("a = b AND ancestor = a")
    return _with_ic(t.unionByName(same), ic).groupBy("a", "b").agg(F.avg("ic").alias("info"))


def frontier(edges: DataFrame, c: DataFrame, ic: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, info): mean over shared ancestors that an edge enters from a term that isn't shared; of a term with itself, its own."""
    s = shared(c, pairs)
    own = lambda side: pairs.select("a", "b").join(c.select(F.col("term").alias(side), F.col("ancestor").alias("child")), side).select("a", "b", "child")
    apart = own("a").union(own("b")).distinct().join(s.withColumnRenamed("ancestor", "child"), ["a", "b", "child"], "left_anti")
    t = apart.join(edges, "child").select("a", "b", F.col("parent").alias("ancestor")).distinct().join(s, ["a", "b", "ancestor"], "left_semi")
    whole = s.where("ancestor = a OR ancestor = b")
    return _with_ic(t.unionByName(whole).distinct(), ic).groupBy("a", "b").agg(F.avg("ic").alias("info"))


def disjoint_common(edges: DataFrame, c: DataFrame, ic: DataFrame, pairs: DataFrame, adjusted: bool = False) -> DataFrame:
    """(a, b, info): mean information content of the disjoint common ancestors of two terms.

    Shared ancestors are visited from the highest content down; one stays if, against every one kept before, it is
    disjoint in a or in b: x is disjoint from y in t when paths(t, x) >= paths(t, y) * paths(y, x), > if adjusted.
    """
    n = path_counts(edges)
    s = _with_ic(shared(c, pairs), ic)
    up = n.select(F.col("term").alias("_y"), F.col("ancestor").alias("_x"), F.col("paths").alias("_p"))
    of = lambda side: n.select(F.col("term").alias(side), "ancestor", F.col("paths").alias(f"_{side}"))
    s = s.join(of("a"), ["a", "ancestor"]).join(of("b"), ["b", "ancestor"])
    inner = s.select("a", "b", F.col("ancestor").alias("_y")).join(up, "_y").join(s.select("a", "b", F.col("ancestor").alias("_x")), ["a", "b", "_x"], "left_semi")
    between = inner.groupBy("a", "b").agg(F.collect_list(F.struct("_x", "_y", "_p")).alias("between"))
    nodes = s.groupBy("a", "b").agg(F.collect_list(F.struct((-F.col("ic")).alias("minus"), F.col("ancestor").alias("t"), "_a", "_b")).alias("nodes"))

    def fold(batches):
        import pandas as pd

        for rows in batches:
            out = []
            for a, b, every, inside in zip(rows["a"], rows["b"], rows["nodes"], rows["between"], strict=True):
                p = {(x["_x"], x["_y"]): x["_p"] for x in inside}
                kept: list = []
                for x in sorted(every, key=lambda v: (v["minus"], v["t"])):
                    def apart(y, side, x=x):
                        bound = y[side] * p.get((x["t"], y["t"]), 0)
                        return x[side] > bound if adjusted else x[side] >= bound
                    if all(apart(y, "_a") or apart(y, "_b") for y in kept):
                        kept.append(x)
                out.append((a, b, -sum(v["minus"] for v in kept) / len(kept)))
            yield pd.DataFrame(out, columns=["a", "b", "info"])

    kind = pairs.schema["a"].dataType.simpleString()
    return nodes.join(between, ["a", "b"]).mapInPandas(fold, f"a {kind}, b {kind}, info double")


def _pair_ic(c: DataFrame, ic: DataFrame, pairs: DataFrame) -> DataFrame:
    side = lambda n: ic.select(F.col("term").alias(n), F.col("ic").alias(f"ic_{n}"))
    t = mica(c, ic, pairs).join(side("a"), "a", "left").join(side("b"), "b", "left")
    return t.crossJoin(F.broadcast(ic.agg(F.max("ic").alias("max_ic"))))  # one row


def resnik() -> Column:
    return F.when(F.col("max_ic") > 0, F.col("mica") / F.col("max_ic")).otherwise(0.0)


def lin() -> Column:
    total = F.col("ic_a") + F.col("ic_b")
    return F.when(F.col("a") == F.col("b"), 1.0).when(total > 0, 2 * F.col("mica") / total).otherwise(0.0)


def relevance() -> Column:
    total = F.col("ic_a") + F.col("ic_b")
    return F.when((total > 0) & (F.col("mica") > 0), 2 * F.col("mica") / total * (1 - F.exp(-F.col("mica")))).otherwise(0.0)


def jiang_conrath() -> Column:
    apart = F.col("ic_a") + F.col("ic_b") - 2 * F.col("mica")
    known = F.col("ic_a").isNotNull() & F.col("ic_b").isNotNull() & (F.col("max_ic") > 0)
    return F.when(known, 1 - F.least(apart / F.col("max_ic"), F.lit(1.0))).otherwise(0.0)


def jiang_conrath_alternative() -> Column:
    apart = F.col("ic_a") + F.col("ic_b") - 2 * F.col("mica")
    known = F.col("ic_a").isNotNull() & F.col("ic_b").isNotNull() & (F.col("max_ic") > 0)
    return F.when(F.col("a") == F.col("b"), 1.0).when(known, 1 - apart / (2 * F.col("max_ic"))).otherwise(0.0)


MEASURES: dict[str, Callable[[], Column]] = {"resnik": resnik, "lin": lin, "relevance": relevance, "jiang_conrath": jiang_conrath, "jiang_conrath_alternative": jiang_conrath_alternative}


def similarity(c: DataFrame, ic: DataFrame, pairs: DataFrame, measures: Sequence[str] = tuple(MEASURES)) -> DataFrame:
    """(a, b, one column per measure)."""
    return _pair_ic(c, ic, pairs).select("a", "b", *[MEASURES[m]().alias(m) for m in measures])


def similarity_among(c: DataFrame, ic: DataFrame, terms: DataFrame, measures: Sequence[str] = tuple(MEASURES)) -> DataFrame:
    """similarity of all pairs of an asked term with a term, from terms (term, asked)."""
    t = among(c, terms.select("term", "asked").join(ic, "term", "left"), lambda pairs: mica(c, ic, pairs))
    t = t.crossJoin(F.broadcast(ic.agg(F.max("ic").alias("max_ic"))))  # one row
    return t.select("a", "b", *[MEASURES[m]().alias(m) for m in measures])


def pekar_staab(edges: DataFrame, c: DataFrame, pairs: DataFrame) -> DataFrame:
    """Depth of the lowest common ancestor over itself plus the distances of both terms to it."""
    d = depth(edges, c)
    t = lowest_common_ancestor(c, d, pairs)
    side = lambda n: c.select(F.col("term").alias(n), F.col("ancestor").alias("lca"), F.col("distance").alias(f"d{n}"))
    t = t.join(side("a"), ["a", "lca"]).join(side("b"), ["b", "lca"])
    whole = F.col("da") + F.col("db") + F.col("depth")
    return t.select("a", "b", F.when(whole > 0, F.col("depth") / whole).otherwise(0.0).alias("pekar_staab"))


def _best(sets: DataFrame, pairs: DataFrame, sims: DataFrame, measure: str) -> DataFrame:
    x = sets.select(F.col("set").alias("x"), F.col("term").alias("a"))
    y = sets.select(F.col("set").alias("y"), F.col("term").alias("b"))
    both = sims.select("a", "b", F.col(measure).alias("s")).union(sims.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), F.col(measure)))
    return pairs.select("x", "y").join(x, "x").join(y, "y").join(both, ["a", "b"], "left").withColumn("s", F.coalesce("s", F.lit(0.0)))


def set_similarity(sets: DataFrame, pairs: DataFrame, sims: DataFrame, measure: str) -> DataFrame:
    """(x, y, pair_average, pair_maximum, best_match_average, average_best_match) of term sets (set, term), from sims (a <= b)."""
    t = _best(sets, pairs, sims, measure)
    rows = t.groupBy("x", "y", "a").agg(F.max("s").alias("m"))
    cols = t.groupBy("x", "y", "b").agg(F.max("s").alias("m"))
    r = rows.groupBy("x", "y").agg(F.avg("m").alias("_ra"), F.sum("m").alias("_rs"), F.count("*").alias("_rn"))
    k = cols.groupBy("x", "y").agg(F.avg("m").alias("_ca"), F.sum("m").alias("_cs"), F.count("*").alias("_cn"))
    o = t.groupBy("x", "y").agg(F.avg("s").alias("pair_average"), F.max("s").alias("pair_maximum"))
    t = o.join(r, ["x", "y"]).join(k, ["x", "y"])
    return t.select("x", "y", "pair_average", "pair_maximum", ((F.col("_ra") + F.col("_ca")) / 2).alias("best_match_average"), ((F.col("_rs") + F.col("_cs")) / (F.col("_rn") + F.col("_cn"))).alias("average_best_match"))


def _values(measure: str, same: np.ndarray, m: np.ndarray, x: np.ndarray, y: np.ndarray, top: float) -> np.ndarray:
    """MEASURES over matrices; nan stands for an unknown information content."""
    total = x[:, None] + y[None, :]
    known = ~np.isnan(total) & (top > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        if measure == "resnik":
            return m / top if top > 0 else np.zeros(m.shape)
        if measure == "lin":
            return np.where(same, 1.0, np.where(total > 0, 2 * m / total, 0.0))
        if measure == "relevance":
            return np.where((total > 0) & (m > 0), 2 * m / total * (1 - np.exp(-m)), 0.0)
        if measure == "jiang_conrath":
            return np.where(known, 1 - np.minimum((total - 2 * m) / top, 1.0), 0.0)
        return np.where(same, 1.0, np.where(known, 1 - (total - 2 * m) / (2 * top), 0.0))


#: Cells of a matrix of two sets that are held at once.
CELLS = 1 << 21


def _compared(a: tuple, b: tuple, measure: str, top: float) -> tuple[float, float, float, float]:
    """The four figures of set_similarity of two sets (terms, their content, number of their ancestors, those, their content)."""
    (ta, ia, na, ka, va), (tb, ib, nb, kb, _) = a, b
    ra, rb = np.repeat(np.arange(len(ta)), na), np.repeat(np.arange(len(tb)), nb)
    common, first = np.unique(ka, return_index=True)
    both = np.isin(common, kb)
    common, worth = common[both], va[first[both]]
    met = [(w, np.sort(ra[ka == k]), rb[kb == k]) for w, k in sorted(zip(worth.tolist(), common.tolist(), strict=True)) if w > 0]  # the largest is written last
    step, total, rows, best, cols = max(1, CELLS // len(tb)), 0.0, [], 0.0, np.zeros(len(tb))
    for lo in range(0, len(ta), step):
        m = np.zeros((min(step, len(ta) - lo), len(tb)))
        for w, i, j in met:
            m[np.ix_(i[np.searchsorted(i, lo) : np.searchsorted(i, lo + step)] - lo, j)] = w
        part = slice(lo, lo + len(m))
        v = _values(measure, (ta[part, None] == tb) & (ta[part, None] >= 0), m, ia[part], ib, top)
        total, cols = total + float(v.sum()), np.maximum(cols, v.max(0)) if lo else v.max(0)
        rows.append(v.max(1))
    r = np.concatenate(rows)
    return total / (len(ta) * len(tb)), float(r.max()), float(r.mean() + cols.mean()) / 2, float(r.sum() + cols.sum()) / (len(ta) + len(tb))


def _arrays(sets: DataFrame, pairs: DataFrame, c: DataFrame, ic: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs, and (set, t, i, n, k, v) of the sets in them: numbers of a set's terms (-1 for null), their content (nan if
    unknown) and how many ancestors each has; those ancestors' numbers and content (0 if unknown) one term after the other."""
    asked = pairs.select("x", "y").distinct()
    s = sets.select("set", "term").join(asked.select(F.col("x").alias("set")).union(asked.select("y")).distinct(), "set", "left_semi")
    number = stored(c.select("term").union(c.select("ancestor")).union(sets.select("term")).where("term IS NOT NULL").distinct().withColumn("_id", F.monotonically_increasing_id()), "numbers")
    of = ic.withColumnRenamed("term", "ancestor")
    up = c.select("term", "ancestor").join(of, "ancestor", "left").join(number.withColumnsRenamed({"term": "ancestor", "_id": "_k"}), "ancestor")
    up = up.groupBy("term").agg(F.collect_list(F.struct("_k", F.coalesce("ic", F.lit(0.0)).alias("_v"))).alias("_up"))
    none = F.array().cast("array<struct<_k:bigint,_v:double>>")
    known = stored(number.join(ic, "term", "left").join(up, "term", "left"), "ancestors")
    term = F.struct(F.coalesce("_id", F.lit(-1)).alias("t"), F.coalesce("ic", F.lit(float("nan"))).alias("i"), F.coalesce("_up", none).alias("up"))
    per = s.join(known, "term", "left").groupBy("set").agg(F.collect_list(term).alias("_l"))
    ups = F.flatten(F.transform("_l", lambda e: e["up"]))
    per = per.select("set", F.transform("_l", lambda e: e["t"]).alias("t"), F.transform("_l", lambda e: e["i"]).alias("i"), F.transform("_l", lambda e: F.size(e["up"])).alias("n"), F.transform(ups, lambda e: e["_k"]).alias("k"), F.transform(ups, lambda e: e["_v"]).alias("v"))
    return asked, stored(per, "sets")


def _folded(asked: DataFrame, per: DataFrame, how: str, figures: Sequence[str], compare: Callable[[tuple, tuple], tuple]) -> DataFrame:
    """(x, y, figures): compare of the arrays of both sets of each pair; with how = left sets without terms are empty arrays."""
    names = ("t", "i", "n", "k", "v")
    side = lambda n: per.select(F.col("set").alias(n), *[F.col(f).alias(f"_{n}{f}") for f in names])
    t = asked.join(side("x"), "x", how).join(side("y"), "y", how)
    t = t.select("x", "y", *[F.coalesce(f"_{n}{f}", F.array().cast(per.schema[f].dataType)).alias(f"_{n}{f}") for n in "xy" for f in names])

    def fold(batches):
        import pyarrow as pa

        for batch in batches:
            lists = {n: [(batch.column(f"_{n}{f}").offsets.to_numpy(), batch.column(f"_{n}{f}").values.to_numpy(zero_copy_only=False)) for f in names] for n in "xy"}
            cut = lambda n, r: tuple(v[o[r] : o[r + 1]] for o, v in lists[n])  # noqa: E731, B023
            out = [compare(cut("x", r), cut("y", r)) for r in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y"), *(pa.array([o[i] for o in out], pa.float64()) for i in range(len(figures)))], ["x", "y", *figures])

    kind = lambda n: asked.schema[n].dataType.simpleString()
    return t.mapInArrow(fold, f"x {kind('x')}, y {kind('y')}, " + ", ".join(f"{f} double" for f in figures))


def set_similarity_of(sets: DataFrame, pairs: DataFrame, c: DataFrame, ic: DataFrame, measure: str) -> DataFrame:
    """set_similarity with the measure of two terms worked out from their ancestors, a matrix for each pair of sets.

    A set goes to its pairs as arrays of its terms and their ancestors; pairs of terms are never rows.
    """
    asked, per = _arrays(sets, pairs, c, ic)
    top = ic.agg(F.max("ic").alias("m")).first().m or 0.0
    return _folded(asked, per, "inner", ("pair_average", "pair_maximum", "best_match_average", "average_best_match"), lambda x, y: _compared(x, y, measure, top))


def _overlap(a: tuple, b: tuple) -> tuple[float, float, float, float, float]:
    """The five figures of graph_similarity of two sets as in _arrays."""
    terms = [np.unique(s[0]) for s in (a, b)]
    ups = [np.unique(s[3], return_index=True) for s in (a, b)]
    over = lambda x, y: float(x / y) if y > 0 else 0.0
    shared = np.intersect1d(*terms, assume_unique=True)
    t = int((shared >= 0).sum())
    both = np.isin(ups[0][0], ups[1][0], assume_unique=True)
    (nx, x), (ny, y) = ((len(k), float(s[4][i].sum())) for s, (k, i) in zip((a, b), ups, strict=True))
    n, w = int(both.sum()), float(a[4][ups[0][1][both]].sum())
    return over(t, len(terms[0]) + len(terms[1]) - t), over(n, nx + ny - n), over(w, x + y - w), over(2 * w, x + y), over(w, max(x, y))


def graph_similarity(sets: DataFrame, pairs: DataFrame, c: DataFrame, ic: DataFrame) -> DataFrame:
    """(x, y, jaccard, ui, gic, dic, uic): on the terms themselves, on their ancestors, and on ancestors weighted by information content."""
    return _folded(*_arrays(sets, pairs, c, ic), "left", ("jaccard", "ui", "gic", "dic", "uic"), _overlap)


def gene_best(scores: DataFrame, candidate: str = "x", reference: str = "y", measure: str = "best_match_average") -> DataFrame:
    """Per candidate its best reference and the score; the first by name of equal ones."""
    return scores.groupBy(candidate).agg(F.min(F.struct((-F.col(measure)).alias("s"), F.col(reference).alias("r"))).alias("m")).select(candidate, F.col("m.r").alias(reference), (-F.col("m.s")).alias(measure))


def combined(mf: Column, bp: Column) -> Column:
    """(mf^2 + bp^2) / 2."""
    return (mf * mf + bp * bp) / 2


def enrichment(c: DataFrame, annotations: DataFrame, sample: DataFrame, compat: bool = True) -> DataFrame:
    """(term, population, shared, p): hypergeometric upper tail of the sample's genes at a term or below.

    population: genes of the term. With compat the tail starts behind k where k is the smallest possible count. Terms that share no gene have p 1.
    """
    from ..functions.stats import hypergeometric_tail, vectorised

    g = annotations.select("gene", "term").distinct()
    at = g.join(c, "term").select("gene", F.col("ancestor").alias("term")).distinct()
    genes = g.select("gene").distinct().agg(F.count("*").alias("genes"))
    s = sample.select("gene").distinct().join(g.select("gene"), "gene", "left_semi")
    size = s.agg(F.count("*").alias("drawn"))
    t = at.groupBy("term").agg(F.count("*").alias("population"))
    hits = at.join(s, "gene", "left_semi").groupBy("term").agg(F.count("*").alias("shared"))
    t = t.join(hits, "term", "left").fillna({"shared": 0}).crossJoin(F.broadcast(genes)).crossJoin(F.broadcast(size))  # one row each
    genes, drawn, population, hit = (F.col(x) for x in ("genes", "drawn", "population", "shared"))
    least = F.greatest(F.lit(0), drawn + population - genes)
    first = F.greatest(hit, least + 1) if compat else hit
    tail = vectorised(lambda *x: hypergeometric_tail(*map(int, x)))(*[x.cast("double") for x in (first, population, drawn, genes)])
    return t.select("term", "population", "shared", F.when(hit == 0, 1.0).otherwise(tail).alias("p"))


def annotation_counts(annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Terms per gene and genes per term."""
    g = annotations.select("gene", "term").distinct()
    return g.groupBy("gene").agg(F.count("*").alias("terms")), g.groupBy("term").agg(F.count("*").alias("genes"))


def components(edges: DataFrame) -> DataFrame:
    """(term, component): smallest term reachable over edges in either direction.

    Each round a term takes the smallest label of itself and its neighbours, and then the label of that label, until none
    changes; the second step halves long chains.
    """
    both = edges.select(F.col("child").alias("a"), F.col("parent").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    both = stored(both.union(both.select("b", "a")).distinct(), "edges")
    label = stored(both.select(F.col("a").alias("term")).distinct().withColumn("component", F.col("term")), "labels")
    while True:
        near = both.join(label.withColumnRenamed("term", "b"), "b").groupBy(F.col("a").alias("term")).agg(F.min("component").alias("_m"))
        least = label.join(near, "term").select("term", F.least("component", "_m").alias("_m"), F.col("component").alias("_was"))
        jump = label.select(F.col("term").alias("_m"), F.col("component").alias("_j"))
        new = stored(least.join(jump, "_m").select("term", F.least("_m", "_j").alias("component"), "_was"), "labels")
        label = new.drop("_was")
        if new.where("component <> _was").isEmpty():
            return label


def ranked(df: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.col(column).desc())))


