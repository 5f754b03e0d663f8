"""Operators that SQL can't express, or whose limits matter, against brute force on small tables."""

import gzip
import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from genoquill.functions import sequence as S
from genoquill.operators import analysis as X
from genoquill.operators import features as R
from genoquill.operators import inbreeding as B
from genoquill.operators import joins as J
from genoquill.operators import mutation as M
from genoquill.operators import ontology as G
from genoquill.operators import ordered as O
from genoquill.sources import formats

EDGE = "child string, parent string"


def graph(rng, n):
    return sorted({(f"t{i}", f"t{rng.randrange(i)}") for i in range(1, n) for _ in range(rng.randint(1, 3))})


def ancestors(edges):
    up = {}
    for c, p in edges:
        up.setdefault(c, set()).add(p)
        up.setdefault(p, set())
    dist, paths = {}, {}
    for t in up:
        dist[t, t], level, d = 0, {t: 1}, 0
        total = {t: 1}
        while level:
            new = {}
            for x, k in level.items():
                for y in up[x]:
                    new[y] = new.get(y, 0) + k
            d += 1
            for y, k in new.items():
                dist.setdefault((t, y), d)
                total[y] = total.get(y, 0) + k
            level = new
        paths.update({(t, y): k for y, k in total.items()})
    return dist, paths


def test_closure_and_paths(spark):
    edges = graph(random.Random(3), 40) + [(f"c{i + 1}", f"c{i}") for i in range(120)]
    dist, paths = ancestors(edges)
    e = spark.createDataFrame(edges, EDGE)
    assert {(r.term, r.ancestor): r.distance for r in G.closure(e).collect()} == dist
    assert {(r.term, r.ancestor): r.paths for r in G.path_counts(e).collect()} == paths


@pytest.mark.parametrize("loop", [[("a", "a")], [("a", "b"), ("b", "a")], [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "a"), ("x", "a")]])
def test_cycles_are_errors(spark, loop):
    e = spark.createDataFrame(loop, EDGE)
    for f in (G.closure, G.path_counts):
        with pytest.raises(ValueError):
            f(e)


def test_a_closure_of_over_a_million_pairs(spark):
    e = spark.range(20_000).select(F.concat(F.lit("t"), "id").alias("child"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(59)), lambda k: F.concat(F.lit("p"), k.cast("string")))).alias("parent"))
    assert G.closure(e).count() == 20_000 * 61 + 60


def test_components_of_many_parts(spark):
    rng = random.Random(5)
    edges = [(f"a{i + 1:03}", f"a{i:03}") for i in range(90)] + [(f"b{rng.randrange(9)}", f"b{rng.randrange(9)}") for _ in range(20)] + [("z1", "z2")]
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert {r.term: r.component for r in G.components(spark.createDataFrame(edges, EDGE)).collect()} == label


def test_disjoint_common_ancestors(spark):
    edges = graph(random.Random(8), 14)
    _, paths = ancestors(edges)
    terms = sorted({t for t, _ in paths})
    ic = {t: round(math.log(1 + len([1 for (a, b) in paths if a == t])), 6) for t in terms}
    e = spark.createDataFrame(edges, EDGE)
    asked = [(a, b) for a, b in itertools.combinations(terms, 2)]
    pairs, weights = spark.createDataFrame(asked, "a string, b string"), spark.createDataFrame(list(ic.items()), "term string, ic double")
    for adjusted in (False, True):
        want = {}
        for a, b in asked:
            kept = []
            for x in sorted((t for t in terms if (a, t) in paths and (b, t) in paths), key=lambda t: (-ic[t], t)):
                far = lambda y, s: (paths[s, x] > paths[s, y] * paths.get((y, x), 0)) if adjusted else (paths[s, x] >= paths[s, y] * paths.get((y, x), 0))  # noqa: E731, B023
                if all(far(y, a) or far(y, b) for y in kept):
                    kept.append(x)
            want[a, b] = sum(ic[t] for t in kept) / len(kept)
        got = {(r.a, r.b): r.info for r in G.disjoint_common(e, G.closure(e), weights, pairs, adjusted).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_pairs_by_classes_of_terms(spark):
    """Pairs looked up by the classes of their terms against each pair measured by itself."""
    rnd = random.Random(4)
    edges = graph(rnd, 12)
    inner = sorted({p for _, p in edges})
    for i in range(25):  # leaves that share their parents, some of them with an edge past a parent
        edges += [(f"leaf{i}", p) for p in rnd.sample(inner[:4], 1 + i % 2)]
    edges = sorted(set(edges))
    terms = sorted({t for e in edges for t in e})
    e = spark.createDataFrame(edges, EDGE)
    c = G.closure(e)
    ic = spark.createDataFrame([(t, 0.5 + k / 7) for k, t in enumerate(terms) if k % 9], "term string, ic double")
    asked = set(terms[::3])
    t = spark.createDataFrame([(x, x in asked) for x in [*terms, "unknown"]], "term string, asked boolean")
    asked_pairs = sorted({(min(x, y), max(x, y)) for x in asked for y in [*terms, "unknown"]})
    pairs = spark.createDataFrame(asked_pairs, "a string, b string")
    assert G.classes(c).select("low").distinct().count() < len(terms)
    for f in (lambda p: G.frontier(e, c, ic, p), lambda p: G.disjoint_common(e, c, ic, p), lambda p: G.pekar_staab(e, c, p)):
        got, want = (sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in x.select(sorted(x.columns)).collect()) for x in (G.among(c, t, f), f(pairs)))
        assert got == want
    got, want = G.similarity_among(c, ic, t), G.similarity(c, ic, pairs)
    got, want = (sorted((r.a, r.b, *[round(r[m], 9) for m in G.MEASURES]) for r in x.collect()) for x in (got, want))
    assert got == want and len(got) == len(asked_pairs)


def test_sets_by_ancestors(spark, monkeypatch):
    """Matrices of two sets against the pairs of their terms, the matrices whole and cut to a row."""
    rnd = random.Random(6)
    edges = graph(rnd, 20)
    terms = [f"t{i}" for i in range(20)] + ["unknown"]
    c = G.closure(spark.createDataFrame(edges, EDGE))
    ic = spark.createDataFrame([(t, k / 7) for k, t in enumerate(terms[:20]) if k % 6], "term string, ic double")
    sets = spark.createDataFrame([(f"s{i}", t) for i in range(6) for t in rnd.sample(terms, 1 + 2 * i)], "set string, term string")
    pairs = spark.createDataFrame([(f"s{i}", f"s{j}") for i in range(6) for j in (1, 4, 5)], "x string, y string")
    all_pairs = spark.createDataFrame(list(itertools.combinations_with_replacement(sorted(terms), 2)), "a string, b string")
    for measure, cells in (("lin", G.CELLS), ("jiang_conrath", 1)):
        monkeypatch.setattr(G, "CELLS", cells)
        whole = [G._compared((np.arange(3), np.ones(3), np.ones(3, int), np.array([7, 8, 7]), np.array([0.5, 0.9, 0.5])), (np.arange(1, 3), np.ones(2), np.ones(2, int), np.array([8, 7]), np.array([0.9, 0.5])), measure, 2.0)]
        assert whole[0][1] == (1.0 if measure == "lin" else 0.9)
        rows = [sorted((r.x, r.y, *[round(v, 9) for v in r[2:]]) for r in t.collect()) for t in (G.set_similarity_of(sets, pairs, c, ic, measure), G.set_similarity(sets, pairs, G.similarity(c, ic, all_pairs, [measure]), measure))]
        assert rows[0] == rows[1] and len(rows[0]) == 18


def test_graph_similarity_by_hand(spark):
    """Sets with a term twice, with unknown and with no terms."""
    c = G.closure(spark.createDataFrame([("a", "r"), ("b", "r"), ("d", "a")], EDGE))
    ic = spark.createDataFrame([("r", 0.0), ("a", 1.0), ("b", 2.0)], "term string, ic double")
    sets = spark.createDataFrame([("s", "a"), ("s", "a"), ("s", "b"), ("t", "d"), ("t", "new"), ("u", None)], "set string, term string")
    pairs = spark.createDataFrame([("s", "t"), ("s", "s"), ("s", "none"), ("t", "u"), ("u", "u")], "x string, y string")
    got = {(r.x, r.y): tuple(r)[2:] for r in G.graph_similarity(sets, pairs, c, ic).collect()}
    assert got == {("s", "t"): (0.0, 0.5, 1 / 3, 0.5, 1 / 3), ("s", "s"): (1.0,) * 5, ("s", "none"): (0.0,) * 5, ("t", "u"): (0.0,) * 5, ("u", "u"): (0.0,) * 5}
    assert "_xt" in G.graph_similarity(sets, pairs, c, ic)._jdf.queryExecution().optimizedPlan().toString()  # sets meet as arrays


def test_near_genes_are_counted(spark):
    """Totals against the list of pairs: shared places, a gene at several places, unknown names; and no join of the genes themselves."""
    rnd = random.Random(2)
    rows = [(f"c{rnd.randrange(2)}", f"g{rnd.randrange(25)}", rnd.randrange(-20, 40)) for _ in range(80)] + [("c0", None, 3), ("c0", "g1", None)]
    genes = spark.createDataFrame(rows, "contig_id string, gene_id string, lower long")
    for distance in (1, 5):
        pairs = [abs(x[2] - y[2]) for x in rows[:80] for y in rows[:80] if x[0] == y[0] and x[1] != y[1] and abs(x[2] - y[2]) <= distance]
        assert tuple(J.proximity_totals(genes, distance).first()) == (len(pairs), sum(pairs))
        assert J.proximity(genes, distance).count() == len(pairs)
    assert tuple(J.proximity_totals(genes.limit(1), 5).first()) == (0, None)


def test_repeated_work_is_done_once(spark):
    """Texts aligned, values weighed and places looked up once for equal rows, with the same results."""
    before = S._items.cache_info()
    t = S.edits.func(pd.Series(["ring"] * 50), pd.Series(["rung"] * 50))
    assert t.tolist() == [[{"pos": 1, "ref": "i", "alt": "u"}]] * 50 and S._items.cache_info().hits >= before.hits + 49
    rows = [("k", i % 7) for i in range(40)]
    whole, counted = spark.createDataFrame(rows, "g string, v long"), spark.createDataFrame(sorted((*k, rows.count(k)) for k in set(rows)), "g string, v long, w long")
    ps = [0.0, 0.3, 0.5, 0.9, 1.0]
    assert sorted(O.percentiles(counted, "v", ps, ["g"], "w").collect()) == sorted(O.percentiles(whole, "v", ps, ["g"]).collect())
    contigs = spark.createDataFrame([("c", "ACGTACGTAC")], "contig_id string, sequence string")
    at = [("c", 2, 5), ("c", 2, 5), ("c", 2, 1), ("c", 8, 9), ("c", -1, 2), ("c", 3, 0), ("x", 1, 1), ("c", None, 1)]
    got = J.reference_at(spark.createDataFrame(at, "contig_id string, pos long, n int"), contigs, "pos", "n", 3)
    assert sorted(((r.contig_id, r.pos, r.n), r._reference) for r in got.collect() if r.pos is not None) == sorted(zip(at[:7], ["GTACG", "GTACG", "G", "AC", "", "", None], strict=True))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_row" not in plan and got.count() == 8


@pytest.mark.parametrize("by", [(), ("k",)])
def test_percentiles_and_slices(spark, by):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.choice([1.0, 2.0, 2.0, 2.0, 3.5, rng.random() * 9, None]), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, v double, i int")
    groups = {}
    for k, v, i in rows:
        if v is not None:
            groups.setdefault((k,) if by else (), []).append((v, i))
    index = lambda n, p: max(0, min(n - 1, math.floor(n * p - 0.5 + 0.5) if n * p >= 0.5 else -math.floor(-(n * p - 0.5) + 0.5)))
    got = {(tuple(r[c] for c in by), r.p): r.value for r in O.percentiles(df, "v", [0.0, 0.1, 0.5, 0.9, 1.0], by).collect()}
    assert got == {(g, p): sorted(v for v, _ in x)[index(len(x), p)] for g, x in groups.items() for p in (0.0, 0.1, 0.5, 0.9, 1.0)}
    part = O.percentile_range(df, "v", 0.25, 0.75, by).collect()
    slices = O.percentile_slice(df, "v", 0.2, 0.6, by).collect()
    for g, x in groups.items():
        v, n = sorted(a for a, _ in x), len(x)
        of = lambda rows: sorted(r.v for r in rows if tuple(r[c] for c in by) == g)  # noqa: B023, E731
        assert of(part) == v[index(n, 0.25) : index(n, 0.75)]
        assert of(slices) == v[math.floor(n * 0.2) : math.floor(n * 0.6) + 1]
    assert len({r.i for r in part}) == len(part) and len({r.i for r in slices}) == len(slices)


def observed(rng, loci=60, genomes=4):
    rows = [(f"g{g}", "c", i, round(0.05 + 0.9 * rng.random(), 3), rng.choice([0, 0, 1, 2])) for g in range(genomes) for i in range(loci)]
    return rows, "genome_id string, contig_id string, pos int, f double, n int"


def test_hall_and_likelihood(spark):
    rows, kind = observed(random.Random(4))
    df = spark.createDataFrame(rows, kind)
    hall = {r.genome_id: r.f_hall for r in B.hall(df).collect()}
    best = {r.genome_id: r.f_likelihood for r in B.log_likelihood(df).collect()}
    for g in hall:
        mine = [(f, n) for i, _, _, f, n in rows if i == g]
        x = 0.5
        for k in range(1000):
            new = sum(x / (x + (1 - f if n == 0 else f) * (1 - x)) for f, n in mine if n != 1) / len(mine)
            done, x = abs(new - x) < 1e-4, new
            if done and k >= 50:
                break
        assert abs(hall[g] - x) < 1e-9
        loss = lambda x: -sum(math.log(max(1e-10, 2 * f * (1 - f) * (1 - x) if n == 1 else (q := 1 - f if n == 0 else f) * q * (1 - x) + q * x)) for f, n in mine)  # noqa: B023, E731
        grid = min(np.linspace(-1, 1, 4001), key=loss)
        assert loss(best[g]) <= loss(grid) + 1e-6


def test_synthetic_shares(spark):
    loci = spark.createDataFrame([("c", i, 0.3) for i in range(4000)], "contig_id string, pos int, f double")
    got = B.synthetic(loci, [0.0, 0.5], per_value=3, seed=5).withColumn("value", B.name_value(F.col("genome_id")))
    for r in got.groupBy("value").agg(F.avg((F.col("n") == 2).cast("int")).alias("two"), F.avg((F.col("n") == 1).cast("int")).alias("one")).collect():
        assert abs(r.two - (0.09 * (1 - r.value) + 0.3 * r.value)) < 0.02 and abs(r.one - 0.42 * (1 - r.value)) < 0.02
    assert got.orderBy("genome_id", "pos").collect() == B.synthetic(loci.repartition(7), [0.0, 0.5], per_value=3, seed=5).withColumn("value", B.name_value(F.col("genome_id"))).orderBy("genome_id", "pos").collect()


def slow_distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        d, old = [i], d
        for j, y in enumerate(b, 1):
            d.append(min(old[j] + 1, d[-1] + 1, old[j - 1] + (x != y)))
    return d[-1]


def test_texts_by_brute_force():
    rng = random.Random(6)
    for _ in range(150):
        a, b = ("".join(rng.choice("ACG") for _ in range(rng.randint(0, 9))) for _ in range(2))
        items = S.edit_items(a, b)
        assert len(items) == slow_distance(a, b)
        out = a
        for pos, ref, alt in reversed(items):
            assert out[pos : pos + len(ref)] == ref
            out = out[:pos] + alt + out[pos + len(ref) :]
        assert out == b
        short, long = sorted((a, b), key=len)
        assert S.infix_distance(a, b) == min(slow_distance(short, long[i:j]) for i in range(len(long) + 1) for j in range(i, len(long) + 1))
        n, i, count = len(a), 0, 0
        while i < n:
            size = 1
            while i + size <= n and a.find(a[i : i + size], 0, i + size - 1) >= 0:
                size += 1
            count, i = count + 1, i + size
        assert S.lz76(a) == count


def test_motif_places_and_hash(spark):
    df = spark.createDataFrame([("TAGCAAATTTGTGGCAAATTTG",), ("",), ("AAAA",)], "s string")
    rows = df.select("s", S.motif_intervals("s", S.A_BOX).alias("m"), S.text_hash("s").alias("h")).collect()
    import zlib

    assert [[(x.lower, x.upper) for x in r.m] for r in rows][1:] == [[], []]
    for x in rows[0].m:
        assert x.upper - x.lower == len(S.A_BOX)
    assert [r.h for r in rows] == [zlib.crc32(r.s.encode()) for r in rows]


def test_offsets_there_and_back(spark):
    base = "ACGTTGCATCGATTACGGAT"
    variants = [("g", "c", 3, "T", "TAA", 1), ("g", "c", 8, "TCGA", "T", 2), ("g", "c", 15, "C", "CG", 3), ("g", "c", 15, "C", "CGG", 4)]
    v = spark.createDataFrame(variants, "genome_id string, contig_id string, pos long, ref string, alt string, vcf_line int")
    shifts = X.indel_shifts(v)
    changed = M.apply_variants(base, 0, [(3, "T", "TAA"), (8, "TCGA", "T"), (15, "C", "CG")])[0]
    loci = spark.createDataFrame([("g", "c", i) for i in range(len(base))], "genome_id string, contig_id string, pos long")
    to = {r.pos: r.modified for r in X.to_modified(loci, shifts).collect()}
    gone = {9, 10, 11}
    assert all(changed[to[i]] == base[i] for i in to if i not in gone and i not in (4, 16))
    own = spark.createDataFrame([("g", "c", i) for i in range(len(changed))], "genome_id string, contig_id string, modified long")
    back = {r.modified: r.original for r in X.to_original(own, shifts).collect()}
    assert all(back[to[i]] == i for i in to if i not in gone and i not in (4, 9, 16))


def test_reference_in_windows(spark):
    rng = random.Random(3)
    text = {c: "".join(rng.choice("ACGT") for _ in range(n)) for c, n in (("a", 500), ("b", 63), ("e", 0))}
    contigs = spark.createDataFrame(list(text.items()), "contig_id string, sequence string")
    asked = [(rng.choice("abex"), rng.randint(-2, 520), rng.randint(0, 200)) for _ in range(200)]
    rows = J.reference_at(spark.createDataFrame(asked, "contig_id string, pos long, n long"), contigs, "pos", F.col("n"), size=64).collect()
    assert sorted((r.contig_id, r.pos, r.n) for r in rows) == sorted(asked)
    for r in rows:
        if r.contig_id == "x":
            assert r._reference is None
        elif r.pos >= 0:
            assert r._reference == text[r.contig_id][r.pos : r.pos + r.n]


def test_trees_of_families(spark):
    m = spark.createDataFrame([("g1", "t", "ACG"), ("g2", "t", "ACG"), ("g3", "t", "TCG"), ("g1", "u", "A"), ("g2", "u", "C"), ("g3", "u", None)], "genome_id string, transcript string, coding string")
    assert sorted((r.i, r.j, r.d) for r in M.genome_distances(m).collect()) == [("g2", "g1", 0.5), ("g3", "g1", 1.0), ("g3", "g2", 1.0)]
    assert [r.d for r in M.family_distances(m, "t").collect()] == [1.0]
    profiles = {r.genome_id: r.profile for r in X.genome_profiles(m.where("transcript = 't'")).collect()}
    assert profiles["g1"] == profiles["g2"] != profiles["g3"]


def test_features_and_introns(spark):
    t = spark.createDataFrame([("c", "g", "t1", "+", [(2, 5), (20, 24)]), ("c", "g", "t2", "-", [(2, 5)])], "contig_id string, gene_id string, transcript string, strand string, exons array<struct<lower:long,upper:long>>")
    text = "AATGA" + "TAGCAAATTTG" + "CCCC" + "GGGG" * 5
    contigs = spark.createDataFrame([("c", text)], "contig_id string, sequence string")
    r = R.intron_statistics(t, contigs, spark.createDataFrame([("g",)], "gene_id string")).collect()
    assert [(x.lower, x.upper, x.size, x.a_boxes) for x in r] == [(5, 20, 15, 1)]
    s = {x.transcript: x.coding for x in R.coding_sequences(t.withColumn("kind", F.lit("PROTEIN")), contigs).collect()}
    assert s == {"t1": text[2:5] + text[20:24], "t2": text[2:5][::-1].translate(str.maketrans("ACGT", "TGCA"))}
    assert R.transcript_of(t, "g", "t2").count() == 1
    with pytest.raises(KeyError):
        R.contig(contigs, "none", required=True)
    f = spark.createDataFrame([("c", "g", "gene", 2, 24, "+")], "contig_id string, feature_id string, type string, lower long, upper long, strand string")
    hit = {x.pos: x.gene_id for x in R.genes_behind(R.gene_map(f), spark.createDataFrame([("c", 3), ("c", 30)], "contig_id string, pos long")).collect()}
    assert hit == {3: "g", 30: None}
    assert f.select(R.feature_text("feature_id", "lower").alias("x")).first().x == "feature_id: g, lower: 2"


def test_regions_are_mutated(spark):
    contigs = spark.createDataFrame([("c", "ACGTACGTACGT")], "contig_id string, sequence string")
    v = spark.createDataFrame([("g", "c", 5, "C", "T", True, 0.5, 1, 1, 1, 1, "")], "genome_id string, contig_id string, pos long, ref string, alt string, pass boolean, af double, vcf_line long, part long, supp long, phase int, identifier string")
    r = M.mutate_regions(v, spark.createDataFrame([("r", "c", 4, 8)], "region string, contig_id string, lower long, upper long"), contigs).collect()
    assert [(x.genome_id, x.region, x.sequence) for x in r] == [("g", "r", "ATGT")]


def test_matrices_and_parameters(spark):
    m = spark.createDataFrame([(1, 0, 2.0)], "i int, j int, d double")
    assert [tuple(r) for r in X.matrix_add(m, m).collect()] == [(1, 0, 4.0)]
    with pytest.raises(ValueError):
        X.matrix_add(m, m.withColumn("i", F.lit(2)))
    assert X.same_parameters([{"a": 1, "b": 2}, {"a": 1, "b": 3}], ["a"]) == {"a": 1}
    with pytest.raises(ValueError):
        X.same_parameters([{"a": 1}, {"a": 2}], ["a"])
    got = X.accumulate(spark.createDataFrame([("x", 1.0), ("x", 3.0), ("y", 5.0)], "k string, v double"), ["k"], lambda v: float(v.max() - v.min()), "double", "v")
    assert {r.k: r.result for r in got.collect()} == {"x": 2.0, "y": 0.0}


def test_block_gzip_takes_linear_time():
    def block(data):
        raw = gzip.compress(data)
        return b"\x1f\x8b\x08\x04" + raw[4:10] + b"\x06\x00BC\x02\x00" + (len(raw) + 7).to_bytes(2, "little") + raw[10:]

    one = block(bytes(range(256)) * 200)
    assert formats.bgzf_verify(one * 3000 + block(b"")) == {"blocks": 3001, "bytes": 3000 * 51_200, "end_marker": True}
