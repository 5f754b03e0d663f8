"""Traps and small frames whose results are known by hand."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from genoquill.functions import cigar, sequence, stats
from genoquill.functions import variants as V
from genoquill.operators import aggregates, filters, mutation, ordered, trees


def frame(spark, rows, order=True):
    return spark.createDataFrame([("G", "C", *r, i, i, i) for i, r in enumerate(rows)], "genome_id string, contig_id string, pos long, ref string, alt string, phase int, af double, vcf_line long, part long, supp long")


def test_variant_kinds(spark):
    rows = [(0, a, b, 1, 0.1) for a, b in (("A", "A"), ("AC", "AT"), ("AC", "GT"), ("A", "AT"), ("AT", "A"), ("ACG", "TCA"), ("AAC", "AAT"), ("CCAGG", "CCA"))]
    t = frame(spark, rows).select("ref", "alt", V.variant_type().alias("k"), V.is_canonical().alias("c"), V.canonical().alias("x"), V.modify_interval().alias("m")).collect()
    assert [r.k for r in t] == ["SNP", "SNP", "DELETE", "INSERT", "DELETE", "DELETE", "SNP", "DELETE"]
    assert [r.c for r in t] == [True, False, False, True, True, False, False, False]
    assert (t[6].x.ref, t[6].x.alt, t[6].x.pos) == ("AC", "AT", 1)
    assert (t[7].x.ref, t[7].x.alt, t[7].x.pos) == ("AGG", "A", 2) and (t[7].m.lower, t[7].m.upper) == (3, 5)


def test_locus_filters(spark):
    rows = [(1, "A", "C", 1, 0.1), (2, "A", "C", 1, 0.1), (2, "A", "C", 2, 0.1), (3, "A", "C", 1, 0.1), (3, "A", "G", 2, 0.1), (4, "A", "C", 1, 0.1), (4, "A", "C", 2, 0.1), (4, "A", "T", 1, 0.1)]
    t = frame(spark, rows)
    at = lambda d: sorted(r.pos for r in d.collect())
    assert at(filters.homozygous_offsets(t)) == [2, 2]
    assert at(filters.heterozygous_offsets(t)) == [1, 3, 3, 4]
    assert at(filters.diploid_offsets(t)) == [1, 2, 2, 3, 3]
    assert at(filters.unique_unphased(t)) == [1, 2, 3, 3, 4, 4]


def test_upstream_deletes_and_coding(spark):
    rows = [(10, "AGGGGG", "A", 1, 0.1), (12, "A", "C", 1, 0.1), (13, "AGGGGGG", "A", 1, 0.1), (17, "A", "C", 1, 0.1), (20, "A", "C", 1, 0.1)]
    assert sorted(r.pos for r in ordered.upstream_deletes(frame(spark, rows)).collect()) == [10, 17, 20]
    rows = [(10, "AT", "A", 1, 0.9), (11, "A", "C", 1, 0.2), (30, "A", "AT", 1, 0.5), (40, "A", "C", 1, 0.5), (40, "A", "G", 1, 0.5)]
    assert sorted((r.pos, r.alt) for r in filters.coding(frame(spark, rows), "highest_af").collect()) == [(10, "A"), (30, "AT"), (40, "G")]


@pytest.mark.parametrize("n", [1, 2, 5, 10])
def test_percentiles(spark, n):
    t = spark.createDataFrame([(float(i),) for i in range(n)], "x double")
    got = {r.p: r.value for r in ordered.percentiles(t, "x", [0.0, 0.1, 0.5, 0.95, 1.0]).collect()}
    away = lambda x: math.copysign(math.floor(abs(x) + 0.5), x)
    assert got == {p: min(max(away(n * p - 0.5), 0), n - 1) for p in (0.0, 0.1, 0.5, 0.95, 1.0)}
    assert ordered.geq_count(t, "x", 99).first()[0] == 1


@pytest.mark.parametrize("name", ["n", "before", "q"])
def test_percentiles_of_a_column_of_any_name(spark, name):
    t = spark.createDataFrame([(i, i % 2) for i in range(10)], f"{name} long, k long")
    assert {r.p: r.value for r in ordered.percentiles(t, name, [0.0, 0.5, 1.0]).collect()} == {0.0: 0, 0.5: 5, 1.0: 9}
    assert {(r.k, r.value) for r in ordered.percentiles(t, name, [0.5], ["k"]).collect()} == {(0, 4), (1, 5)}
    assert {(r[name], r.value) for r in ordered.percentiles(t, "k", [0.5], [name]).collect()} == {(i, i % 2) for i in range(10)}
    assert sorted(r[0] for r in ordered.percentile_range(t, name, 0.2, 0.6).collect()) == [2, 3, 4, 5]


def test_summary_leaves_out_other_counts(spark):
    rows = [("A", 1), ("B", 2), ("B", 2), ("D", 3), ("D", 3), ("D", 3)]
    t = spark.createDataFrame([(g, "C", 5, "A", "C") for g, _ in rows], "genome_id string, contig_id string, pos long, ref string, alt string")
    g = spark.createDataFrame([(x,) for x in "ABCD"], "genome_id string")
    r = aggregates.allele_summary_by_variant(t, g).first()
    assert (r.reference_homozygous, r.minor_heterozygous, r.minor_homozygous) == (1, 1, 1)


def test_hypergeometric():
    assert abs(stats.hypergeometric_upper(7, 8, 10, 17) - 0.036404771) < 1e-9
    assert stats.hypergeometric_upper(0, 3, 3, 10) == 1 - stats.hypergeometric_cdf(0, 3, 3, 10)
    assert stats.hypergeometric_upper(0, 3, 3, 10, compat=False) == 1.0


def test_distributions():
    assert abs(stats.gamma_cdf(stats.gamma_quantile(0.3, 2.5), 2.5) - 0.3) < 1e-9
    assert abs(stats.gamma_cdf(2.0, 1.0) - (1 - math.exp(-2))) < 1e-12
    assert abs(stats.poisson_cdf(2, 1.5) - sum(math.exp(-1.5) * 1.5**k / math.factorial(k) for k in range(3))) < 1e-12
    assert abs(stats.minimise(lambda x: (x - 0.3) ** 2, -1, 1) - 0.3) < 1e-5


def test_cigars():
    assert [cigar.generate(a, b) for a, b in (("A", "C"), ("AG", "A"), ("A", "ATT"), ("ACGT", "AGGT"))] == ["1X", "1M1D", "1M2I", "1M1X2M"]
    rng = random.Random(1)
    for _ in range(100):
        a, b = ("".join(rng.choice("ACGT") for _ in range(rng.randint(1, 9))) for _ in range(2))
        assert cigar.valid(cigar.generate(a, b), a, b)
    assert cigar.is_snp("1M1X2M") and not cigar.is_snp("2X") and not cigar.valid("1M", "A", "C") and cigar.edit_offset("3M1X") == 3


def test_sequences(spark):
    t = spark.createDataFrame([("ATGAAATGA", [(0, 3), (6, 9)])], "s string, e array<struct<lower:int,upper:int>>")
    r = t.select(sequence.translate("s").alias("p"), sequence.validity("s").alias("v"), sequence.splice("s", "e").alias("x"), sequence.kmer_count("s", "TGA").alias("k"), sequence.kmer_count("s", "TGA", compat=False).alias("k2"), sequence.insert_at("s", F.lit(1), F.lit("CC")).alias("i"), sequence.reverse_complement("s").alias("rc")).first()
    assert (r.p, r.v, r.x, r.k, r.k2, r.i, r.rc) == ("MK*", "VALID", "ATGTGA", 1, 2, "ACCTGAAATGA", "TCATTTCAT")
    assert sequence.infix_distance("ACG", "TTACGTT") == 0 and sequence.infix_distance("AXG", "TTACGTT") == 1
    assert sequence.lz76("") == 0 and sequence.lz76("AAAA") == 2 and sequence.lz76("ACGT") == 4


def test_fold():
    f = mutation.apply_variants
    assert f("ACGTACGT", 100, [(101, "C", "T")]) == ("ATGTACGT", [])
    assert f("ACGTACGT", 100, [(101, "CGT", "C"), (105, "C", "G")])[0] == "ACAGGT"
    assert f("ACGTACGT", 100, [(101, "C", "CTT"), (105, "C", "G")])[0] == "ACTTGTAGGT"
    assert f("ACGTACGT", 100, [(101, "G", "T")])[0] is None


def test_trees(spark):
    m = spark.createDataFrame([(1, 0, 2.0), (2, 0, 6.0), (2, 1, 6.0), (3, 0, 10.0), (3, 1, 10.0), (3, 2, 10.0)], "i int, j int, d double")
    rows = [tuple(r) for r in trees.upgma(m).collect()]
    assert sorted(r[3] for r in rows if r[2] is None) == [1.0, 3.0, 5.0]
    text = trees.newick(rows)
    assert sorted(r[2] for r in trees.parse_newick(text) if r[2]) == ["0", "1", "2", "3"]
    assert trees.parse_newick("((A:1,B:2):3,C:4);")[0] == (0, None, None, 0.0)


def test_vectors_in_blocks(spark, monkeypatch):
    """Blocks of a few vectors against all pairs: copies, other lengths, nulls, a key without and one with an unknown vector."""
    monkeypatch.setattr(trees, "BLOCK", 5)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(0, 3, 4)]) for i in range(23)] + [(30, [1.0]), (31, [None, 1.0, 1.0, 1.0]), (None, [0.0] * 4), (32, None)]
    items = spark.createDataFrame(rows, "k long, v array<float>")
    known = {k: v for k, v in rows if k is not None}
    want = {(i, j): None if i > 29 else math.dist(known[i], known[j]) for i in known for j in known if i > j}
    got = {(r.i, r.j): r.d for r in trees.euclidean(items, "k", "v").collect()}
    assert got.keys() == want.keys() and all(got[p] is None if want[p] is None else abs(got[p] - want[p]) < 1e-12 for p in want)
    both = {(i, j): want[max(i, j), min(i, j)] for i in range(23) for j in range(23) if i != j}
    most = max(both.values())
    near = {i: min((d, j) for (a, j), d in both.items() if a == i) for i in range(23)}
    got = {r.i: (r.nearest, round(r.d, 9)) for r in trees.nearest_vectors(items, "k", "v").collect()}
    assert got == {i: (j, round(d / most, 9)) for i, (d, j) in near.items()}
    assert trees._blocks(items, "k", "v").count() > 6  # one row for two blocks, and no pair of items before the matrices


def test_tree_of_more_vectors_than_a_matrix_may_have(spark, monkeypatch):
    v = np.random.default_rng(3).normal(size=(60, 3))
    d = np.sqrt(((v[:, None] - v) ** 2).sum(2))
    want = sorted((r[4], round(r[3], 9)) for r in trees.cluster(list(range(60)), d))
    for held in (1 << 29, 0):  # all sums kept, and only a few
        label = [{i} for i in range(60)]
        for a, b, _ in trees.chain(v, held):
            label[a] = label[b] = label[a] | label[b]
            for m in label[a]:
                label[m] = label[a]
        assert len(label[0]) == 60
        assert [round(h, 9) for _, _, h in trees.chain(v, held)] == sorted(h for n, h in want if n > 1)
    monkeypatch.setattr(trees, "MOST_LEAVES", 10)
    items = spark.createDataFrame([(i, v[i].tolist()) for i in range(60)], "k long, v array<double>")
    rows = [tuple(r) for r in trees.upgma_vectors(items, "k", "v").collect()]
    assert sorted((r[4], round(r[3], 9)) for r in rows) == want
    assert sum(r[1] is None for r in rows) == 1 and trees.newick(rows).count(",") == 59


def test_hypergeometric_tail():
    """Against 60 digits; 119 of 627 among 24,000 of 120,000 was wrong in the tenth digit by logarithms."""
    from decimal import Decimal, localcontext

    with localcontext() as at:
        at.prec = 60
        for k, K, n, N in ((119, 627, 24_000, 120_000), (140, 627, 24_000, 120_000), (300, 627, 24_000, 120_000), (3, 9, 12, 20), (1, 9, 12, 20), (2, 9, 12, 20), (10, 9, 12, 20), (5, 20, 5, 20)):
            low, weight = max(0, n + K - N), [Decimal(1)]
            for i in range(low, min(n, K)):
                weight.append(weight[-1] * (K - i) * (n - i) / ((i + 1) * (N - K - n + i + 1)))
            exact = float(sum(weight[max(k - low, 0) :]) / sum(weight))
            assert abs(stats.hypergeometric_tail(k, K, n, N) - exact) <= (1e-13 if exact > 1e-20 else 1e-8) * exact
