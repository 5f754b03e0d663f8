import math

import numpy as np

from genoquill.operators import phylo as P


def test_models():
    q = P.rate_matrix((0.1, 0.2, 0.3, 0.4), (1, 2, 1, 1, 2, 1))
    p = P.transition(q, 0.7)
    assert np.allclose(p.sum(axis=1), 1) and np.allclose(P.transition(q, 0.3) @ P.transition(q, 0.4), p)
    assert np.allclose(P.transition(q, 200.0)[0], (0.1, 0.2, 0.3, 0.4), atol=1e-6)
    r = P.gamma_rates(0.5, 4)
    assert abs(r.mean() - 1) < 1e-9 and (np.diff(r) > 0).all()


def test_likelihood_of_two_taxa():
    t = 0.3
    same, other = 0.25 + 0.75 * math.exp(-4 * t / 3), 0.25 - 0.25 * math.exp(-4 * t / 3)
    want = 3 * math.log(0.25 * same) + 2 * math.log(0.25 * other)
    assert abs(P.log_likelihood("(A:0.1,B:0.2);", ["A", "B"], [("AA", 3), ("AC", 2)]) - want) < 1e-9


def test_splits_and_subsets():
    s = P.splits("((A:1,B:1):1,(C:1,D:1):1,E:1);")
    assert s == {frozenset("CD"), frozenset("CDE")}
    assert P.compatible(frozenset("CD"), frozenset("CDE")) and not P.compatible(frozenset("BC"), frozenset("CD"))
    assert P.subset(r"third[codon]:3-9\3", 12) == ("third", "codon", [2, 5, 8]) and P.subset("a:1,4-.", 6)[2] == [0, 3, 4, 5]


def test_patterns_and_chains(spark):
    rows = [("A", "ACGTACGTAA" * 6), ("B", "ACGTACGTAC" * 6), ("C", "TCGAACCTAA" * 6), ("D", "TCGAACCTAC" * 6)]
    n = {r.pattern: r.n for r in P.patterns(spark.createDataFrame(rows, "taxon string, states string")).collect()}
    assert sum(n.values()) == 60 and n["AATT"] == 6
    start = "((A:0.1,C:0.1):0.1,(B:0.1,D:0.1):0.1);"
    s = P.chains(spark, start, list("ABCD"), list(n.items()), n_chains=2, steps=60, burn_in=60, seed=3)
    first = [tuple(r) for r in s.orderBy("chain", "step").collect()]
    assert first == [tuple(r) for r in s.orderBy("chain", "step").collect()] and len(first) == 12
    assert max(r[3] for r in first) > P.log_likelihood(start, list("ABCD"), list(n.items()))
    assert abs(sum(r.share for r in P.topologies(s).collect()) - 1) < 1e-9


def test_coupled_chains(spark, tmp_path):
    from genoquill.sources import formats, sinks

    sites = [("AAAA", 30), ("AACC", 12), ("ACAC", 2), ("GGTT", 6), ("CCCC", 20)]
    taxa, start = list("ABCD"), "((A:0.1,C:0.1):0.1,(B:0.1,D:0.1):0.1);"
    s = P.coupled_chains(spark, start, taxa, sites, runs=2, heat=(1.0, 0.4), steps=60, burn_in=40, seed=4)
    rows = s.orderBy("chain", "step").collect()
    assert rows == s.orderBy("chain", "step").collect() and len(rows) == 12
    for r in rows:
        assert abs(sum(r.frequencies) - 1) < 1e-9 and abs(sum(r.exchange) - 1) < 1e-9 and 0 <= r.invariable < 1 and r.shape > 0
        assert abs(r.log_likelihood - P.log_likelihood(r.tree, taxa, sites, r.frequencies, r.exchange, r.shape, 4, r.invariable)) < 1e-6
        assert abs(r.tree_length - P.tree_length(r.tree)) < 1e-9
    assert max(r.swaps for r in rows) > 0 and max(r.log_likelihood for r in rows) > P.log_likelihood(start, taxa, sites)
    sinks.chain_files(s, taxa, str(tmp_path / "out"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "out" / "trees")).collect())
    assert text.startswith("#nexus") and len(formats.nexus(text)["trees"]) == 6


def test_dirichlet_steps_keep_the_balance():
    rng, old = np.random.default_rng(1), np.array([0.1, 0.2, 0.3, 0.4])
    new, ratio = P._simplex(old, rng, 1.0)
    assert abs(new.sum() - 1) < 1e-12
    assert P._moved(P.State("(A:1,B:2);"), "length", rng, 1.0)[1] != 0
