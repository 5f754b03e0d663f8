"""Bayesian phylogenetics: site patterns, substitution models, pruning likelihood and Metropolis-Hastings chains.

Patterns and tree samples are frames; a run of chains is sequential and is one task, runs go beside each other.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .trees import parse_newick

STATES = "ACGT"


def patterns(alignment: DataFrame) -> DataFrame:
    """(pattern, n): distinct columns of an alignment (taxon, states), letters in the order of the taxa, and how often they occur."""
    t = alignment.select("taxon", F.posexplode(F.split("states", "")).alias("site", "state")).where("state <> ''")
    sites = t.groupBy("site").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("taxon", "state"))), lambda x: x["state"]), "").alias("pattern"))
    return sites.groupBy("pattern").agg(F.count("*").alias("n"))


def subset(text: str, sites: int) -> tuple[str, str, list[int]]:
    """(name, type, zero-based sites) of a partition text such as `first:1-1000\\3` or `all[codon]:1-.`."""
    m = re.fullmatch(r"\s*([^:\[]+)(?:\[(\w+)\])?\s*:\s*(.+)", text)
    if not m:
        raise ValueError(f"not a subset: {text}")
    out: list[int] = []
    for part in m[3].split(","):
        k = re.fullmatch(r"\s*(\d+)(?:\s*-\s*(\d+|\.))?(?:\s*\\\s*(\d+))?\s*", part)
        if not k:
            raise ValueError(f"not a range: {part}")
        first, last = int(k[1]), sites if k[2] == "." else int(k[2] or k[1])
        out += range(first - 1, last, int(k[3] or 1))
    return m[1].strip(), m[2] or "nucleotide", out


def rate_matrix(frequencies: Sequence[float], exchange: Sequence[float]) -> np.ndarray:
    """Reversible nucleotide rates with one substitution expected per unit of time; exchange: AC, AG, AT, CG, CT, GT."""
    q, k = np.zeros((4, 4)), 0
    for i in range(4):
        for j in range(i + 1, 4):
            q[i, j], q[j, i], k = exchange[k] * frequencies[j], exchange[k] * frequencies[i], k + 1
    np.fill_diagonal(q, -q.sum(axis=1))
    return q / -(np.asarray(frequencies) * np.diag(q)).sum()


def transition(q: np.ndarray, time: float) -> np.ndarray:
    """exp(q t) by scaling and squaring."""
    k = max(0, math.ceil(math.log2(max(np.abs(q * time).max(), 1e-12))) + 4)
    a, term, out = q * time / 2**k, np.eye(len(q)), np.eye(len(q))
    for i in range(1, 14):
        term = term @ a / i
        out = out + term
    for _ in range(k):
        out = out @ out
    return out


def gamma_rates(shape: float, categories: int) -> np.ndarray:
    """Mean rates of equally likely categories of a gamma distribution of mean 1."""
    from ..functions.stats import gamma_cdf, gamma_quantile

    cuts = [gamma_quantile(i / categories, shape) / shape for i in range(1, categories)]
    part = [0.0, *[gamma_cdf(c * shape, shape + 1) for c in cuts], 1.0]
    return np.diff(part) * categories


def log_likelihood(tree: str, taxa: Sequence[str], sites: Sequence[tuple[str, int]], frequencies: Sequence[float] = (0.25,) * 4, exchange: Sequence[float] = (1.0,) * 6, shape: float | None = None, categories: int = 4, invariable: float = 0.0) -> float:
    """Of a Newick tree by Felsenstein's pruning, over (pattern, count) sites; letters outside the alphabet are unknown."""
    rows, pi = parse_newick(tree), np.asarray(frequencies)
    q = rate_matrix(frequencies, exchange)
    rates = gamma_rates(shape, categories) if shape else np.ones(1)
    n = np.array([c for _, c in sites], float)
    leaf = {t: np.array([[p[i] == s or p[i] not in STATES for s in STATES] for p, _ in sites], float) for i, t in enumerate(taxa)}
    total = np.zeros(len(sites))
    for rate in rates:
        below = [np.ones((len(sites), 4)) for _ in rows]
        for node, parent, name, length in reversed(rows):
            own = leaf[name] if name in leaf else below[node]
            if parent is None:
                total += own @ pi / len(rates)
            else:
                below[parent] *= own @ transition(q, length * rate / max(1 - invariable, 1e-9)).T
    if invariable:
        same = np.prod([leaf[t] for t in taxa], axis=0) @ pi
        total = (1 - invariable) * total + invariable * same
    return float((n * np.log(np.maximum(total, 1e-300))).sum())


def splits(tree: str) -> frozenset[frozenset[str]]:
    """The groups of taxa that inner edges of a tree set apart, each without the first taxon by name."""
    rows = parse_newick(tree)
    below: dict[int, set] = {r[0]: {r[2]} if r[2] else set() for r in rows}
    for node, parent, _, _ in reversed(rows):
        if parent is not None:
            below[parent] |= below[node]
    every = set(below[rows[0][0]])
    first, out = min(every), set()
    for node, parent, _, _ in rows:
        group = below[node]
        if parent is not None and 1 < len(group) < len(every) - 1:
            out.add(frozenset(group if first not in group else every - group))
    return frozenset(out)


def compatible(a: frozenset[str], b: frozenset[str]) -> bool:
    """Whether two splits (without the same taxon) can stand in one tree."""
    return not (a & b) or a <= b or b <= a


def _swap(tree: str, rng: np.random.Generator) -> str:
    """Two leaves that aren't siblings change places."""
    rows = parse_newick(tree)
    names = [(r[2], r[1]) for r in rows if r[2]]
    a, b = rng.choice(len(names), 2, replace=False)
    x, y = names[a][0], names[b][0]
    return re.sub(rf"(?<=[(,]){re.escape(x)}(?=[:,)])|(?<=[(,]){re.escape(y)}(?=[:,)])", lambda m: y if m[0] == x else x, tree)


def _stretch(tree: str, rng: np.random.Generator, tuning: float) -> tuple[str, float]:
    """One branch scaled by exp(u); the log of the Hastings ratio."""
    places = [m.span(1) for m in re.finditer(r":([0-9.eE+-]+)", tree)]
    lo, up = places[rng.integers(len(places))]
    u = tuning * (rng.random() - 0.5)
    return f"{tree[:lo]}{max(float(tree[lo:up]) * math.exp(u), 1e-8):.8g}{tree[up:]}", u


def chains(spark: SparkSession, start: str, taxa: Sequence[str], sites: Sequence[tuple[str, int]], n_chains: int = 2, steps: int = 200, burn_in: int = 50, every: int = 10, seed: int = 1, mean_length: float = 0.1, heat: Sequence[float] | None = None) -> DataFrame:
    """(chain, step, tree, log_likelihood) samples of Metropolis-Hastings chains over topologies and branch lengths.

    Branch lengths have exponential priors; chain k targets the posterior to the power heat[k]. Seeded: the same call gives
    the same samples on any cluster.
    """
    powers = list(heat or [1.0] * n_chains)
    taxa, sites = list(taxa), list(sites)

    def run(batches):
        for b in batches:
            for k in b["id"]:
                rng, tree, tuning = np.random.default_rng([seed, int(k)]), start, 1.0
                prior = lambda t: -sum(float(x) for x in re.findall(r":([0-9.eE+-]+)", t)) / mean_length
                like, out = log_likelihood(tree, taxa, sites), []
                for step in range(steps + burn_in):
                    new, hastings = (_swap(tree, rng), 0.0) if rng.random() < 0.3 else _stretch(tree, rng, tuning)
                    value = log_likelihood(new, taxa, sites)
                    if math.log(max(rng.random(), 1e-300)) < powers[int(k)] * (value - like + prior(new) - prior(tree)) + hastings:
                        tree, like = new, value
                        tuning = min(tuning * (1.02 if step < burn_in else 1.0), 4.0)
                    elif step < burn_in:
                        tuning = max(tuning / 1.01, 0.05)
                    if step >= burn_in and (step - burn_in) % every == 0:
                        out.append((int(k), step - burn_in, tree, like))
                yield pd.DataFrame(out, columns=["chain", "step", "tree", "log_likelihood"])

    return spark.range(0, len(powers), 1, len(powers)).mapInPandas(run, "chain long, step long, tree string, log_likelihood double")


@dataclass
class State:
    """A tree and the parameters of its model: frequencies of states, exchangeabilities, gamma shape and share of invariable sites."""

    tree: str
    frequencies: np.ndarray = field(default_factory=lambda: np.full(4, 0.25))
    exchange: np.ndarray = field(default_factory=lambda: np.full(6, 1 / 6))
    shape: float = 1.0
    invariable: float = 0.1

    def log_likelihood(self, taxa: Sequence[str], sites: Sequence[tuple[str, int]]) -> float:
        return log_likelihood(self.tree, taxa, sites, self.frequencies, self.exchange, self.shape, 4, self.invariable)

    def log_prior(self, mean_length: float) -> float:
        """Exponential branch lengths and shape; frequencies, exchangeabilities and the invariable share are flat."""
        return -tree_length(self.tree) / mean_length - self.shape


def tree_length(tree: str) -> float:
    return sum(float(x) for x in re.findall(r":([0-9.eE+-]+)", tree))


def _simplex(old: np.ndarray, rng: np.random.Generator, tuning: float) -> tuple[np.ndarray, float]:
    """A draw around old from a Dirichlet distribution, and the log of the Hastings ratio."""
    sharp = 200.0 / max(tuning, 1e-3)
    new = np.maximum(rng.dirichlet(old * sharp + 1.0), 1e-6)
    new /= new.sum()

    def density(x: np.ndarray, centre: np.ndarray) -> float:
        a = centre * sharp + 1.0
        return float(((a - 1) * np.log(x)).sum()) + math.lgamma(a.sum()) - sum(math.lgamma(v) for v in a)

    return new, density(old, new) - density(new, old)


def _scaled(tree: str, factor: float) -> str:
    return re.sub(r":([0-9.eE+-]+)", lambda m: f":{max(float(m[1]) * factor, 1e-8):.8g}", tree)


def _moved(state: State, kind: str, rng: np.random.Generator, tuning: float) -> tuple[State, float]:
    """A proposal of one kind and the log of its Hastings ratio."""
    u = tuning * (rng.random() - 0.5)
    if kind == "swap":
        return replace(state, tree=_swap(state.tree, rng)), 0.0
    if kind == "branch":
        tree, ratio = _stretch(state.tree, rng, tuning)
        return replace(state, tree=tree), ratio
    if kind == "length":
        return replace(state, tree=_scaled(state.tree, math.exp(u))), u * len(re.findall(r":", state.tree))
    if kind == "shape":
        return replace(state, shape=min(max(state.shape * math.exp(u), 0.05), 50.0)), u
    if kind == "invariable":
        x = abs(state.invariable + 0.2 * u)
        return replace(state, invariable=min(2 - x if x > 1 else x, 0.99)), 0.0
    name = {"frequencies": "frequencies", "exchange": "exchange"}[kind]
    new, ratio = _simplex(getattr(state, name), rng, tuning)
    return replace(state, **{name: new}), ratio


#: Kinds of proposals with the share of steps that each is tried in.
MOVES = {"swap": 0.25, "branch": 0.35, "length": 0.1, "shape": 0.08, "invariable": 0.06, "frequencies": 0.08, "exchange": 0.08}


def coupled_chains(spark: SparkSession, start: str, taxa: Sequence[str], sites: Sequence[tuple[str, int]], runs: int = 2, heat: Sequence[float] = (1.0, 0.7, 0.5), steps: int = 200, burn_in: int = 50, every: int = 10, seed: int = 1, mean_length: float = 0.1, moves: dict[str, float] | None = None) -> DataFrame:
    """(chain, step, tree, log_likelihood, log_prior, tree_length, shape, invariable, frequencies, exchange, swaps) samples of runs of heated chains.

    The chains of a run target the posterior to the powers of heat, the first of which is 1, and after each step two of them
    may change places; the first one is sampled. A run is sequential and is one task; runs go beside each other. Seeded: the
    same call gives the same samples on any cluster.
    """
    if not heat or heat[0] != 1.0:
        raise ValueError("the first chain is to be cold")
    taxa, sites, powers = list(taxa), list(sites), list(heat)
    kinds, shares = zip(*(moves or MOVES).items(), strict=True)
    shares = np.array(shares) / sum(shares)

    def run(batches):
        for b in batches:
            for k in b["id"]:
                rng, tuning, swaps, out = np.random.default_rng([seed, int(k)]), dict.fromkeys(kinds, 1.0), 0, []
                states = [State(start) for _ in powers]
                score = [(s.log_likelihood(taxa, sites), s.log_prior(mean_length)) for s in states]
                for step in range(steps + burn_in):
                    for c, power in enumerate(powers):
                        kind = kinds[int(rng.choice(len(kinds), p=shares))]
                        new, ratio = _moved(states[c], kind, rng, tuning[kind])
                        value = new.log_likelihood(taxa, sites), new.log_prior(mean_length)
                        took = math.log(max(rng.random(), 1e-300)) < power * (sum(value) - sum(score[c])) + ratio
                        if took:
                            states[c], score[c] = new, value
                        if step < burn_in:
                            tuning[kind] = min(max(tuning[kind] * (1.02 if took else 1 / 1.01), 0.05), 4.0)
                    if len(powers) > 1:
                        i, j = (int(x) for x in rng.choice(len(powers), 2, replace=False))
                        if math.log(max(rng.random(), 1e-300)) < (powers[i] - powers[j]) * (sum(score[j]) - sum(score[i])):
                            states[i], states[j], score[i], score[j], swaps = states[j], states[i], score[j], score[i], swaps + 1
                    if step >= burn_in and (step - burn_in) % every == 0:
                        s = states[0]
                        out.append((int(k), step - burn_in, s.tree, *score[0], tree_length(s.tree), s.shape, s.invariable, s.frequencies.tolist(), s.exchange.tolist(), swaps))
                yield pd.DataFrame(out, columns=["chain", "step", "tree", "log_likelihood", "log_prior", "tree_length", "shape", "invariable", "frequencies", "exchange", "swaps"])

    schema = "chain long, step long, tree string, log_likelihood double, log_prior double, tree_length double, shape double, invariable double, frequencies array<double>, exchange array<double>, swaps long"
    return spark.range(0, runs, 1, runs).mapInPandas(run, schema)


def topologies(samples: DataFrame, credible: float = 0.95) -> DataFrame:
    """(topology, n, share, credible): distinct split sets, the most frequent first, up to the share that makes a credible set."""
    from pyspark.sql import Window as W

    @F.pandas_udf("string")
    def key(trees: pd.Series) -> pd.Series:
        return trees.map(lambda t: ";".join(sorted("|".join(sorted(s)) for s in splits(t))))

    t = samples.groupBy(key("tree").alias("topology")).agg(F.count("*").alias("n"))
    t = t.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0))))
    before = F.coalesce(F.sum("share").over(W.partitionBy(F.lit(0)).orderBy(F.col("n").desc(), "topology").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return t.withColumn("credible", before < credible)
