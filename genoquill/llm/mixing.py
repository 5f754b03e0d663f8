"""Mixing sources to target weights by temperature.

A source with the share p of all tokens gets the weight p^t / sum(p^t). The exponent t is found by bisection, each round
of which weighs a whole grid of exponents in one aggregation: the largest t in [0, 1] whose entropy, relative to the
logarithm of the number of sources, reaches a target, or the smallest t whose largest repetition stays within a limit.
Weights become documents through block permutations: a source is cut into blocks of bounded size by a hash, blocks and
the documents in them are permuted by seeded hashes, and a prefix of this order fills the part of the budget that whole
epochs leave. Only the block in which the budget ends is looked at row by row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, words_of

GRID = 32


def source_tokens(docs: DataFrame, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(source, docs, tokens): documents and words of each source; null is a source of its own."""
    return docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("docs"), F.sum(F.size(words_of(F.col(text_col)))).cast("long").alias("tokens"))


def _evaluate(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float, float]]:
    """(exponent, relative entropy, largest repetition at full coverage) for each exponent: one job."""
    t = F.explode(F.array(*[F.lit(float(x)) for x in exponents])).alias("t")
    powered = shares.select("p", t).select("p", "t", F.pow("p", "t").alias("q"))
    stats = powered.groupBy("t").agg(F.sum("q").alias("z"), F.sum(F.col("q") * F.ln("q")).alias("s"), F.count("*").alias("k"), F.max(F.col("q") / F.col("p")).alias("most"), F.min(F.col("q") / F.col("p")).alias("least"))
    out = []
    for r in stats.collect():  # one row per exponent
        entropy = (math.log(r.z) - r.s / r.z) / math.log(r.k) if r.k > 1 else 1.0
        out.append((r.t, entropy, r.most / r.least))
    return sorted(out)


def find_exponent(tokens: DataFrame, entropy: float | None = None, repeats: float | None = None, rounds: int = 5) -> float:
    """The exponent in [0, 1]: the largest that reaches the relative entropy, or the smallest within the repetition limit.

    The entropy falls and the repetitions of full coverage fall as the exponent grows to 1, so a bracket of the grid
    holds the answer; 5 rounds of 32 leave an error below 1e-7. No source or one source: 1.
    """
    if (entropy is None) == (repeats is None):
        raise ValueError("give entropy or repeats")
    some = tokens.where("tokens > 0")
    total = some.agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).first()
    if total.n < 2:
        return 1.0
    shares = some.select((F.col("tokens") / F.lit(float(total.t))).alias("p"))
    lo, hi = 0.0, 1.0
    for _ in range(rounds):
        grid = _evaluate(shares, [lo + (hi - lo) * i / GRID for i in range(GRID + 1)])
        if entropy is not None:
            good = [t for t, e, _ in grid if e >= entropy]
            if not good:
                return lo
            lo, hi = max(good), min([t for t, _, _ in grid if t > max(good)], default=max(good))
        else:
            good = [t for t, _, m in grid if m <= repeats]
            if not good:
                return hi
            lo, hi = max([t for t, _, _ in grid if t < min(good)], default=min(good)), min(good)
        if lo == hi:
            break
    return lo if entropy is not None else hi


def weights(tokens: DataFrame, exponent: float) -> DataFrame:
    """tokens with share, weight and epochs, how often the source is read for the smallest budget that reads each source once or more."""
    total = tokens.agg(F.sum("tokens").cast("double").alias("_all"))
    t = tokens.crossJoin(F.broadcast(total)).withColumn("share", F.col("tokens") / F.col("_all"))  # one row
    t = t.withColumn("q", F.when(F.col("tokens") > 0, F.pow("share", F.lit(exponent))).otherwise(0.0))
    least = t.agg(F.sum("q").alias("_z"), F.min(F.when(F.col("tokens") > 0, F.col("q") / F.col("share"))).alias("_least"))
    t = t.crossJoin(F.broadcast(least))
    return t.select("source", "docs", "tokens", "share", (F.col("q") / F.col("_z")).alias("weight"), F.when(F.col("tokens") > 0, F.col("q") / F.col("share") / F.col("_least")).otherwise(1.0).alias("epochs"))


def _order(seed: int, *cols: Column) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def plan(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", entropy: float | None = None, repeats: float | None = None, budget: float | None = None, block_docs: int = 2000, seed: int = 42) -> DataFrame:
    """One row per row of docs: id_col, source, n_tokens, weight, epochs and copies, how often the row is read.

    Without a budget (in tokens) it is the smallest that reads each source once or more, so no row is dropped; a
    given budget is split by the weights, and a source then gets budget * weight / tokens epochs. Whole epochs read every
    row; of the rest, rows are read in permuted order up to the tokens that are left (the row on the edge is read if
    over half of it fits). Null sources are one source, null texts and rows without words are read once per epoch begun;
    null and repeated ids are rows like others. Every row of equal id and text has the same order; ties are counted in full.
    """
    row = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.size(words_of(F.col(text_col))).cast("long").alias("n_tokens")).withColumn("row", F.monotonically_increasing_id())
    own = materialize(row, "tokens")
    by_source = own.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").cast("long").alias("tokens"))
    by_source = materialize(by_source, "sources")
    wanted = weights(by_source, find_exponent(by_source, entropy, repeats))
    if budget is not None:
        wanted = wanted.withColumn("epochs", F.when(F.col("tokens") > 0, F.lit(float(budget)) * F.col("weight") / F.col("tokens")).otherwise(1.0))
    wanted = wanted.withColumn("whole", F.floor(F.col("epochs") + 1e-9)).withColumn("rest", F.round((F.col("epochs") - F.col("whole")) * F.col("tokens")).cast("long")).withColumn("rest", F.greatest("rest", F.lit(0))).withColumn("blocks", F.ceil(F.col("docs") / block_docs).cast("long"))
    wanted = materialize(wanted, "weights")
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    some = wanted.select(F.col("source").alias("_s"), "weight", "epochs", "whole", "rest", "blocks")
    placed = own.join(some, own["source"].eqNullSafe(some["_s"])).withColumn("block", F.pmod(_order(seed, F.col("id"), F.col("row")), F.col("blocks")))
    placed = materialize(placed.drop("_s"), "placed")
    blocks = placed.groupBy("source", "block").agg(F.sum("n_tokens").alias("size"), F.first("rest").alias("rest"))
    before = F.coalesce(F.sum("size").over(W.partitionBy("source").orderBy(_order(seed + 1, F.col("block")), "block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumn("before", before).select(F.col("source").alias("_s"), F.col("block").alias("_b"), "size", "before")
    at = placed.join(blocks, placed["source"].eqNullSafe(blocks["_s"]) & (placed["block"] == blocks["_b"])).drop("_s", "_b")
    edge = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("size") > F.col("rest"))
    inside = at.where(edge).withColumn("till", F.col("before") + F.sum("n_tokens").over(W.partitionBy("source", "block").orderBy(_order(seed + 2, F.col("id")), "row").rowsBetween(W.unboundedPreceding, 0)))
    more = F.when(F.col("till") - F.col("n_tokens") / 2 <= F.col("rest"), 1).otherwise(0)
    full = at.where(~edge).withColumn("more", F.when((F.col("rest") > 0) & (F.col("before") + F.col("size") <= F.col("rest")), 1).otherwise(0))
    read = full.select("id", "source", "n_tokens", "weight", "epochs", "whole", "more", "row").union(inside.select("id", "source", "n_tokens", "weight", "epochs", "whole", more.alias("more"), "row"))
    return read.select(F.col("id").alias(id_col), "source", "n_tokens", F.round("weight", 9).alias("weight"), F.round("epochs", 6).alias("epochs"), (F.col("whole") + F.col("more")).cast("long").alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, each as often as plan says (see there for the options); rows that repeat an id are read alike, as often as the one that is read most."""
    copies = plan(docs, id_col, source_col, text_col, **options).groupBy(F.col(id_col).alias("_id")).agg(F.max("copies").cast("int").alias("_copies")).where("_copies > 0")
    joined = docs.join(copies, docs[id_col].eqNullSafe(copies["_id"]))
    return joined.select(*docs.columns, F.explode(F.array_repeat(F.lit(0), F.col("_copies"))).alias("_again")).drop("_again")
