"""Quality rules under weak supervision, in DataFrame functions only.

Seven rules look at counts of a text and vote good (1) or bad (-1) or abstain (0); rules for one defect only vote bad, as
the lack of a defect is no merit. Expectation-maximisation estimates how each rule votes given the hidden quality, from
the counts of the vote patterns (at most 3^7 = 2,187 rows, whatever the input). The posterior
probability of good quality then replaces a filter that all rules must pass.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, let, materialize, words_of

WINDOW = 5
#: The share of good documents, which is given and not estimated: documents that no rule flags stay at it, so that estimates
#: would drift. Beliefs at the start, with the weight of BELIEF of the rows: how often a flag is right, and the share of good
#: votes that rules give to bad (0) and to good (1) documents.
GOOD, FLAG, SAYS, BELIEF, ROUNDS = 0.8, 0.95, {0: 0.6, 1: 0.9}, 0.001, 60


def _votes() -> dict[str, Column]:
    c = F.col
    n = F.greatest(c("n_words"), F.lit(1))

    def vote(bad: Column, good: Column | None = None) -> Column:
        out = F.when(bad, -1)
        return (out if good is None else out.when(good, 1)).otherwise(0)

    return {
        "v_length": vote(c("n_words") < 10, c("n_words") >= 50),
        "v_symbols": vote(10 * c("n_symbols") > n),
        "v_repeats": vote(5 * c("n_repeat_words") > n),
        "v_lines": vote((10 * c("n_dup_lines") > 3 * c("n_lines")) & (c("n_dup_lines") > 1)),
        "v_word_length": vote((c("word_chars") < 2 * n) | (c("word_chars") > 15 * n), c("word_chars").between(3 * n, 12 * n)),
        "v_shouting": vote((10 * c("n_capitals") > 3 * c("word_chars")) | (10 * c("n_exclaim") > n)),
        "v_stops": vote((c("n_words") >= 50) & (50 * c("n_stops") < n), 40 * c("n_stops") >= n),
    }


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts of each text: id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and those that only rules use."""
    t = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    t = t.withColumn("_w", words_of(F.col("_t"))).withColumn("_n", F.size("_w"))
    hashes = F.transform(F.sequence(F.lit(0), F.col("_n") - WINDOW), lambda i: F.xxhash64(*[F.col("_w")[i + k] for k in range(WINDOW)]))
    t = t.withColumn("_h", F.when(F.col("_n") >= WINDOW, hashes))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda x, k: F.when(k == 0, WINDOW).otherwise(F.least(F.lit(WINDOW), x - at[k - 1])))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def repeated(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
        return let(F.sort_array(F.transform(twice, lambda x: x["i"])), covered)

    pairs = F.sort_array(F.transform(F.col("_h"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    lines = F.filter(F.split("_t", "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    t = t.withColumn("_l", lines)
    count = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    return t.select(
        F.col(id_col),
        count(F.col("_n")).alias("n_words"),
        count(F.length(F.array_join("_w", ""))).alias("word_chars"),
        count(F.regexp_count("_t", F.lit("[#*$%&|<>]"))).alias("n_symbols"),
        count(F.size("_l") - F.size(F.array_distinct("_l"))).alias("n_dup_lines"),
        count(F.when(F.col("_n") < WINDOW, 0).when(F.size("_h") == F.size(F.array_distinct("_h")), 0).otherwise(let(pairs, repeated))).alias("n_repeat_words"),
        count(F.size("_l")).alias("n_lines"),
        count(F.regexp_count("_t", F.lit("[A-ZÀ-ÖØ-Þ]"))).alias("n_capitals"),
        count(F.regexp_count("_t", F.lit("!"))).alias("n_exclaim"),
        count(F.regexp_count("_t", F.lit(r"(?i)(?<![^\x20\x09-\x0D])(?:the|of|and|to|in|is|de|la|le|et|les|des|un|une|der|die|und|das|den|ein|von|zu|el|los|que|en|por|para|con|y|a)(?=[\x20\x09-\x0D.,])"))).alias("n_stops"),
    )


def _logit(x: float) -> float:
    return math.log(x / (1 - x))


def fit_label_model(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, list[dict[int, float]]]:
    """Expectation-maximisation over (votes, count) patterns: prior log-odds of good, and per rule the log-odds that each vote adds.

    Of a rule that votes both ways the shares of its votes are estimated in either class, and a vote adds their log-ratio. A
    rule that only ever votes bad has one accuracy, the mean posterior of bad over the documents it flags, and its vote adds
    the log-odds of this less those of the class. A vote never counts against what it says. Whether a rule abstains doesn't
    depend on the class, so abstaining adds nothing. Beliefs of a weight of BELIEF of the rows keep estimates inside (0, 1).
    Without patterns nothing is added.
    """
    if not patterns:
        return 0.0, []
    m, few = len(patterns[0][0]), max(1.0, BELIEF * sum(n for _, n in patterns))
    both = [any(votes[j] > 0 for votes, _ in patterns) for j in range(m)]
    flag, says = [FLAG] * m, [dict(SAYS) for _ in range(m)]  # accuracy of a flag; share of good votes by class

    def added() -> list[dict[int, float]]:
        out = []
        for j in range(m):
            if both[j]:
                good, bad = says[j][1], says[j][0]
                out.append({-1: min(0.0, math.log((1 - good) / (1 - bad))), 0: 0.0, 1: max(0.0, math.log(good / bad))})
            else:
                out.append({-1: -max(0.0, _logit(flag[j]) + _logit(GOOD)), 0: 0.0, 1: 0.0})
        return out

    for _ in range(rounds):
        w, n_by, true = added(), [[0.0, 0.0] for _ in range(m)], [[0.0, 0.0] for _ in range(m)]
        for votes, n in patterns:
            odds = _logit(GOOD) + sum(w[j][v] for j, v in enumerate(votes))
            p = 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))
            for j, v in enumerate(votes):
                if v:
                    for y, share in ((0, n * (1 - p)), (1, n * p)):
                        n_by[j][y] += share
                        true[j][y] += share * (v > 0)
        flag = [(n_by[j][0] + few * FLAG) / (sum(n_by[j]) + few) for j in range(m)]
        says = [{y: (true[j][y] + few * SAYS[y]) / (n_by[j][y] + few) for y in (0, 1)} for j in range(m)]
    return _logit(GOOD), added()


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per row of docs: id_col, the counts, base_failed, posterior (double) and kept.

    A null text counts as empty: no words, so the base fails and it isn't kept. Null ids, repeated rows and columns of
    other names don't matter; an empty table gives an empty result.
    """
    rules = _votes()
    own = materialize(features(docs, id_col, text_col), "features")
    voted = own.select("*", *[v.alias(k) for k, v in rules.items()])
    patterns = [(tuple(r[:-1]), r[-1]) for r in voted.groupBy(*rules).count().collect()]  # 3^7 rows at most
    prior, weights = fit_label_model(sorted(patterns))
    odds = F.lit(prior)
    for name, w in zip(rules, weights, strict=False):
        odds = odds + F.when(F.col(name) < 0, w[-1]).when(F.col(name) > 0, w[1]).otherwise(w[0])
    out = voted.withColumn("posterior", F.round(1 / (1 + F.exp(-odds)), 6))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("posterior") >= threshold)).alias("kept"), "posterior", *rules)
