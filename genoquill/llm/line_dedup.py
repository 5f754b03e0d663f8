"""Line deduplication by a log-template tree, in DataFrame functions only.

A line is parsed to a fixed depth: by its number of tokens, then by its leading tokens. Variable fields are generalised
twice: tokens with a digit or `@` and addresses become `<*>`, and within a leaf of the tree the tokens behind the leading
ones form two halves, of which either may hold variable fields: lines that agree in the leaf and in one half share a
template. Lines that several documents hold with their fields masked, and lines of a template that differ in a few tokens
only from an earlier one that stays, are recurring; they stay in one document, so what they say isn't lost.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, made, materialize, release

DEPTH, LEAST_WORDS = 3, 5
MASK = "<*>"
_B = r"\x20\x09-\x0D"
VARIABLE = rf"(?<![^{_B}])(?:[^{_B}0-9@]*+[0-9@]|https?://|www\.)[^{_B}]*+"
#: Tokens in which a line may differ from the line that stands for it: a tenth of its own, one at least, MOST_DIFFERING at most.
MOST_DIFFERING = 3
#: Members of buckets are held against their first alone until the pairs that are left are so many times the members at most.
MOST_PAIRS = 64
#: Bits of the bitmaps by which rows are sifted before they are shuffled: eight for each key, within bounds.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 26


def _index(line: Column, count: Column) -> Column:
    """The first count tokens of a line."""
    return F.call_function("substring_index", line, F.lit(" "), count)


def parsed_lines(docs: DataFrame, id_col: str, text_col: str, least_words: int) -> DataFrame:
    """(id, h, pos, line, n, a, b) of the lines of least_words tokens or more, with variable fields masked and one space between tokens.

    h is a hash of the row's text. a and b are hashes of the two halves of the line, each with the leaf that it is in, and
    together tell lines apart; b of a line that is too short for a template is one of the whole line.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("h"), F.when(text.rlike(r"[0-9@]|https?://|www\."), F.regexp_replace(text, VARIABLE, MASK)).otherwise(text).alias("t"))
    own = own.select("id", "h", F.when(F.col("t").rlike(r"[\x09\x0B-\x0D]| {2}"), F.regexp_replace("t", r"[\x20\x09\x0B-\x0D]+", " ")).otherwise(F.col("t")).alias("t"))
    lines = own.select("id", "h", F.posexplode(F.split("t", "\n", -1)).alias("pos", "raw")).select("id", "h", "pos", F.btrim("raw").alias("line"))
    n = F.when(F.col("line") == "", 0).otherwise(F.octet_length("line") - F.octet_length(F.replace(F.col("line"), F.lit(" "))) + 1)
    lines = lines.withColumn("n", n).where(F.col("n") >= least_words)
    lines = lines.withColumn("one", _index(F.col("line"), F.when(F.col("n") < 2 * DEPTH + 2, F.col("n")).otherwise(DEPTH + F.ceil((F.col("n") - DEPTH) / 2)).cast("int")))
    two = F.when(F.col("n") < 2 * DEPTH + 2, F.col("line").cast("binary")).otherwise(F.substring(F.col("line").cast("binary"), F.octet_length("one") + 1, F.octet_length("line")))
    return lines.select("id", "h", "pos", "line", "n", F.xxhash64("n", "one").alias("a"), F.xxhash64("n", _index(F.col("one"), F.lit(DEPTH)), two).alias("b"))


def _without(docs: DataFrame, lost: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs without the lines at the places _lost of the rows of lost, and n_lines and n_dropped."""
    base = docs.drop("n_lines", "n_dropped")
    joined = base.join(lost, base[id_col].eqNullSafe(lost["_id"]) & (F.xxhash64(base[text_col]) == lost["_h"]), "left").drop("_id", "_h")
    lines = F.split(F.col(text_col), "\n", -1)
    left = let(lines, lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("_lost")), lambda i: F.get(x, i)), "\n"))
    text = F.when(F.col("_lost").isNull(), F.col(text_col)).otherwise(left)
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.length(F.col(text_col)) - F.length(F.replace(F.col(text_col), F.lit("\n"))) + 1)
    lost_here = F.when(F.col("_lost").isNull(), 0).otherwise(F.size("_lost"))
    return joined.select(*[text.alias(c) if c == text_col else F.col(c) for c in base.columns], n_lines.cast("long").alias("n_lines"), lost_here.cast("long").alias("n_dropped"))


def _may_differ(n: Column) -> Column:
    """Tokens in which lines of n tokens may differ."""
    return F.least(F.lit(MOST_DIFFERING), F.greatest(F.lit(1), F.floor(n / 10))).cast("int")


def _sifted(rows: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """The rows whose columns are among those of keys, and few others: what a join with keys need not shuffle is left out.

    That has to be an inner join, as Spark moves semi-joins in front of this one.
    """
    bits = min(max(1 << (8 * keys.count()).bit_length(), LEAST_BITS), MOST_BITS)
    place = F.pmod(F.xxhash64(*columns), F.lit(bits))
    word, bit = F.shiftright(place, 6), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    seen = keys.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    kept = rows.withColumn("_word", word).join(F.broadcast(seen), "_word")  # MOST_BITS / 64 rows of two numbers at the utmost
    return kept.where(F.col("_bits").bitwiseAND(bit) != 0).drop("_word", "_bits")


def _sharing(firsts: DataFrame) -> DataFrame:
    """(side, key, two, rank, a, b): the lines of each template that has more than one, and whether it has two.

    rank is the place where a line first stands. A template of two lines is told from its minimum and maximum.
    """
    ways = F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("key"), F.col("b").alias("other")), F.struct(F.lit(1).alias("side"), F.col("b").alias("key"), F.col("a").alias("other")))
    rank = F.struct("first.none", "first.id", "first.h", "pos").alias("rank")
    keyed = firsts.where("long").select(rank, F.explode(ways).alias("w")).select("w.side", "w.key", F.struct("rank", "w.other").alias("m"))
    held = keyed.groupBy("side", "key").agg(F.count("*").alias("n"), F.min("m").alias("lo"), F.max("m").alias("hi")).where("n > 1")
    held = materialize(held, "held")
    large = held.where("n > 2").select("side", "key")
    many = _sifted(keyed, large, "side", "key").join(large, ["side", "key"]).select("side", "key", F.lit(False).alias("two"), "m")
    twos = held.where("n = 2").select("side", "key", F.lit(True).alias("two"), F.explode(F.array("lo", "hi")).alias("m"))
    pick = lambda side: F.when(F.col("side") == side, F.col("key")).otherwise(F.col("m.other"))
    return materialize(twos.union(many).select("side", "key", "two", "m.rank", pick(0).alias("a"), pick(1).alias("b")), "sharing")


def _buckets(sharing: DataFrame, shown: DataFrame) -> DataFrame:
    """(bucket, rank, a, b): in buckets of more than one, all lines that share a template and can differ in a few tokens only.

    The free half of a line is cut into one piece more than it may have differing tokens, so that such lines agree in a
    piece. Templates of two lines are a bucket each.
    """
    x, half = F.split("line", " ", -1), DEPTH + F.ceil((F.col("n") - DEPTH) / 2)
    t = sharing.join(shown, ["a", "b"]).withColumn("n", F.size(x))
    t = t.withColumn("free", F.when(F.col("side") == 0, F.slice(x, (half + 1).cast("int"), F.col("n"))).otherwise(F.slice(x, DEPTH + 1, (half - DEPTH).cast("int"))))
    size, cuts = F.size("free"), _may_differ(F.col("n")) + 1
    at = lambda k: F.floor(size * k / cuts).cast("int")
    piece = F.transform(F.sequence(F.lit(0), cuts - 1), lambda k: F.xxhash64("side", "key", k, F.array_join(F.slice("free", at(k) + 1, at(k + 1) - at(k)), " ")))
    t = t.select("rank", "a", "b", F.explode(F.when(F.col("two"), F.array(F.xxhash64("side", "key"))).otherwise(piece)).alias("bucket"))
    return t.select("bucket", "rank", "a", "b")


def _near(pairs: DataFrame, shown: DataFrame) -> DataFrame:
    """(a, b, to_a, to_b) of the pairs whose lines differ in a few tokens only."""
    both = pairs.join(shown, ["a", "b"]).join(shown.select(F.col("a").alias("to_a"), F.col("b").alias("to_b"), F.col("line").alias("other")), ["to_a", "to_b"])
    x, y = F.split("line", " ", -1), F.split("other", " ", -1)
    differing = F.aggregate(F.zip_with(x, y, lambda p, q: F.when(p == q, 0).otherwise(1)), F.lit(0), lambda n, d: n + d)
    return materialize(both.where(differing <= _may_differ(F.size(x))).select("a", "b", "to_a", "to_b"), "near")


def _variants(buckets: DataFrame, shown: DataFrame) -> DataFrame:
    """(a, b, to_a, to_b): each line that differs in a few tokens only from an earlier one of a template that stays, and such a one.

    Whether a line goes is settled in the order of the ranks: one goes if an earlier one that it is close to stays. A line
    that is the first in all its buckets stays, and what is close to it there goes; so groups of copies cost a comparison
    a line. When few lines are left, they are compared pair by pair.
    """
    found = []
    while True:
        first = buckets.groupBy("bucket").agg(F.min(F.struct("rank", "a", "b")).alias("lead"), F.count("*").alias("size")).where("size > 1")
        met = materialize(buckets.join(first, "bucket"), "met")
        size = met.agg(F.sum(F.lit(1)).alias("members"), F.sum((F.col("size") - 1) / 2).alias("pairs")).first()
        if not size.members or (found and size.pairs <= MOST_PAIRS * size.members):
            break
        others = materialize(met.where("rank <> lead.rank").select("a", "b", F.col("lead.a").alias("to_a"), F.col("lead.b").alias("to_b")).distinct(), "others")
        later = others.select("a", "b").distinct()
        found.append(_near(others.join(later.select(F.col("a").alias("to_a"), F.col("b").alias("to_b")), ["to_a", "to_b"], "left_anti"), shown))
        left = met.select("bucket", "rank", "a", "b").join(later, ["a", "b"], "left_semi")
        buckets = left.join(found[-1].select("a", "b").distinct(), ["a", "b"], "left_anti")
    if size.members:
        one, two = met.select("bucket", "rank", "a", "b"), met.select("bucket", F.col("rank").alias("to_rank"), F.col("a").alias("to_a"), F.col("b").alias("to_b"))
        edges = _near(one.join(two, "bucket").where("to_rank < rank").select("a", "b", "to_a", "to_b").distinct(), shown)
        while not edges.isEmpty():
            later = edges.select("a", "b").distinct()
            found.append(materialize(edges.join(later.select(F.col("a").alias("to_a"), F.col("b").alias("to_b")), ["to_a", "to_b"], "left_anti").select("a", "b", "to_a", "to_b"), "near"))
            gone = found[-1].select("a", "b").distinct()
            edges = edges.join(gone, ["a", "b"], "left_anti").join(gone.select(F.col("a").alias("to_a"), F.col("b").alias("to_b")), ["to_a", "to_b"], "left_anti")
            edges = materialize(edges.select("a", "b", "to_a", "to_b"), "edges")
    return reduce(DataFrame.union, found) if found else met.select("a", "b", F.col("a").alias("to_a"), F.col("b").alias("to_b"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """docs with text_col without its recurring lines, and the columns n_lines and n_dropped behind the others.

    Lines are what \\n separates; those that stay keep their order and bytes. A line of fewer than least_words tokens is
    never dropped, so empty lines stay. Lines that are equal with their variable fields masked are copies; the document of
    the smallest id keeps them. A line also goes if an earlier one that shares a template with it stays and differs from it
    in MOST_DIFFERING tokens at most (see there), whichever line of the template that is; it stays in the document that
    keeps that one.

    A document is what has an id and a text: rows that are equal in both are one and keep the same lines, rows that share
    an id (or have none) but differ in text are documents of their own. Null ids come behind all others. A null text stays
    null (0 lines). Columns of docs named n_lines or n_dropped are replaced. An empty table gives an empty result.
    """
    before = made()
    lines = parsed_lines(docs, id_col, text_col, least_words)
    long = F.col("n") >= 2 * DEPTH + 2
    held = materialize(lines.select("id", "h", "pos", "a", "b", long.alias("long"), F.when(long, F.col("line")).alias("line")), "lines")
    order = (F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("h").alias("h"))
    first = held.groupBy("a", "b").agg(F.min(F.struct(*order, "pos")).alias("at"), F.max(F.struct(*order)).alias("last"), F.first("long").alias("long"))
    first = first.select("a", "b", F.struct("at.none", "at.id", "at.h").alias("first"), F.col("at.pos").alias("pos"), "long", "last")
    first = materialize(first.select("a", "b", "first", "pos", "long", (F.col("first") != F.col("last")).alias("again")), "firsts")
    sharing = _sharing(first)
    places = materialize(sharing.select("rank.id", "rank.h", "rank.pos").distinct(), "places")
    at = places.select(F.col("id").alias("_id"), F.col("h").alias("_h"), F.col("pos").alias("_pos"))
    here = F.col("id").eqNullSafe(F.col("_id")) & F.col("h").eqNullSafe(F.col("_h")) & (F.col("pos") == F.col("_pos"))
    shown = _sifted(held.where("long"), places, "id", "h", "pos").join(at, here).select("a", "b", "line").dropDuplicates(["a", "b"])  # a line where it first stands
    shown = materialize(shown, "shown")
    near = _variants(_buckets(sharing, shown), shown)
    held = materialize(held.select("id", "h", "pos", "a", "b"), "places")
    release(docs.sparkSession, held, first, near, since=before)  # above all the lines' text
    keeper = first.select(F.col("a").alias("to_a"), F.col("b").alias("to_b"), F.col("first").alias("kept"))
    gone = near.join(keeper, ["to_a", "to_b"]).groupBy("a", "b").agg(F.min("kept").alias("kept"))
    copies = first.where("again").select("a", "b", "first").join(gone, ["a", "b"], "full").select("a", "b", F.coalesce("kept", "first").alias("kept"))
    here = F.struct("id", "h").eqNullSafe(F.struct("kept.id", "kept.h"))
    lost = held.join(copies, ["a", "b"]).where(~here).groupBy(F.col("id").alias("_id"), F.col("h").alias("_h")).agg(F.collect_set("pos").alias("_lost"))
    return _without(docs, lost, id_col, text_col)
