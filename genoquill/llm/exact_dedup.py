"""Exact deduplication by a tree merge of sorted digest runs.

Each partition sorts its digests and keeps one record per digest: a run. Runs then meet in binomial rounds: with radix
R, the record's node number has one base-R digit per round; in round j that digit is replaced by the j-th digit of the
digest, so R nodes exchange R-ths of their runs, each merges the R runs that it gets and retains, per digest, the
smallest identifier, the row that has it and the count. After the last round a node holds one slice of the digest space.
Copies collapse within a partition before anything moves, so a digest that a third of all rows share is sent once per
partition. Every merge verifies that records of a digest agree in the length of the text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANK_RUN, materialize

RADIX = 8


def normalised(text: Column) -> Column:
    """text with each run of `[\\x20\\x09-\\x0D]` replaced by one space; empty for null."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK_RUN, " ")


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (node, digest): one row for each, with the smallest (id, row) and the summed count; streams with a carry of one row."""
    carry: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if carry is not None:
            t = pa.concat_tables([carry, t]).combine_chunks()
        carry = None
        if not t.num_rows:
            continue
        node, digest = t["node"].combine_chunks(), t["digest"].combine_chunks()
        same = np.asarray(pc.and_(pc.equal(node[1:], node[:-1]), pc.equal(digest[1:], digest[:-1])), dtype=bool)
        start = np.flatnonzero(np.concatenate([[True], ~same]))
        group = np.cumsum(np.concatenate([[0], ~same]))
        size = t["size"].to_numpy()
        if (size[start][group] != size).any():
            raise ValueError("texts of different lengths share a digest")
        ids, row = t["id"].combine_chunks(), t["row"].to_numpy()
        order = pc.sort_indices(pa.table({"g": group, "i": ids, "r": row}), sort_keys=[("g", "ascending"), ("i", "ascending"), ("r", "ascending")], null_placement="at_end").to_numpy()
        best = order[np.searchsorted(group[order], np.arange(len(start)))]
        out = pa.table({"node": node.take(start), "digest": digest.take(start), "size": size[start], "id": ids.take(best), "row": row[best], "n": np.add.reduceat(t["n"].to_numpy(), start)}).cast(t.schema)
        carry = out.slice(out.num_rows - 1)
        yield from out.slice(0, out.num_rows - 1).combine_chunks().to_batches()
    if carry is not None:
        yield from carry.combine_chunks().to_batches()


def merge_runs(digests: DataFrame, radix: int = RADIX) -> DataFrame:
    """(digest, size, id, row, n) for each digest of digests (digest binary, size, id, row): smallest id, its row, count."""
    parts = int(digests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rounds = max(1, math.ceil(math.log(max(parts, 2), radix) - 1e-9))
    nodes = radix**rounds
    schema = T.StructType([T.StructField(n, t) for n, t in (("node", T.IntegerType()), ("digest", T.BinaryType()), ("size", T.LongType()), ("id", digests.schema["id"].dataType), ("row", T.LongType()), ("n", T.LongType()))])
    run = digests.select(F.pmod(F.spark_partition_id(), F.lit(nodes)).cast("int").alias("node"), "digest", F.col("size").cast("long").alias("size"), "id", "row", F.lit(1).cast("long").alias("n"))
    run = run.sortWithinPartitions("node", "digest").mapInArrow(_collapse, schema)
    slice_of = F.pmod(F.xxhash64("digest"), F.lit(nodes)).cast("int")
    for j in range(rounds):
        unit = radix**j
        digit = lambda c, u=unit: F.pmod(F.floor(c / u), F.lit(radix)).cast("int")
        run = run.withColumn("node", (F.col("node") + (digit(slice_of) - digit(F.col("node"))) * unit).cast("int"))
        run = run.repartition(parts, "node").sortWithinPartitions("node", "digest").mapInArrow(_collapse, schema)
    return run.drop("node")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radix: int = RADIX) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256 (of the text with white space made single).

    Null text counts as empty. keep_id is the smallest id of the equal texts, nulls last; of rows that repeat this id, one
    is kept. Other columns are ignored, an empty table gives an empty result.
    """
    text = normalised(F.col(text_col))
    own = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("size")).withColumn("row", F.monotonically_increasing_id())
    own = materialize(own, "digests")
    groups = merge_runs(own, radix).where("n > 1").select("digest", F.col("id").alias("keep_id"), F.col("row").alias("keep_row"), F.col("n").alias("group_size"))
    return own.join(groups, "digest", "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
