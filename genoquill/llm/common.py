"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_dir

#: The white space that separates words: the space and the characters 9 to 13.
BLANKS = " \t\n\x0b\x0c\r"
#: The same as a Java regular expression.
BLANK_RUN = r"[\x20\x09-\x0D]+"

#: Tables that materialize has written and release has not removed, in order.
_MADE: list[str] = []


def made() -> int:
    """A mark for release: tables written later are those since the mark."""
    return len(_MADE)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts the lineage, and a lost executor loses nothing."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _MADE.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, *keep: DataFrame, since: int = 0) -> None:
    """Remove the tables that materialize has written since a mark of made, without those that the frames of keep are read from."""
    kept = [f.rpartition("/")[0] for df in keep for f in df.inputFiles()]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    left = []
    for path in _MADE[since:]:
        if any(f.endswith(path.rpartition("/")[2]) for f in kept):
            left.append(path)
            continue
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    _MADE[since:] = left


def give_back() -> None:
    """Return free memory to the system: workers live on after a task, and others need it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a function of a task's Arrow batches, that gives memory back at its end."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Array of the words `[^\\x20\\x09-\\x0D]+` of text; empty for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
