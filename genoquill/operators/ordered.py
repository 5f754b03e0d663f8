"""Operators on ordered rows: percentiles, gaps, and scans whose state depends on the rows kept so far."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import variants as V
from ..storage import stored


def _index(n: Column, p: float) -> Column:
    """Index of a percentile: n p - 0.5 rounded half away from zero, within 0 and n - 1."""
    x = n * F.lit(float(p)) - F.lit(0.5)
    rounded = F.when(x < 0, -F.floor(-x + 0.5)).otherwise(F.floor(x + 0.5))
    return F.greatest(F.least(rounded, n - 1), F.lit(0)).cast("long")


def _counted(df: DataFrame, column: str, by: Sequence[str], weight: str | None = None) -> DataFrame:
    """(by, column, _n, _before, _all): rows of each value, rows of smaller values, and all rows of the key. Nulls are left out.
    A row counts as often as its weight says.

    Values are counted first and then dealt by range, so that neither a key nor a frequent value becomes one task: what a range
    holds below a value is a running sum in the range, and only the ranges' totals meet by key.
    """
    n = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg((F.sum(weight) if weight else F.count("*")).alias("_n"))
    n = stored(n.repartitionByRange(F.col(column)).withColumn("_range", F.spark_partition_id()), "counts")
    per = n.groupBy(*by, "_range").agg(F.sum("_n").alias("_sum"))
    whole = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    per = per.withColumn("_offset", F.coalesce(F.sum("_sum").over(whole.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", F.sum("_sum").over(whole))
    inside = F.coalesce(F.sum("_n").over(W.partitionBy(*by, "_range").orderBy(column).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    t = n.withColumn("_inside", inside).alias("t")
    per = per.alias("o")
    same = F.col("t._range") == F.col("o._range")
    for c in by:
        same = same & F.col(f"t.{c}").eqNullSafe(F.col(f"o.{c}"))
    return t.join(per, same).select(*[F.col(f"t.{c}") for c in (*by, column, "_n")], (F.col("_inside") + F.col("_offset")).alias("_before"), "_all")


def percentiles(df: DataFrame, column: str, ps: Sequence[float], by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """(by, p, value): the sorted value at the percentile's index. Nulls are left out. A row counts as often as its weight says."""
    q = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("p"), _index(F.col("_all"), p).alias("i")) for p in ps])).alias("_q")
    t = _counted(df, column, by, weight).select(*by, column, "_before", "_n", q)
    return t.where("_q.i >= _before AND _q.i < _before + _n").select(*by, F.col("_q.p").alias("p"), F.col(column).alias("value"))


def _between(df: DataFrame, column: str, lowest, highest, by: Sequence[str]) -> DataFrame:
    """Rows of df whose index in the order of column lies in [lowest, highest), both functions of the rows' number; nulls are left out.

    Of rows of one value that a bound cuts, those of the smallest hashes come first.
    """
    c = _counted(df, column, by).withColumns({"_lo": lowest(F.col("_all")), "_hi": highest(F.col("_all"))})
    c = c.where((F.col("_before") < F.col("_hi")) & (F.col("_before") + F.col("_n") > F.col("_lo")))
    cut = c.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate((*by, column))], (F.col("_lo") - F.col("_before")).alias("_from"), (F.col("_hi") - F.col("_before")).alias("_to"), "_n")
    same = F.lit(True)
    for i, k in enumerate((*by, column)):
        same = same & df[k].eqNullSafe(F.col(f"_k{i}"))
    t = df.join(cut, same).withColumn("_whole", (F.col("_from") <= 0) & (F.col("_to") >= F.col("_n")))
    edge = t.where(~F.col("_whole")).withColumn("_at", F.row_number().over(W.partitionBy(*[f"_k{i}" for i in range(len(by) + 1)]).orderBy(F.xxhash64(*df.columns))) - 1)
    edge = edge.where((F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_to")))
    return t.where("_whole").select(*df.columns).union(edge.select(*df.columns))


def percentile_range(df: DataFrame, column: str, bottom: float, top: float, by: Sequence[str] = ()) -> DataFrame:
    """Rows between two percentile indexes, the upper one excluded."""
    return _between(df, column, lambda n: _index(n, bottom), lambda n: _index(n, top), by)


def inverse_percentile(df: DataFrame, column: str, value: float, by: Sequence[str] = ()) -> DataFrame:
    """Index of the first element that isn't below value, over n - 1; 1 for one element; the last index past the end."""
    n, below = F.count(column), F.count_if(F.col(column) < value)
    return df.groupBy(*by).agg(F.when(n == 1, 1.0).when(n > 1, F.least(below, n - 1) / (n - 1)).alias("percentile"))


def geq_count(df: DataFrame, column: str, value: float, by: Sequence[str] = (), compat: bool = True) -> DataFrame:
    """Elements at or above value; with compat 1 if there is none."""
    n = F.count_if(F.col(column) >= value)
    return df.groupBy(*by).agg((F.greatest(n, F.lit(1)) if compat else n).alias("n"))


def percentile_slice(df: DataFrame, column: str, bottom: float, top: float, by: Sequence[str] = ()) -> DataFrame:
    """Rows whose sorted index lies between floor(n bottom) and floor(n top), both included. Nulls are left out."""
    return _between(df, column, lambda n: F.floor(n * F.lit(float(bottom))), lambda n: F.floor(n * F.lit(float(top))) + 1, by)


def tile_gaps(df: DataFrame, size: int) -> DataFrame:
    """Per contig and tile: loci, the largest gap between neighbouring loci or to the tile's ends, and the mean gap (sum over n + 1)."""
    t = df.select("contig_id", "pos").distinct().withColumn("tile", F.floor(F.col("pos") / size))
    w = W.partitionBy("contig_id", "tile").orderBy("pos")
    t = t.withColumn("gap", F.col("pos") - F.coalesce(F.lag("pos").over(w), F.col("tile") * size - 1))
    g = t.groupBy("contig_id", "tile").agg(F.count("*").alias("n"), F.max("gap").alias("m"), F.sum("gap").alias("s"), F.max("pos").alias("last"))
    tail = (F.col("tile") + 1) * size - 1 - F.col("last")
    return g.select("contig_id", "tile", "n", F.greatest("m", tail).alias("max_gap"), ((F.col("s") + tail) / (F.col("n") + 1)).alias("mean_gap"))


def gap_to_previous(df: DataFrame, by: Sequence[str] = ("contig_id",), pos: str = "pos") -> DataFrame:
    """(by, pos, gap) of distinct positions, the first one's gap null."""
    return df.select(*by, pos).distinct().withColumn("gap", F.col(pos) - F.lag(pos).over(W.partitionBy(*by).orderBy(pos)))


def top_n(df: DataFrame, column: str, n: int, *ties: str) -> DataFrame:
    return df.orderBy(F.col(column).desc(), *ties).limit(n)


def upstream_deletes(df: DataFrame, keys: Sequence[str] = ("genome_id", "contig_id"), pos: str = "pos", order: Sequence[str] = ("vcf_line", "part", "supp")) -> DataFrame:
    """df without the rows that an earlier kept delete has removed; a kept delete removes what its interval intersects.

    Only deletes change what is removed: their places and ends alone are scanned in order, per contig of a genome, to find
    those that stay. Every row is then held against the end of the last delete that stays before it.
    """
    by = [pos, *order]
    t = df.withColumn("_m", V.modify_interval(pos=pos)).withColumns({"_lo": F.col("_m.lower"), "_up": F.col("_m.upper"), "_del": (F.col("_m.kind") == "DELETE") & (F.col("_m.upper") > F.col("_m.lower"))}).drop("_m")
    deletes = t.where("_del").select(*keys, *by, "_lo", "_up")

    def scan(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(by, kind="stable")
        reach, keep = -1, []
        for lo, up in zip(rows["_lo"], rows["_up"], strict=True):
            keep.append(lo >= reach)
            reach = up if keep[-1] else reach
        return rows[keep]

    kept = deletes.groupBy(*keys).applyInPandas(scan, deletes.schema).select(*keys, *by, F.col("_up").alias("_reach"))
    events = t.select(*keys, *by, "_lo", F.lit(None).cast("long").alias("_reach"), F.struct(*df.columns).alias("_row"))
    marks = kept.select(*keys, *by, F.lit(None).cast("long").alias("_lo"), F.col("_reach").cast("long"), F.lit(None).cast(events.schema["_row"].dataType).alias("_row"))
    before = W.partitionBy(*keys).orderBy(*by, F.col("_reach").isNotNull()).rowsBetween(W.unboundedPreceding, -1)
    judged = events.union(marks).withColumn("_till", F.max("_reach").over(before))
    return judged.where(F.col("_row").isNotNull() & (F.col("_till").isNull() | (F.col("_lo") >= F.col("_till")))).select("_row.*")


def spaced_loci(df: DataFrame, spacing: int, lowest: float = 0.0, highest: float = 1.0, most: int | None = None, keys: Sequence[str] = ("contig_id",), pos: str = "pos", af: str = "af") -> DataFrame:
    """Per key the loci taken from the left, each at least spacing behind the one before, with frequencies within bounds; the first `most`.

    Frequencies of a locus are averaged before the scan, so that the scan sees each locus of a key once.
    """
    loci = df.where((F.col(af) >= lowest) & (F.col(af) <= highest)).groupBy(*keys, pos).agg(F.avg(af).alias(af))

    def scan(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(pos)
        keep, last, left = [], None, len(rows) if most is None else most
        for p in rows[pos]:
            take = left > 0 and (last is None or p - last >= spacing)
            keep.append(take)
            if take:
                last, left = p, left - 1
        return rows[keep]

    return loci.groupBy(*keys).applyInPandas(scan, loci.schema)


def cumulative_shift(df: DataFrame, keys: Sequence[str] = ("genome_id", "contig_id"), pos: str = "pos") -> DataFrame:
    """df with shift: the summed length change of the indels strictly before each row."""
    w = W.partitionBy(*keys).orderBy(pos).rangeBetween(W.unboundedPreceding, -1)
    return df.withColumn("shift", F.coalesce(F.sum(F.length("alt") - F.length("ref")).over(w), F.lit(0)))
