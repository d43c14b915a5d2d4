"""Profiles of streams: counts, rates, gaps, windows of time, sampling, cutting. Times are whole microseconds."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import at_ranks, nearest_rank, placed
from .settle import settled


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone is."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def summary(rows: DataFrame, stream: str, ts: str) -> DataFrame:
    """Per stream: n, start_us, end_us, duration in seconds and rate, 0 where the duration is 0. One partial aggregate."""
    g = rows.groupBy(stream).agg(F.count("*").alias("n"), F.min(ts).alias("start_us"), F.max(ts).alias("end_us"))
    span = F.col("end_us") - F.col("start_us")
    return g.withColumn("duration_s", span / 1e6).withColumn("hz", F.when(span > 0, F.col("n") / (span / 1e6)).otherwise(F.lit(0.0)))


def with_gap(rows: DataFrame, stream: str, ts: str, *ties: str) -> DataFrame:
    """rows with gap_us to the row before in the stream; null for its first."""
    out = placed(rows, [stream], [ts, *ties], before={"__before": ts})
    return out.withColumn("gap_us", F.col(ts) - F.col("__before")).drop("__before")


def gaps(rows: DataFrame, stream: str, ts: str) -> DataFrame:
    """Per stream with two rows: the largest gap, the 99th percentile by nearest rank, the mean, and the ratios of the first two to the mean (null if it is 0)."""
    between = settled(with_gap(rows.select(stream, ts), stream, ts).filter("gap_us IS NOT NULL"))
    whole = between.groupBy(stream).agg(F.max("gap_us").alias("max_gap_us"), (F.sum("gap_us") / F.count("*")).alias("mean_gap_us"))
    out = whole.join(at_ranks(between, [stream], "gap_us", {"p99_gap_us": nearest_rank(0.99)}), stream)
    mean = F.nullif("mean_gap_us", F.lit(0.0))
    return out.withColumn("max_ratio", F.col("max_gap_us") / mean).withColumn("p99_ratio", F.col("p99_gap_us") / mean)


def first_seconds(rows: DataFrame, stream: str, ts: str, seconds: float, exempt: Column | None = None) -> DataFrame:
    """Rows within the first seconds of their own stream, both ends included; streams that exempt picks are kept whole."""
    begin = rows.groupBy(stream).agg(F.min(ts).alias("__begin"))
    kept = F.col(ts) <= F.col("__begin") + int(seconds * 1_000_000)
    return rows.join(begin, stream).filter(kept if exempt is None else kept | exempt).drop("__begin")


def every_nth(rows: DataFrame, stream: str, order: list[str], n: int) -> DataFrame:
    """Every n-th row of each stream, its first included."""
    return placed(rows, [stream], order, rank="__i").filter(F.col("__i") % n == 0).drop("__i")


def first_rows(rows: DataFrame, stream: str, order: list, n: int) -> DataFrame:
    w = Window.partitionBy(stream).orderBy(*order)
    return rows.withColumn("__i", F.row_number().over(w)).filter(F.col("__i") <= n).drop("__i")


def cut(rows: DataFrame, ts: str, at_us: int) -> tuple[DataFrame, DataFrame]:
    """Head and tail: no row is in both and none is lost."""
    return rows.filter(F.col(ts) < at_us), rows.filter(F.col(ts) >= at_us)


def carry_over(rows: DataFrame, stream: str, ts: str, at_us: int, tie: str) -> DataFrame:
    """The last row before at_us of each stream that has no row from then on."""
    head, tail = cut(rows, ts, at_us)
    gone = head.join(tail.select(stream).distinct(), stream, "left_anti")
    return first_rows(gone, stream, [F.col(ts).desc(), F.col(tie).desc()], 1)
