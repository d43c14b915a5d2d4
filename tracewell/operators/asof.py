"""As-of joins by a union of both sides and one window: one shuffle and sort on the key, no nested loop."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def around(probes: DataFrame, samples: DataFrame, by: str, ts: str, values: list[str], back: bool = True, ahead: bool = True) -> DataFrame:
    """Probes with before and after: structs (ts, *values) of the samples at or before and at or after each.

    Samples of equal time count on both sides; of samples that tie, the largest is before and the smallest after. Null where
    there is none. Either side can be left out; each is a running last value over one sorted pass, so a key of n rows takes n steps.
    """
    names = [c for c in probes.columns if c not in (by, ts)]
    kinds = {f.name: f.dataType.simpleString() for f in samples.schema}
    sample = F.struct(F.col(ts).alias("ts"), *[F.col(v) for v in values])
    shape = f"struct<ts:{kinds[ts]}," + ",".join(f"{v}:{kinds[v]}" for v in values) + ">"
    p = probes.select(by, ts, *names, F.lit(None).cast(shape).alias("__s"), F.lit(1).alias("__side"))
    s = samples.select(by, ts, *[F.lit(None).cast(probes.schema[n].dataType).alias(n) for n in names], sample.alias("__s"), F.lit(0).alias("__side"))
    both = p.unionByName(s)
    running = lambda *order: Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    if back:
        both = both.withColumn("before", F.last("__s", True).over(running(ts, "__side", "__s")))
    if ahead:  # the same, from the end: nulls of probes come after the samples of their time
        both = both.withColumn("after", F.last("__s", True).over(running(F.col(ts).desc(), "__side", F.col("__s").desc())))
    return both.filter("__side = 1").drop("__s", "__side")


def neighbours(probes: DataFrame, samples: DataFrame, by: str, ts: str, value: str, id_col: str, **sides: bool) -> DataFrame:
    """around() for one value as a double and times in whole numbers."""
    samples = samples.select(by, F.col(ts).cast("bigint").alias(ts), F.col(value).cast("double").alias("value"))
    return around(probes.select(by, ts, id_col), samples, by, ts, ["value"], **sides)


def last_before(probes: DataFrame, samples: DataFrame, by: str, ts: str, values: list[str], name: str) -> DataFrame:
    """Probes with name: the struct (ts, *values) of the last sample at or before each."""
    return around(probes, samples, by, ts, values, ahead=False).withColumnRenamed("before", name)


def interpolated(ts: str) -> Column:
    """Linear between the neighbours, clamped to the one there is at either end."""
    b, a = F.col("before"), F.col("after")
    share = (F.col(ts) - b["ts"]) / (a["ts"] - b["ts"])
    return F.when(b.isNull(), a["value"]).when(a.isNull() | (a["ts"] == b["ts"]), b["value"]).otherwise(b["value"] + share * (a["value"] - b["value"]))


def nearest_within(ts: str, tolerance_us: int) -> Column:
    """The sample at or after the probe if within tolerance, else that before if within it, else null."""
    b, a = F.col("before"), F.col("after")
    return F.when(a["ts"] - F.col(ts) <= tolerance_us, a["value"]).when(F.col(ts) - b["ts"] <= tolerance_us, b["value"])


def gap_limited(ts: str, gap_us: int, tolerance_us: int) -> Column:
    """Interpolation over gaps of gap_us at most; else the nearer sample within tolerance (ties: before), else null."""
    b, a = F.col("before"), F.col("after")
    to_b, to_a = F.coalesce(F.col(ts) - b["ts"], F.lit(1 << 62)), F.coalesce(a["ts"] - F.col(ts), F.lit(1 << 62))
    near = F.when((to_b <= to_a) & (to_b <= tolerance_us), b["value"]).when(to_a <= tolerance_us, a["value"])
    return F.when(a["ts"] - b["ts"] <= gap_us, interpolated(ts)).otherwise(near)
