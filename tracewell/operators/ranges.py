"""Ranks, neighbours and exact percentiles of ordered streams, without a task that holds a stream.

Rows are dealt in ranges of (stream, order), so a stream of any share of the rows lies in as many ranges as its rows fill. What a range
knows of itself (its rows per stream, the first and the last) is one row for each stream in it; sums over these rows give
every range its offset, and its neighbours' ends. Percentiles need no order at all: counts of cells of values, narrowed
round by round to the cell that holds the rank, are all that is shuffled.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .settle import settled

#: Rows that a range is meant to hold at most.
RANGE_ROWS = 500_000
#: Rows that are worth a range of their own, however many partitions a shuffle has.
LEAST_ROWS = 1000
#: Cells that a round of percentiles divides a stream's values into.
CELLS = 4096
#: Targets of percentiles up to which each task gets all of them.
SMALL = 10_000
PART = "__part"


def ranged(rows: DataFrame, by: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """rows, settled in ranges of (by, order) and sorted in each, with the range's number: ranges of higher numbers come later."""
    if parts is None:
        n = rows.count()
        parts = max(1, -(-n // RANGE_ROWS), min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // LEAST_ROWS)))
    at = rows.repartitionByRange(parts, *by, *order).sortWithinPartitions(*by, *order)
    return settled(at.withColumn(PART, F.spark_partition_id()))


def placed(
    rows: DataFrame, by: list[str], order: list[str], rank: str | None = None, total: str | None = None,
    before: dict[str, str] | None = None, after: dict[str, str] | None = None, parts: int | None = None,
) -> DataFrame:
    """rows with their place in the stream: rank (from 0), total rows, and columns of the row before and after under new names.

    order must tell rows of a stream apart, or ties are numbered in any order. Null keys are a stream of their own. The row before a
    stream's first, and after its last, is null.
    """
    before, after = before or {}, after or {}
    at = ranged(rows, by, order, parts)
    local = Window.partitionBy(PART, *by).orderBy(*order)
    ends = {x: F.struct(*order, *[F.col(c).alias(f"__{i}") for i, c in enumerate(names.values())]) for x, names in (("last", before), ("first", after))}
    heads = at.groupBy(PART, *by).agg(F.count("*").alias("__rows"), *[f(ends[x]).alias(f"__{x}") for x, f, names in (("last", F.max, before), ("first", F.min, after)) if names])
    ahead = Window.partitionBy(*by).orderBy(PART)
    heads = heads.withColumn("__offset", F.coalesce(F.sum("__rows").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if total:
        heads = heads.withColumn("__total", F.sum("__rows").over(Window.partitionBy(*by)))
    if before:
        heads = heads.withColumn("__last", F.lag("__last").over(ahead))
    if after:
        heads = heads.withColumn("__first", F.lead("__first").over(ahead))
    out = at.withColumn("__i", F.row_number().over(local) - 1)
    for name, column in before.items():
        out = out.withColumn(f"__b_{name}", F.lag(column).over(local))
    for name, column in after.items():
        out = out.withColumn(f"__a_{name}", F.lead(column).over(local))
    keys = [PART, *by]
    heads = heads.select(*[F.col(k).alias(f"__h_{i}") for i, k in enumerate(keys)], *[c for c in heads.columns if c not in keys])
    met = F.lit(True)
    for i, k in enumerate(keys):
        met = met & F.col(k).eqNullSafe(F.col(f"__h_{i}"))
    out = out.join(heads, met)
    new = [(F.col("__i") + F.col("__offset")).alias(rank)] if rank else []
    new += [F.col("__total").alias(total)] if total else []
    new += [F.when(F.col("__i") == 0, F.col(f"__last.__{i}")).otherwise(F.col(f"__b_{name}")).alias(name) for i, name in enumerate(before)]
    new += [F.when(F.col("__i") == F.col("__rows") - 1, F.col(f"__first.__{i}")).otherwise(F.col(f"__a_{name}")).alias(name) for i, name in enumerate(after)]
    return out.select(*rows.columns, *new)


def at_ranks(rows: DataFrame, by: list[str], value: str, ranks: dict[str, Column], most_rounds: int = 250) -> DataFrame:
    """Per stream the value at each rank (from 0, by ascending value); ranks: expressions over n, the stream's count of values.

    Null and NaN do not count; a stream without values has no row, a rank outside 0 to n - 1 gives null. Each round
    counts the values by cells between the least and the most that are still possible, and keeps the cell that holds the rank.
    """
    base = rows.select(*by, F.col(value).alias("__v")).filter(F.col("__v").isNotNull() & ~F.isnan(F.col("__v").cast("double")))
    size = base.groupBy(*by).agg(F.count("*").alias("n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, rank in ranks.items()]))
    open_ = size.select(*by, "__lo", "__hi", "n", wanted.alias("t")).select(*by, "t.name", F.col("t.rank").alias("__rank"), "__lo", "__hi", "n")
    open_ = open_.withColumn("__done", F.col("__rank").isNull() | (F.col("__rank") < 0) | (F.col("__rank") >= F.col("n")) | (F.col("__lo") == F.col("__hi")))
    some = open_.limit(SMALL + 1).collect()
    few = len(some) <= SMALL
    # few targets are kept by the driver, which saves a round its files
    hold = lambda df: rows.sparkSession.createDataFrame(df.collect(), df.schema) if few else settled(df)
    open_ = rows.sparkSession.createDataFrame(some, open_.schema) if few else settled(open_)
    done = open_.filter("__done")
    for _ in range(most_rounds):
        open_ = open_.filter("NOT __done")
        if open_.isEmpty():
            break
        names = [F.col(k).alias(f"__k_{i}") for i, k in enumerate(by)]
        targets = open_.select(*names, "name", "__rank", "__lo", "__hi", "n")
        met = (F.col("__v") >= F.col("__lo")) & (F.col("__v") <= F.col("__hi"))
        for i, k in enumerate(by):
            met = met & F.col(k).eqNullSafe(F.col(f"__k_{i}"))
        lo, hi = F.col("__lo").cast("double"), F.col("__hi").cast("double")
        # halves, as the span itself may be no double; a value's share of it is monotone, so cells are in order
        share = (F.col("__v").cast("double") / 2 - lo / 2) / (hi / 2 - lo / 2)
        cell = F.when(F.col("__v") == F.col("__lo"), 0).when(F.col("__v") == F.col("__hi"), CELLS + 1).otherwise(1 + F.least(F.floor(share * CELLS), F.lit(CELLS - 1)))
        counted = base.join(F.broadcast(targets) if few else targets, met).groupBy(*by, "name", cell.alias("__cell"))
        counted = counted.agg(F.count("*").alias("__c"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.first("__rank").alias("__rank"), F.first("n").alias("n"))
        upto = F.sum("__c").over(Window.partitionBy(*by, "name").orderBy("__cell"))
        held = counted.withColumn("__upto", upto).filter("__upto > __rank AND __upto - __c <= __rank")
        open_ = hold(held.select(*by, "name", (F.col("__rank") - F.col("__upto") + F.col("__c")).alias("__rank"), "__lo", "__hi", "n", (F.col("__lo") == F.col("__hi")).alias("__done")))
        done = done.unionByName(open_.filter("__done"))
    else:
        raise RuntimeError("percentiles did not settle")
    found = F.when((F.col("__rank") >= 0) & (F.col("__rank") < F.col("n")), F.col("__lo"))
    return done.groupBy(*by).agg(*[F.max(F.when(F.col("name") == name, found)).alias(name) for name in ranks])


def linear_percentile(rows: DataFrame, by: list[str], value: str, p: float, name: str) -> DataFrame:
    """Per stream the percentile that lies between its two nearest ranks, in proportion."""
    at = F.lit(p) * (F.col("n") - 1)
    n = rows.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*by).agg(F.count("*").alias("n"))
    near = at_ranks(rows, by, value, {"__lo": F.floor(at), "__hi": F.ceil(at)})
    met = F.lit(True)
    for k in by:
        met = met & F.col(k).eqNullSafe(F.col(f"__n_{k}"))
    out = near.join(n.select(*[F.col(k).alias(f"__n_{k}") for k in by], "n"), met)
    return out.select(*by, (F.col("__lo") + (F.col("__hi") - F.col("__lo")) * (at - F.floor(at))).alias(name))


def nearest_rank(p: float) -> Column:
    """The nearest-rank percentile's place."""
    return F.ceil(F.lit(p) * F.col("n")) - 1


def floor_rank(p: float) -> Column:
    """The place floor(p n), the last at most."""
    return F.least(F.col("n") - 1, F.floor(F.lit(p) * F.col("n")))
