"""Changes to a recording as new tables: rows of (stream, id, ts, ...) go in and come out, nothing is changed in place.

On a lake a change of one stream rewrites that stream's partition only; these are the row sets to be written.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import placed


def rename_stream(rows: DataFrame, names: dict[str, str], stream: str = "stream") -> DataFrame:
    """Streams under other names. A name that is no identifier is refused, and one that two streams would have, whether both are renamed or one has it."""
    for new in names.values():
        if not new.replace("_", "a").isalnum() or new[0].isdigit():
            raise ValueError(f"{new!r} is no stream name")
    if len(set(names.values())) < len(names):
        raise ValueError("two streams would have one name")
    taken = [new for new in names.values() if new not in names]
    if taken and not rows.filter(F.col(stream).isin(*taken)).isEmpty():
        raise ValueError(f"the recording has a stream of the name {' or '.join(taken)}")
    out = F.col(stream)
    for old, new in names.items():
        out = F.when(F.col(stream) == old, new).otherwise(out)
    return rows.withColumn(stream, out)


def without(rows: DataFrame, streams: list[str], stream: str = "stream") -> DataFrame:
    return rows.filter(~F.col(stream).isin(*streams))


def copied(rows: DataFrame, source: str, to: str, stream: str = "stream", order: tuple[str, ...] = ("ts",), new_id: str = "id") -> DataFrame:
    """rows and a copy of one stream under another name, its ids numbered anew from 1."""
    numbered = placed(rows.filter(F.col(stream) == source), [stream], list(order), rank="__i").withColumn(new_id, (F.col("__i") + 1).cast(rows.schema[new_id].dataType)).drop("__i")
    return rows.unionByName(numbered.withColumn(stream, F.lit(to)))


def appended(rows: DataFrame, other: DataFrame, streams: list[str], overwrite: bool, stream: str = "stream") -> DataFrame:
    """rows with streams of another recording; those that rows has are replaced, or refused."""
    mine = without(rows, streams, stream)
    if not overwrite and not rows.filter(F.col(stream).isin(*streams)).isEmpty():
        raise ValueError("the recording has such a stream")
    return mine.unionByName(other.filter(F.col(stream).isin(*streams)))


def renamed_frame(frame: Column, explicit: dict[str, str], prefix: str | None = None, kept: tuple[str, ...] = ()) -> Column:
    """An explicit name first; else the prefix, but for frames that are kept."""
    out = frame if prefix is None else F.when(frame.isin(*kept), frame).otherwise(F.concat(F.lit(prefix), frame)) if kept else F.concat(F.lit(prefix), frame)
    for old, new in explicit.items():
        out = F.when(frame == old, new).otherwise(out)
    return out


def with_static_edges(rows: DataFrame, edges: DataFrame, ts: str, every: int) -> DataFrame:
    """rows (child, parent, ts, ...) and the edges (child, parent, ...): once at the first stamp, and again every so often to the last.

    The span is one row; stamps are a sequence made where the edges are, so nothing depends on the order of rows.
    """
    span = rows.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    again = edges.join(F.broadcast(span), how="cross").withColumn(ts, F.explode(F.expr(f"sequence(lo, hi, CAST({every} AS BIGINT))"))).drop("lo", "hi")
    return rows.unionByName(again, allowMissingColumns=True)


def rerooted(edges: DataFrame, path: DataFrame) -> DataFrame:
    """Edges (child, parent, x) with those on path (child) turned round: child and parent change places and x its sign."""
    turned = edges.join(path.select("child").distinct(), "child", "left_semi").select(F.col("parent").alias("child"), F.col("child").alias("parent"), (-F.col("x")).alias("x"))
    return edges.join(path.select("child").distinct(), "child", "left_anti").select("child", "parent", "x").unionByName(turned)


def cut_with_carry(rows: DataFrame, at: int, stream: str = "stream", ts: str = "ts", tie: str = "id") -> tuple[DataFrame, DataFrame]:
    """Head and tail at a time; the tail also has, stamped with the cut, the last row of each stream that has none in it."""
    head, tail = rows.filter(F.col(ts) < at), rows.filter(F.col(ts) >= at)
    names = [c for c in rows.columns if c != stream]
    last = head.groupBy(stream).agg(F.max_by(F.struct(*names), F.struct(ts, tie)).alias("r"))
    carried = last.join(tail.select(stream).distinct(), stream, "left_anti").select(stream, "r.*").withColumn(ts, F.lit(at).cast(rows.schema[ts].dataType))
    return head, tail.unionByName(carried)
