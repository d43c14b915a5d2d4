"""Frame trees and dataflow graphs as edge tables (child, parent)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .settle import settled


def roots(edges: DataFrame) -> DataFrame:
    """Parents that are no child."""
    return edges.select(F.col("parent").alias("frame")).distinct().join(edges.select(F.col("child").alias("frame")).distinct(), "frame", "left_anti")


def two_parents(edges: DataFrame) -> DataFrame:
    return edges.groupBy("child").agg(F.countDistinct("parent").alias("n_parents")).filter("n_parents > 1")


def first_parents(edges: DataFrame, order: str) -> DataFrame:
    return edges.groupBy("child").agg(F.min_by("parent", order).alias("parent"))


def climbed(edges: DataFrame, marked: DataFrame | None = None) -> DataFrame:
    """(frame, top, depth, low, seen, open) of single-parent edges, of any depth.

    top is the frame's root and depth the steps to it; seen says whether a frame above it is of marked (frame). Each round
    joins every frame's climb to that of where it ends, so climbs double and a tree of depth d takes about log2(d) rounds. open
    marks frames that end in a cycle: their top is on it, and low is the least frame that their climb passes, the start included.
    """
    at = edges.select(F.col("child").alias("frame"), F.col("parent").alias("top"), F.lit(1).cast("long").alias("depth"), F.col("child").alias("low"))
    if marked is None:
        at = at.withColumn("seen", F.lit(False))
    else:
        at = at.join(marked.select(F.col("frame").alias("top"), F.lit(True).alias("seen")).distinct(), "top", "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
    at = settled(at.select("frame", "top", "depth", "low", "seen"))
    for _ in range(max(1, at.count()).bit_length() + 1):
        up = at.select(F.col("frame").alias("top"), F.col("top").alias("__top"), F.col("depth").alias("__depth"), F.col("low").alias("__low"), F.col("seen").alias("__seen"))
        more = at.drop("open").join(up, "top", "left")
        at = settled(
            more.select(
                "frame", F.coalesce("__top", "top").alias("top"), (F.col("depth") + F.coalesce("__depth", F.lit(0))).alias("depth"),
                F.least("low", "__low").alias("low"), (F.col("seen") | F.coalesce("__seen", F.lit(False))).alias("seen"), F.col("__top").isNotNull().alias("open"),
            )
        )
        if at.filter("open").isEmpty():
            break
    return at


def in_cycles(edges: DataFrame) -> DataFrame:
    """Frames that reach themselves, with the length of their cycle."""
    at = climbed(edges).filter("open")
    on = at.select("frame", "low").join(at.select(F.col("top").alias("frame")).distinct(), "frame", "left_semi")
    return on.join(on.groupBy("low").agg(F.count("*").alias("length")), "low").select("frame", "length")


def root_of(edges: DataFrame) -> DataFrame:
    """(frame, root, depth): the ancestor that is itself no child."""
    return climbed(edges).filter("NOT open").select("frame", F.col("top").alias("root"), "depth")


def hops(edges: DataFrame, start: DataFrame, most: int = 1000) -> DataFrame:
    """(frame, hops) of all frames that edges, taken either way, join to start (frame): a round for each step."""
    both = settled(edges.select(F.col("child").alias("frame"), F.col("parent").alias("next")).union(edges.select("parent", "child")).distinct())
    reached = front = settled(start.select("frame").distinct().withColumn("hops", F.lit(0)))
    for n in range(1, most + 1):
        front = settled(both.join(front.select("frame"), "frame").select(F.col("next").alias("frame")).distinct().join(reached.select("frame"), "frame", "left_anti").withColumn("hops", F.lit(n)))
        if front.isEmpty():
            return reached
        reached = settled(reached.unionByName(front))
    raise RuntimeError(f"frames are more than {most} steps apart")


def wiring(ports: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Producer and consumer pairs of ports (module, direction, keys), and ports that no other side has."""
    out, into = ports.filter("direction = 'out'"), ports.filter("direction = 'in'")
    pairs = out.select(*keys, F.col("module").alias("producer")).join(into.select(*keys, F.col("module").alias("consumer")), keys)
    loose = out.join(into.select(*keys).distinct(), keys, "left_anti").unionByName(into.join(out.select(*keys).distinct(), keys, "left_anti"))
    return pairs, loose
