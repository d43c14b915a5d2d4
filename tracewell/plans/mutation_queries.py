"""Changes of recordings: events are the rows, event types the streams, customers and nations the frames."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mutations
from .graph_queries import POSES, poses
from .profile_queries import CUT, E, events
from .registry import query, table

COUNTS = "count(*) AS n, min(ts_us) AS first_us, max(ts_us) AS last_us, sum(event_id)::BIGINT AS ids"


def recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("stream", F.col("event_id").alias("id"), F.col("ts_us").alias("ts"))


def counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("stream").agg(F.count("*").alias("n"), F.min("ts").alias("first_us"), F.max("ts").alias("last_us"), F.sum("id").alias("ids"))


@query(f"SELECT CASE stream WHEN 'view' THEN 'seen' ELSE stream END AS stream, {COUNTS} FROM {E} GROUP BY 1")
def stream_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(mutations.rename_stream(recording(spark, sf_dir), {"view": "seen"}))


@query(f"SELECT stream, {COUNTS} FROM {E} WHERE stream NOT IN ('error', 'click') GROUP BY 1")
def stream_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(mutations.without(recording(spark, sf_dir), ["error", "click"]))


@query(f"SELECT stream, {COUNTS} FROM (SELECT stream, event_id, ts_us FROM {E} UNION ALL SELECT 'error_copy', row_number() OVER (ORDER BY ts_us, event_id), ts_us FROM {E} WHERE stream = 'error') GROUP BY 1")
def stream_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(mutations.copied(recording(spark, sf_dir), "error", "error_copy", order=("ts", "id")))


@query(f"SELECT stream, {COUNTS} FROM (SELECT stream, event_id, ts_us FROM {E} WHERE stream <> 'view' AND user_id % 2 = 0 UNION ALL SELECT stream, event_id, ts_us FROM {E} WHERE stream = 'view' AND user_id % 2 = 1) GROUP BY 1")
def stream_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stream of another recording in place of the own."""
    e = events(spark, sf_dir).select("stream", F.col("event_id").alias("id"), F.col("ts_us").alias("ts"), "user_id")
    half = lambda k: e.filter(F.col("user_id") % 2 == k).drop("user_id")
    return counted(mutations.appended(half(0), half(1), ["view"], overwrite=True))


NAMED = "CASE WHEN n_name = 'NATION_3' THEN 'base' WHEN n_name IN ('NATION_1', 'NATION_2') THEN n_name ELSE 'bot/' || n_name END"


@query(f"SELECT c_custkey AS child, {NAMED} AS parent FROM customer JOIN nation ON n_nationkey = c_nationkey")
def frames_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of all edges renamed: an explicit name, else the namespace, but for two that are kept."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), mutations.renamed_frame(F.col("n_name"), {"NATION_3": "base"}, "bot/", ("NATION_1", "NATION_2")).alias("parent"))
    return table(spark, sf_dir, "customer").join(n, "c_nationkey").select(F.col("c_custkey").alias("child"), "parent")


@query(f"SELECT child, count(*) AS n, min(ts_us) AS first_us, max(ts_us) AS last_us FROM (SELECT user_id::VARCHAR AS child, ts_us FROM {E} UNION ALL SELECT 'fixed' || k, unnest(range(lo, hi + 1, 3600000000)) FROM (SELECT min(ts_us) AS lo, max(ts_us) AS hi FROM {E}), (SELECT unnest([1, 2]) AS k)) GROUP BY child")
def edge_add_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two fixed edges, told at the start and again each hour."""
    e = events(spark, sf_dir).select(F.col("user_id").cast("string").alias("child"), "ts_us")
    fixed = spark.createDataFrame([("fixed1",), ("fixed2",)], "child string")
    return mutations.with_static_edges(e, fixed, "ts_us", 3_600_000_000).groupBy("child").agg(F.count("*").alias("n"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))


@query(f"SELECT child, parent, round(sum(cos(0.5) * pose - sin(0.5) * (j - 1)), 3) + 0.0 AS x, round(sum(sin(0.5) * pose + cos(0.5) * (j - 1)), 3) + 0.0 AS y FROM {POSES} GROUP BY 1, 2")
def edge_multiply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pose of an edge behind a fixed turn."""
    from ..functions import pose

    p = poses(spark, sf_dir).select("child", "parent", F.col("pose").cast("double").alias("x"), (F.col("j") - 1).cast("double").alias("y"))
    x, y, _ = pose.compose_planar((F.lit(0.0), F.lit(0.0), F.lit(0.5)), (F.col("x"), F.col("y"), F.lit(0.0)))
    return p.groupBy("child", "parent").agg(*[(F.round(F.sum(c), 3) + 0.0).alias(n) for n, c in (("x", x), ("y", y))])


LINKS = "(SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent, n_nationkey AS x FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_custkey FROM customer)"


@query(f"WITH e AS {LINKS} SELECT child, parent, x FROM e WHERE child NOT IN ('c1', (SELECT parent FROM e WHERE child = 'c1')) UNION ALL SELECT parent, child, -x FROM e WHERE child IN ('c1', (SELECT parent FROM e WHERE child = 'c1'))")
def tree_reroot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree with another root: edges from it up to the old one are turned round."""
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_nationkey").cast("long").alias("x"))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("child"), F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.col("c_custkey").cast("long").alias("x"))
    edges = n.unionByName(c)
    first = edges.filter("child = 'c1'")
    path = first.select("child").union(first.select("parent"))
    return mutations.rerooted(edges, path)


@query(f"WITH h AS (SELECT * FROM {E} WHERE ts_us < {CUT}), t AS (SELECT user_id, ts_us, event_id FROM {E} WHERE ts_us >= {CUT}) SELECT user_id AS stream, count(*) AS n, min(ts_us) AS first_us, max(ts_us) AS last_us, sum(event_id)::BIGINT AS ids FROM (SELECT * FROM t UNION ALL SELECT user_id, {CUT}, arg_max(event_id, (ts_us, event_id)) FROM h WHERE user_id NOT IN (SELECT user_id FROM t) GROUP BY user_id) GROUP BY 1")
def cut_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part after a cut, with the last state of all that it no longer tells."""
    e = events(spark, sf_dir).select(F.col("user_id").alias("stream"), F.col("event_id").alias("id"), F.col("ts_us").alias("ts"))
    return counted(mutations.cut_with_carry(e, CUT)[1])
