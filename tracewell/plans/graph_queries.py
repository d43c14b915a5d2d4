"""Frame trees and dataflow graphs: region, nation, customer and order make a tree; an order's return flags are parents."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph
from .registry import query, table

TREE = """(SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders)"""
POSES = "(SELECT l_partkey AS child, l_suppkey AS parent, round(l_discount * 100)::BIGINT AS pose, l_shipdate AS t, l_orderkey AS k, l_linenumber AS j FROM lineitem)"


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    n = table(spark, sf_dir, "nation").select(name("n", "n_nationkey").alias("child"), name("r", "n_regionkey").alias("parent"))
    c = table(spark, sf_dir, "customer").select(name("c", "c_custkey").alias("child"), name("n", "c_nationkey").alias("parent"))
    o = table(spark, sf_dir, "orders").select(name("o", "o_orderkey").alias("child"), name("c", "o_custkey").alias("parent"))
    return n.unionByName(c).unionByName(o)


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("child"), F.col("l_suppkey").alias("parent"), F.round(F.col("l_discount") * 100).cast("long").alias("pose"), F.col("l_shipdate").alias("t"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("j")
    )


@query(f"SELECT child, parent, count(*) AS n, arg_max(pose, (t, k, j)) AS last_pose FROM {POSES} GROUP BY child, parent")
def edge_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poses(spark, sf_dir).groupBy("child", "parent").agg(F.count("*").alias("n"), F.max_by("pose", F.struct("t", "k", "j")).alias("last_pose"))


@query("SELECT l_orderkey AS child, count(DISTINCT l_returnflag) AS n_parents FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1")
def edge_two_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.two_parents(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("child"), F.col("l_returnflag").alias("parent")))


@query(f"SELECT child, parent, count(DISTINCT pose) AS n_values FROM {POSES} GROUP BY 1, 2 HAVING count(DISTINCT pose) BETWEEN 2 AND 8")
def edge_conflicting_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poses(spark, sf_dir).groupBy("child", "parent").agg(F.countDistinct("pose").alias("n_values")).filter("n_values BETWEEN 2 AND 8")


@query(f"SELECT child, parent FROM {POSES} GROUP BY 1, 2 HAVING count(*) = 1")
def edge_published_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poses(spark, sf_dir).groupBy("child", "parent").count().filter("count = 1").select("child", "parent")


ENDS = "(SELECT user_id, event_type, count(*) AS n, min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS b FROM events GROUP BY 1, 2 HAVING count(*) > 1)"
SPAN = "(SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events)"


def ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .profile_queries import events

    e = events(spark, sf_dir)
    per = e.groupBy("user_id", F.col("stream").alias("event_type")).agg(F.count("*").alias("n"), F.min("ts_us").alias("a"), F.max("ts_us").alias("b")).filter("n > 1")
    # one row, so the broadcast is of a fixed size
    return per.join(F.broadcast(e.agg(F.min("ts_us").alias("lo"), F.max("ts_us").alias("hi"))), how="cross").withColumn("slack", F.greatest(3.0 * (F.col("b") - F.col("a")) / (F.col("n") - 1), F.lit(1e6)))


@query(f"SELECT user_id, event_type, b AS last_us FROM {ENDS}, {SPAN} WHERE hi - b > greatest(3.0::DOUBLE * (b - a) / (n - 1), 1e6)")
def edge_stops_early(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ends(spark, sf_dir).filter("hi - b > slack").select("user_id", "event_type", F.col("b").alias("last_us"))


@query(f"SELECT user_id, event_type, a AS first_us FROM {ENDS}, {SPAN} WHERE a - lo > greatest(3.0::DOUBLE * (b - a) / (n - 1), 1e6)")
def edge_starts_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ends(spark, sf_dir).filter("a - lo > slack").select("user_id", "event_type", F.col("a").alias("first_us"))


@query(f"SELECT DISTINCT parent AS frame FROM {TREE} WHERE parent NOT IN (SELECT child FROM {TREE})")
def tree_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.roots(tree(spark, sf_dir))


@query(f"WITH RECURSIVE e AS {TREE}, r AS (SELECT child AS frame, 1 AS depth, parent AS root FROM e UNION ALL SELECT frame, depth + 1, e.parent FROM r JOIN e ON r.root = e.child) SELECT frame, root, depth FROM r WHERE root NOT IN (SELECT child FROM e)")
def tree_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.root_of(tree(spark, sf_dir))


@query(
    """WITH RECURSIVE e AS (SELECT n_nationkey AS child, (n_nationkey * 2 + 1) % 25 AS parent FROM nation), r AS (SELECT child AS frame, 1 AS depth, parent AS up FROM e
    UNION ALL SELECT frame, depth + 1, e.parent FROM r JOIN e ON r.up = e.child WHERE depth < 26) SELECT frame, min(depth) AS length FROM r WHERE frame = up GROUP BY frame"""
)
def tree_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("child"), ((F.col("n_nationkey") * 2 + 1) % 25).alias("parent"))
    return graph.in_cycles(edges)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def tree_unplaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left_anti").select("o_orderkey")


MARKED = "(SELECT 'n' || n_nationkey AS f FROM nation WHERE n_nationkey % 5 = 0 UNION ALL SELECT 'c' || c_custkey FROM customer WHERE c_acctbal < 0)"


@query(f"WITH e AS {TREE}, m AS {MARKED} SELECT f AS frame FROM m WHERE f NOT IN (SELECT child FROM e JOIN m ON e.parent = m.f)")
def tree_outermost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked frames none of whose ancestors is marked."""
    n = table(spark, sf_dir, "nation").filter("n_nationkey % 5 = 0").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("frame"))
    c = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("frame"))
    marked = n.unionByName(c)
    up = graph.climbed(tree(spark, sf_dir), marked).filter("seen").select("frame")
    return marked.join(up, "frame", "left_anti")


PORTS = "(SELECT 's' || s_suppkey AS module, 'out' AS direction, s_nationkey % 7 AS type, s_nationkey AS topic FROM supplier UNION ALL SELECT 'c' || c_custkey, 'in', c_nationkey % 7, c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING')"


def ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    port = lambda df, p, k, d, n: df.select(F.concat(F.lit(p), F.col(k).cast("string")).alias("module"), F.lit(d).alias("direction"), (F.col(n) % 7).alias("type"), F.col(n).alias("topic"))
    out = port(table(spark, sf_dir, "supplier"), "s", "s_suppkey", "out", "s_nationkey")
    return out.unionByName(port(table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'"), "c", "c_custkey", "in", "c_nationkey"))


@query(f"SELECT o.topic, count(*) AS pairs FROM {PORTS} o JOIN {PORTS} i USING (topic, type) WHERE o.direction = 'out' AND i.direction = 'in' GROUP BY o.topic")
def producer_consumer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs per topic, from counts of either side, so that no pair is made."""
    sides = ports(spark, sf_dir).groupBy("topic", "type").agg(F.count(F.when(F.col("direction") == "out", 1)).alias("o"), F.count(F.when(F.col("direction") == "in", 1)).alias("i"))
    return sides.filter("o > 0 AND i > 0").select("topic", (F.col("o") * F.col("i")).alias("pairs"))


@query(f"SELECT module, direction, topic FROM {PORTS} a WHERE NOT EXISTS (SELECT 1 FROM {PORTS} b WHERE b.topic = a.topic AND b.direction <> a.direction)")
def dangling_ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.wiring(ports(spark, sf_dir), ["topic", "type"])[1].select("module", "direction", "topic")


@query(f"SELECT topic, min(module) FILTER (direction = 'out') AS first_writer, count(*) FILTER (direction = 'out') AS writers FROM {PORTS} GROUP BY topic HAVING count(*) FILTER (direction = 'out') > 1")
def topic_fighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ports(spark, sf_dir).filter("direction = 'out'").groupBy("topic").agg(F.min("module").alias("first_writer"), F.count("*").alias("writers")).filter("writers > 1")


@query(
    """SELECT coalesce(o.o_orderkey, l.k) AS k, coalesce(o.n, 0) AS stated, coalesce(l.n, 0) AS counted FROM (SELECT o_orderkey, (o_orderkey % 7) + 1 AS n FROM orders) o
    FULL JOIN (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1) l ON o.o_orderkey = l.k WHERE coalesce(o.n, 0) <> coalesce(l.n, 0)"""
)
def verify_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    stated = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), ((F.col("o_orderkey") % 7) + 1).alias("stated"))
    counted = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("counted"))
    return stated.join(counted, "k", "full").na.fill(0, ["stated", "counted"]).filter("stated <> counted")


@query("SELECT l_orderkey, '[' || string_agg(l_linenumber::VARCHAR, ', ' ORDER BY l_linenumber) FILTER (l_returnflag <> 'R') || ']' AS kept FROM lineitem GROUP BY 1")
def edge_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a message without those dropped; the message stays even if none is left."""
    message = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_returnflag")).alias("edges"))
    kept = F.transform(F.array_sort(F.filter("edges", lambda e: e["l_returnflag"] != "R")), lambda e: e["l_linenumber"].cast("string"))
    return message.select("l_orderkey", F.when(F.size(kept) > 0, F.concat(F.lit("["), F.array_join(kept, ", "), F.lit("]"))).alias("kept"))


RENAME = "CASE n_name WHEN 'NATION_1' THEN 'base' WHEN 'FRANCE' THEN 'base' ELSE 'robot/' || n_name END"


@query(f"SELECT n_name AS before, {RENAME} AS after, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def frame_rename_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An explicit name first, else the namespace."""
    named = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("before"), F.when(F.col("n_name").isin("NATION_1", "FRANCE"), "base").otherwise(F.concat(F.lit("robot/"), F.col("n_name"))).alias("after"))
    n = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return named.join(n, "n_nationkey").groupBy("before", "after").agg(F.sum("n").alias("n"))


@query(f"WITH RECURSIVE e AS {TREE}, b AS (SELECT child AS a, parent AS b FROM e WHERE child NOT LIKE 'o%' UNION SELECT parent, child FROM e WHERE child NOT LIKE 'o%'), r AS (SELECT 'r0' AS frame, 0 AS hops UNION SELECT b.b, hops + 1 FROM r JOIN b ON r.frame = b.a WHERE hops < 6) SELECT frame, min(hops) AS hops FROM r GROUP BY frame")
def static_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps from one frame to every other over edges and their inverses."""
    edges = tree(spark, sf_dir).filter("child NOT LIKE 'o%'")
    return graph.hops(edges, spark.createDataFrame([("r0",)], "frame string"))


@query(f"WITH RECURSIVE e AS {TREE}, r AS (SELECT child AS frame, parent AS up FROM e UNION ALL SELECT frame, e.parent FROM r JOIN e ON r.up = e.child) SELECT up AS root, count(*) + 1 AS processes FROM r WHERE up NOT IN (SELECT child FROM e) GROUP BY up")
def tree_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per root: its descendants and itself."""
    return graph.root_of(tree(spark, sf_dir)).groupBy("root").agg((F.count("*") + 1).alias("processes"))


@query(f"SELECT count(*) AS roots, count(*) > 1 AS forest FROM (SELECT DISTINCT parent FROM {TREE} WHERE parent NOT IN (SELECT child FROM {TREE}))")
def tree_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.roots(tree(spark, sf_dir)).agg(F.count("*").alias("roots")).withColumn("forest", F.col("roots") > 1)


@query(f"SELECT child, parent, n, row_number() OVER (PARTITION BY child ORDER BY n DESC, parent) AS place FROM (SELECT child, parent, count(*) AS n FROM {POSES} GROUP BY 1, 2)")
def parent_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each parent was published for a child, the most frequent first."""
    votes = poses(spark, sf_dir).groupBy("child", "parent").agg(F.count("*").alias("n"))
    return votes.withColumn("place", F.row_number().over(Window.partitionBy("child").orderBy(F.desc("n"), "parent")))


STREAMED = "(SELECT l_partkey % 500 AS child, l_suppkey % 7 AS parent, l_linestatus AS stream, round(l_discount * 100)::BIGINT AS pose, l_shipdate AS t, l_orderkey AS k, l_linenumber AS j FROM lineitem)"


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_partkey") % 500).alias("child"), (F.col("l_suppkey") % 7).alias("parent"), F.col("l_linestatus").alias("stream"), F.round(F.col("l_discount") * 100).cast("long").alias("pose"), F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("at")
    )


def last_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = streamed(spark, sf_dir).groupBy("child", "parent", "stream")
    return g.agg(F.count("*").alias("n"), F.min("at.l_shipdate").alias("first"), F.max("at.l_shipdate").alias("last"), F.max_by("pose", "at").alias("pose"))


@query(
    f"""SELECT child, parent, string_agg(stream, ',' ORDER BY stream) AS streams, sum(n)::BIGINT AS n, min(first) AS first_day, max(last) AS last_day, string_agg(stream || '=' || pose, ',' ORDER BY stream) AS last_poses
    FROM (SELECT child, parent, stream, count(*) AS n, min(t) AS first, max(t) AS last, arg_max(pose, (t, k, j)) AS pose FROM {STREAMED} GROUP BY 1, 2, 3) GROUP BY 1, 2"""
)
def edge_profile_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per edge: streams, messages, first and last time and each stream's last pose."""
    streams = F.array_sort(F.collect_list(F.struct("stream", "pose")))
    out = last_poses(spark, sf_dir).groupBy("child", "parent").agg(streams.alias("s"), F.sum("n").alias("n"), F.min("first").alias("first_day"), F.max("last").alias("last_day"))
    joined = F.array_join(F.transform("s", lambda x: F.concat(x["stream"], F.lit("="), x["pose"].cast("string"))), ",")
    return out.select("child", "parent", F.array_join("s.stream", ",").alias("streams"), "n", "first_day", "last_day", joined.alias("last_poses"))


@query(f"SELECT child, parent FROM (SELECT child, parent, stream, arg_max(pose, (t, k, j)) AS pose FROM {STREAMED} GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING count(*) FILTER (stream = 'F') > 0 AND count(*) FILTER (stream = 'O') > 0 AND count(DISTINCT pose) > 1")
def edge_two_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges on a static and a dynamic stream whose last poses differ."""
    g = last_poses(spark, sf_dir).groupBy("child", "parent").agg(F.count_if(F.col("stream") == "F").alias("static"), F.count_if(F.col("stream") == "O").alias("moving"), F.countDistinct("pose").alias("answers"))
    return g.filter("static > 0 AND moving > 0 AND answers > 1").select("child", "parent")


@query(f"SELECT child, parent, max(abs(pose - first)) AS most FROM (SELECT *, first_value(pose) OVER (PARTITION BY child, parent ORDER BY t, k, j) AS first FROM {POSES}) GROUP BY 1, 2 HAVING max(abs(pose - first)) <= 1")
def edge_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges whose poses all lie within a step of the first."""
    g = poses(spark, sf_dir).groupBy("child", "parent").agg(F.min_by("pose", F.struct("t", "k", "j")).alias("first"), F.min("pose").alias("lo"), F.max("pose").alias("hi"))
    return g.withColumn("most", F.greatest(F.col("hi") - F.col("first"), F.col("first") - F.col("lo"))).filter("most <= 1").select("child", "parent", "most")


@query(f"WITH d AS (SELECT topic, type, min(direction) AS direction, count(*) AS n FROM {PORTS} GROUP BY 1, 2 HAVING count(DISTINCT direction) = 1) SELECT o.type, sum(o.n * i.n)::BIGINT AS pairs FROM d o JOIN d i USING (type) WHERE o.direction = 'out' AND i.direction = 'in' GROUP BY o.type")
def dangling_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per type: pairs of an output and an input that have no partner, from counts of either side."""
    g = ports(spark, sf_dir).groupBy("topic", "type").agg(F.count_if(F.col("direction") == "out").alias("o"), F.count_if(F.col("direction") == "in").alias("i")).filter("o = 0 OR i = 0")
    return g.groupBy("type").agg((F.sum("o") * F.sum("i")).alias("pairs")).filter("pairs > 0")


@query(f"SELECT topic, direction, string_agg(module, ',' ORDER BY module) AS modules FROM {PORTS} GROUP BY 1, 2")
def wiring_per_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ports(spark, sf_dir).groupBy("topic", "direction").agg(F.array_join(F.array_sort(F.collect_list("module")), ",").alias("modules"))


@query(f"SELECT DISTINCT topic, type FROM {PORTS}")
def port_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of either side."""
    p = ports(spark, sf_dir)
    side = lambda d: p.filter(F.col("direction") == d).select("topic", "type")
    return side("out").union(side("in")).distinct()
