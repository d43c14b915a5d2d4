"""Predicates, picks and shapes of recordings: events, embeddings as points, topics from names."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import asof, profile, ranges
from ..operators.settle import settled
from .profile_queries import E, events
from .registry import query, table
from .spatial_queries import P, points


@query("SELECT CASE WHEN event_type IN ('view', 'click') THEN 'taken' WHEN event_type = 'error' THEN 'skipped' ELSE 'left' END AS fate, event_type AS topic, count(*) AS n FROM events GROUP BY 1, 2")
def topic_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics taken, those skipped by name, and the rest, which is told."""
    t = F.col("event_type")
    return table(spark, sf_dir, "events").groupBy(F.when(t.isin("view", "click"), "taken").when(t == "error", "skipped").otherwise("left").alias("fate"), t.alias("topic")).agg(F.count("*").alias("n"))


@query(f"SELECT user_id, stream FROM (SELECT DISTINCT user_id, stream FROM {E}) QUALIFY stream IN ('view', 'error') OR NOT bool_or(stream IN ('view', 'error')) OVER (PARTITION BY user_id)")
def canonical_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical streams of a user where it has any, else all."""
    d = events(spark, sf_dir).select("user_id", "stream").distinct()
    canon = F.col("stream").isin("view", "error")
    has = d.groupBy("user_id").agg(F.max(canon).alias("has"))
    return d.join(has, "user_id").filter(canon | ~F.col("has")).select("user_id", "stream")


@query("SELECT p_partkey, p_name LIKE '%bolt' OR p_type = 'PROMO' AS frames FROM part")
def frame_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of frames: by the last part of their type, or by their name."""
    last = F.element_at(F.split(F.concat(F.lit("a.b."), "p_type"), r"\."), -1)
    return table(spark, sf_dir, "part").select("p_partkey", ((last == "PROMO") | F.col("p_name").rlike("(^| )bolt$")).alias("frames"))


@query(f"SELECT vec_id FROM {P} WHERE x BETWEEN -0.2 AND 0.3 AND y BETWEEN -0.1 AND 0.4 AND isfinite(z)")
def forced_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.col("z")
    return points(spark, sf_dir).filter(F.col("x").between(-0.2, 0.3) & F.col("y").between(-0.1, 0.4) & ~F.isnan(z) & (F.abs(z) < float("inf"))).select("vec_id")


@query(f"SELECT vec_id FROM {P} WHERE sqrt(x * x + y * y) < 0.15")
def within_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).filter(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")) < 0.15).select("vec_id")


@query(f"SELECT label, vec_id FROM (SELECT label, vec_id, z, f FROM {P} JOIN (SELECT label, quantile_cont(z, 0.05) AS f FROM {P} WHERE sqrt(x * x + y * y) < 0.2 GROUP BY label HAVING count(*) > 3) USING (label)) WHERE z >= f + 0.05 AND z <= f + 0.25")
def above_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in a band above the local floor: a low percentile of the heights nearby, where there are enough."""
    p = points(spark, sf_dir)
    floor = p.filter(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")) < 0.2).groupBy("label").agg(F.expr("percentile(z, 0.05)").alias("f"), F.count("*").alias("n")).filter("n > 3")
    return p.join(floor, "label").filter("z >= f + 0.05 AND z <= f + 0.25").select("label", "vec_id")


@query(f"SELECT event_id FROM {E} e LEFT JOIN (SELECT user_id, arg_min(ts_us, event_id) AS first_us FROM {E} WHERE stream = 'purchase' GROUP BY 1) USING (user_id) WHERE stream = 'view' AND (first_us IS NULL OR ts_us >= first_us)")
def trimmed_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans not before their robot's first odometry row (the first logged); all where it has none."""
    e = events(spark, sf_dir)
    first = e.filter("stream = 'purchase'").groupBy("user_id").agg(F.min_by("ts_us", "event_id").alias("first_us"))
    return e.filter("stream = 'view'").join(first, "user_id", "left").filter("first_us IS NULL OR ts_us >= first_us").select("event_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'N' OR l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'N')")
def preferred_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of messages that tell the preferred frame, its rows; of others, all."""
    i = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "N").alias("preferred"))
    has = i.groupBy("l_orderkey").agg(F.max("preferred").alias("has"))
    return i.join(has, "l_orderkey").filter("preferred OR NOT has").select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_type END AS module, CASE p_partkey % 3 WHEN 1 THEN 'lz4' ELSE 'lcm' END AS codec FROM part")
def stream_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type and codec from a stream's settings; defaults where they are not told or the text is no JSON."""
    k = F.col("p_partkey") % 3
    config = F.when(k == 0, '{"payload_module": half').when(k == 1, F.format_string('{"payload_module":"a.b.%s","codec":"lz4"}', "p_type")).otherwise(F.format_string('{"payload_module":"%s"}', "p_type"))
    module = F.element_at(F.split(F.get_json_object(config, "$.payload_module"), r"\."), -1)
    return table(spark, sf_dir, "part").select("p_partkey", module.alias("module"), F.coalesce(F.get_json_object(config, "$.codec"), F.lit("lcm")).alias("codec"))


TOPICS = "(SELECT '/' || replace(p_brand, '#', '/') || CASE WHEN p_partkey % 2 = 0 THEN '/' ELSE '_' END || p_size || CASE WHEN p_partkey % 5 = 0 THEN '/compressed' ELSE '' END AS topic FROM part GROUP BY 1)"
FLAT = "SELECT topic, replace(substr(regexp_replace(topic, '/compressed$', ''), 2), '/', '_') AS flat, replace(substr(regexp_replace(topic, '/compressed$', ''), 2), '/', '__') AS spaced FROM " + TOPICS


@query(f"SELECT topic, CASE WHEN count(*) OVER (PARTITION BY flat) = 1 THEN flat WHEN row_number() OVER (PARTITION BY spaced ORDER BY topic) = 1 THEN spaced ELSE spaced || '_' || row_number() OVER (PARTITION BY spaced ORDER BY topic) END AS stream FROM ({FLAT})")
def stream_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics as stream names: slashes as _, as __ where two would be one, numbered where that is not enough. Decoded images lose /compressed."""
    p = table(spark, sf_dir, "part")
    topic = F.concat(F.lit("/"), F.replace("p_brand", F.lit("#"), F.lit("/")), F.when(F.col("p_partkey") % 2 == 0, "/").otherwise("_"), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 5 == 0, "/compressed").otherwise(""))
    bare = F.regexp_replace(F.regexp_replace("topic", "^/", ""), "/compressed$", "")
    t = p.select(topic.alias("topic")).distinct().select("topic", F.replace(bare, F.lit("/"), F.lit("_")).alias("flat"), F.replace(bare, F.lit("/"), F.lit("__")).alias("spaced"))
    t = t.withColumn("n", F.count("*").over(Window.partitionBy("flat"))).withColumn("i", F.row_number().over(Window.partitionBy("spaced").orderBy("topic")))
    return t.select("topic", F.when(F.col("n") == 1, F.col("flat")).when(F.col("i") == 1, F.col("spaced")).otherwise(F.concat("spaced", F.lit("_"), F.col("i").cast("string"))).alias("stream"))


@query(f"SELECT user_id, CASE WHEN bool_or(stream = 'signup') THEN 'signup' WHEN bool_or(stream = 'purchase') THEN 'purchase' WHEN count(DISTINCT stream) = 1 THEN min(stream) END AS picked FROM {E} GROUP BY user_id")
def stream_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first preferred stream that is there; else the only one; else none."""
    g = events(spark, sf_dir).groupBy("user_id").agg(F.collect_set("stream").alias("s"))
    return g.select("user_id", F.when(F.array_contains("s", "signup"), "signup").when(F.array_contains("s", "purchase"), "purchase").when(F.size("s") == 1, F.col("s")[0]).alias("picked"))


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS missing FROM nation WHERE n_nationkey % 4 = 0 GROUP BY 1")
def schema_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types that a schema names and does not define, by their last part."""
    n = table(spark, sf_dir, "nation")
    line = F.concat(F.lit("pkg/msg/"), "n_name", F.lit(" field\n"))
    made = F.when(F.col("n_nationkey") % 4 != 0, F.concat(F.lit("MSG: pkg/"), "n_name", F.lit("\n"))).otherwise("")
    text = n.groupBy("n_regionkey").agg(F.array_join(F.collect_list(F.concat(line, made)), "").alias("t"))
    last = lambda pattern: F.transform(F.regexp_extract_all("t", F.lit(pattern), F.lit(1)), lambda x: F.element_at(F.split(x, "/"), -1))
    missing = F.array_sort(F.array_except(last(r"(?m)^(\S+/\S+) \w+$"), last(r"(?m)^MSG: (\S+)$")))
    return text.select("n_regionkey", F.array_join(missing, ",").alias("missing")).filter("missing <> ''")


@query(f"SELECT stream, hour, n / 3600.0 AS hz FROM (SELECT stream, ts_us // 3600000000 AS hour, count(*) AS n FROM {E} GROUP BY 1, 2) WHERE n / 3600.0 >= 0.0005")
def rate_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of streams by the hour, those under a floor left out."""
    n = events(spark, sf_dir).groupBy("stream", F.expr("ts_us div 3600000000").alias("hour")).agg((F.count("*") / 3600.0).alias("hz"))
    return n.filter("hz >= 0.0005")


@query("SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000 OR s_nationkey > 20")
def danger_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").filter("s_acctbal > 5000 OR s_nationkey > 20").select("s_suppkey")


@query(f"SELECT user_id, arg_min(event_id, (ts_us, event_id)) FILTER (ts_us >= 1705276800000000) AS later, coalesce(arg_min(event_id, (ts_us, event_id)) FILTER (ts_us >= 1705276800000000), arg_min(event_id, (ts_us, event_id))) AS probe FROM {E} GROUP BY user_id")
def probe_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first message from a time on, else the first of all."""
    at = F.struct("ts_us", "event_id")
    later = F.min_by(F.when(F.col("ts_us") >= 1_705_276_800_000_000, F.col("event_id")), F.when(F.col("ts_us") >= 1_705_276_800_000_000, at))
    return events(spark, sf_dir).groupBy("user_id").agg(later.alias("later"), F.coalesce(later, F.min_by("event_id", at)).alias("probe"))


@query("SELECT name, value FROM (SELECT 'm' || o_custkey AS name, o_orderpriority AS value, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS i FROM orders) WHERE i = 1")
def metadata_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of metadata records of one name the last."""
    return table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("m"), "o_custkey").alias("name")).agg(F.max_by("o_orderpriority", "o_orderkey").alias("value"))


@query("SELECT c_custkey AS channel, coalesce(n_name, '') AS schema, coalesce(s.n, 0)::BIGINT AS messages FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey % 6 <> 0 LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) s ON o_custkey = c_custkey")
def channel_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels with their schema and stated count, where there are any."""
    schema = table(spark, sf_dir, "nation").filter("n_nationkey % 6 <> 0").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("schema"))
    stated = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("messages"))
    out = table(spark, sf_dir, "customer").join(schema, "c_nationkey", "left").join(stated, "c_custkey", "left")
    return out.select(F.col("c_custkey").alias("channel"), F.coalesce("schema", F.lit("")).alias("schema"), F.coalesce("messages", F.lit(0)).alias("messages"))


WEIGHTS = "[(0, 0, 4), (1, 0, 2), (-1, 0, 2), (0, 1, 2), (0, -1, 2), (1, 1, 1), (1, -1, 1), (-1, 1, 1), (-1, -1, 1)]"


@query(f"SELECT ix + w[1] AS px, iy + w[2] AS py, max(w[3])::BIGINT AS weight FROM (SELECT DISTINCT floor(x / 0.05)::BIGINT AS ix, floor(y / 0.05)::BIGINT AS iy FROM {P}), (SELECT unnest([[0, 0, 4], [1, 0, 2], [-1, 0, 2], [0, 1, 2], [0, -1, 2], [1, 1, 1], [1, -1, 1], [-1, 1, 1], [-1, -1, 1]]) AS w) GROUP BY 1, 2")
def splat_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pixel's largest weight of the points that cover it: 4 where one lies, 2 beside, 1 across. Cells are folded before they spread."""
    cells = points(spark, sf_dir).select(F.floor(F.col("x") / 0.05).alias("ix"), F.floor(F.col("y") / 0.05).alias("iy")).distinct()
    spread = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(4 >> abs(a) + abs(b)).cast("long").alias("w")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    return cells.withColumn("s", F.explode(spread)).groupBy((F.col("ix") + F.col("s.a")).alias("px"), (F.col("iy") + F.col("s.b")).alias("py")).agg(F.max("s.w").alias("weight"))


@query(f"SELECT floor(min(x) / 0.08)::BIGINT - 2 AS x0, floor(max(x) / 0.08)::BIGINT + 2 AS x1, floor(min(y) / 0.08)::BIGINT - 2 AS y0, floor(max(y) / 0.08)::BIGINT + 2 AS y1 FROM {P}")
def extent_snapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extent in whole voxels, two more on each side."""
    cell = lambda f, c: F.floor(f(c) / 0.08)
    return points(spark, sf_dir).agg(*[(cell(f, c) + d).alias(n) for n, f, c, d in (("x0", F.min, "x", -2), ("x1", F.max, "x", 2), ("y0", F.min, "y", -2), ("y1", F.max, "y", 2))])


HITS = f"(SELECT floor(x / 0.1)::BIGINT AS ix, floor(y / 0.1)::BIGINT AS iy, count(*) AS hits FROM {P} GROUP BY 1, 2)"


@query(f"SELECT hits AS ceiling FROM (SELECT hits, row_number() OVER (ORDER BY hits) - 1 AS i, count(*) OVER () AS n FROM {HITS}) WHERE i = (98 * n) // 100")
def hit_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The count at index floor(0.98 n) of sorted cell counts. Ranks come from counts of equal counts, which are few."""
    hits = points(spark, sf_dir).groupBy(F.floor(F.col("x") / 0.1).alias("ix"), F.floor(F.col("y") / 0.1).alias("iy")).agg(F.count("*").alias("hits"))
    cells = hits.groupBy("hits").agg(F.count("*").alias("n"))
    run = cells.withColumn("upto", F.sum("n").over(Window.orderBy("hits"))).withColumn("all", F.sum("n").over(Window.partitionBy(F.lit(0))))
    return run.filter("upto > 98 * all div 100").agg(F.min("hits").alias("ceiling"))


@query(f"SELECT gap FROM (SELECT gap, count(*) AS n, min(seen) AS seen FROM (SELECT v - lag(v) OVER (ORDER BY v) AS gap, v AS seen FROM (SELECT DISTINCT round(x * 1000)::BIGINT AS v FROM {P} WHERE vec_id < 20000)) WHERE gap > 5 GROUP BY gap) ORDER BY n DESC, seen LIMIT 1")
def voxel_pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most common gap over 5 mm between the sorted distinct coordinates of the first points; of ties the first seen."""
    v = points(spark, sf_dir).filter("vec_id < 20000").select(F.round(F.col("x") * 1000).cast("long").alias("v")).distinct()
    gaps = v.select("v", (F.col("v") - F.lag("v").over(Window.orderBy("v"))).alias("gap")).filter("gap > 5")
    return gaps.groupBy("gap").agg(F.count("*").alias("n"), F.min("v").alias("at")).orderBy(F.desc("n"), "at").limit(1).select("gap")


@query(f"SELECT label, round(avg(x), 5) + 0.0 AS cx, round(avg(y), 5) + 0.0 AS cy, count(*) AS n, sum(abs(round((x - cx) * 100)))::BIGINT AS spread_cm FROM {P} JOIN (SELECT label, avg(x) AS cx FROM {P} GROUP BY 1) USING (label) GROUP BY label")
def quantised_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per scan its centre, and points as whole centimetres from it."""
    p = points(spark, sf_dir)
    c = p.groupBy("label").agg(F.avg("x").alias("cx"))
    off = F.abs(F.round((F.col("x") - F.col("cx")) * 100))
    return p.join(c, "label").groupBy("label").agg((F.round(F.avg("x"), 5) + 0.0).alias("cx"), (F.round(F.avg("y"), 5) + 0.0).alias("cy"), F.count("*").alias("n"), F.sum(off).cast("long").alias("spread_cm"))


@query(f"SELECT label, round(min(z), 5) + 0.0 AS low, round(max(z), 5) + 0.0 AS high, round(avg((z - lo) / nullif(hi - lo, 0)), 4) AS mean_shade FROM {P} JOIN (SELECT label, min(z) AS lo, max(z) AS hi FROM {P} GROUP BY 1) USING (label) GROUP BY label")
def colour_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per scan the range of heights, and each point's place in it, as a mean."""
    p = points(spark, sf_dir)
    r = p.groupBy("label").agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    shade = F.when(F.col("hi") > F.col("lo"), (F.col("z") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return p.join(r, "label").groupBy("label").agg((F.round(F.min("z"), 5) + 0.0).alias("low"), (F.round(F.max("z"), 5) + 0.0).alias("high"), F.round(F.avg(shade), 4).alias("mean_shade"))


@query(f"SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts_us, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM {E}) WHERE n <= 4 OR i IN (0, (n - 1) // 3, (2 * (n - 1)) // 3, n - 1)")
def evenly_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four rows of each user, evenly spaced in time order, both ends included."""
    w = Window.partitionBy("user_id")
    e = events(spark, sf_dir).withColumn("i", F.row_number().over(w.orderBy("ts_us", "event_id")) - 1).withColumn("n", F.count("*").over(w))
    return e.filter("n <= 4 OR i IN (0, (n - 1) div 3, 2 * (n - 1) div 3, n - 1)").select("user_id", "event_id")


@query(f"SELECT user_id, event_id FROM {E} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY md5(event_id || '-7')) <= 3")
def seeded_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rows of each user, drawn without replacement by a seeded hash."""
    order = F.md5(F.concat(F.col("event_id").cast("string"), F.lit("-7")))
    e = events(spark, sf_dir).withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy(order)))
    return e.filter("i <= 3").select("user_id", "event_id")


@query(f"SELECT user_id, sec, arg_min(event_id, event_id) AS event_id FROM (SELECT *, ts_us // 60000000 AS sec FROM {E}) GROUP BY 1, 2")
def dedupe_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of rows of one stamp the first."""
    return events(spark, sf_dir).groupBy("user_id", F.expr("ts_us div 60000000").alias("sec")).agg(F.min("event_id").alias("event_id"))


@query(f"SELECT stream, hour, count(*) AS n, arg_min(event_id, (ts_us, event_id)) AS first_id FROM (SELECT *, ts_us // 3600000000 AS hour FROM {E}) GROUP BY 1, 2")
def poll_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per poll and kind: how many, and the first."""
    return events(spark, sf_dir).groupBy("stream", F.expr("ts_us div 3600000000").alias("hour")).agg(F.count("*").alias("n"), F.min_by("event_id", F.struct("ts_us", "event_id")).alias("first_id"))


@query(
    f"""SELECT user_id, stream, min(ts_us) AS first_us, min(ts_us) FILTER (k >= 50) AS applied_us, arg_max(k, (ts_us, event_id)) AS last_state, max(value) AS most, string_agg(k, ',' ORDER BY ts_us, event_id) AS states
    FROM (SELECT event_id, event_type AS stream, user_id, value, epoch_us(ts) AS ts_us, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1, 2 HAVING min(ts_us) FILTER (k >= 50) IS NOT NULL OR arg_max(k, (ts_us, event_id)) IN (2, 3, 4, 5)"""
)
def closure_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per pair: when first seen and first applied, its last state, the largest weight and all states; pairs that came to something."""
    e = events(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")), "event_id")
    states = F.array_sort(F.collect_list(F.struct("ts_us", "event_id", "k")))
    g = e.groupBy("user_id", "stream").agg(F.min("ts_us").alias("first_us"), F.min(F.when(F.col("k") >= 50, F.col("ts_us"))).alias("applied_us"), F.max("value").alias("most"), states.alias("s"))
    g = g.withColumn("last_state", F.element_at("s", -1)["k"]).filter("applied_us IS NOT NULL OR last_state IN (2, 3, 4, 5)")
    return g.select("user_id", "stream", "first_us", "applied_us", "last_state", "most", F.array_join(F.transform("s", lambda x: x["k"].cast("string")), ",").alias("states"))


@query(f"SELECT user_id, arg_max(value, (ts_us, event_id)) AS open_at_end, min(value) AS low, max(value) AS high FROM {E} GROUP BY user_id")
def last_and_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A counter's last reading and the range of a level."""
    return events(spark, sf_dir).groupBy("user_id").agg(F.max_by("value", F.struct("ts_us", "event_id")).alias("open_at_end"), F.min("value").alias("low"), F.max("value").alias("high"))


@query(f"SELECT user_id, sum(n) OVER (PARTITION BY user_id ORDER BY stream) - n AS start, stream, n FROM (SELECT user_id, stream, count(*) AS n FROM {E} GROUP BY 1, 2)")
def prefix_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each stream's rows begin if a user's streams are laid end to end."""
    n = events(spark, sf_dir).groupBy("user_id", "stream").agg(F.count("*").alias("n"))
    return n.withColumn("start", F.sum("n").over(Window.partitionBy("user_id").orderBy("stream")) - F.col("n"))


@query(f"SELECT stream, round(round(1e10 / gap, 1) / 7, 8) AS fps FROM (SELECT stream, gap_us AS gap FROM (SELECT stream, gap_us, row_number() OVER (PARTITION BY stream ORDER BY gap_us) - 1 AS i, count(*) OVER (PARTITION BY stream) AS n FROM (SELECT user_id % 3 || stream AS stream, ts_us - lag(ts_us) OVER (PARTITION BY user_id % 3, stream ORDER BY ts_us, event_id) AS gap_us FROM {E}) WHERE gap_us IS NOT NULL) WHERE i = n // 2)")
def median_fps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames in 10,000 seconds from the upper median gap, to one digit, over a stride of seven."""
    e = events(spark, sf_dir).withColumn("stream", F.concat((F.col("user_id") % 3).cast("string"), "stream"))
    gaps = settled(profile.with_gap(e.select("event_id", "stream", "ts_us"), "stream", "ts_us", "event_id").select("stream", "gap_us"))
    return ranges.at_ranks(gaps, ["stream"], "gap_us", {"gap": F.expr("n div 2")}).select("stream", F.round(F.round(1e10 / F.col("gap"), 1) / 7, 8).alias("fps"))


@query("SELECT source, sum(octet_length(encode(text)))::BIGINT AS bytes, max(octet_length(encode(text)))::BIGINT AS most, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM documents GROUP BY source")
def byte_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.octet_length("text")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(size).cast("long").alias("bytes"), F.max(size).cast("long").alias("most"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))


@query(f"SELECT event_id, round(CASE WHEN p >= 1 THEN 1e9 ELSE -ln(1 - p) END, 6) + 0.0 AS evidence FROM (SELECT event_id, least(value / 400, 1) AS p FROM {E})")
def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weight of a probability; a certain one has a bound."""
    p = F.least(F.col("value") / 400, F.lit(1.0))
    return events(spark, sf_dir).select("event_id", (F.round(F.when(p >= 1, F.lit(1e9)).otherwise(-F.log(1 - p)), 6) + 0.0).alias("evidence"))


@query(f"SELECT count(*) AS n, count(*) FILTER (stream = 'view') AS views, count(DISTINCT user_id) FILTER (value > 0) AS users, count(DISTINCT stream) AS streams FROM {E}")
def totals_non_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(F.col("stream") == "view").alias("views"), F.countDistinct(F.when(F.col("value") > 0, F.col("user_id"))).alias("users"), F.countDistinct("stream").alias("streams"))


@query(f"WITH a AS (SELECT p.event_id, s.value AS state FROM {E} p ASOF LEFT JOIN (SELECT * FROM {E} WHERE stream = 'purchase') s ON p.user_id = s.user_id AND p.ts_us >= s.ts_us WHERE p.stream = 'click') SELECT coalesce(state::BIGINT // 100, -1) AS band, count(*) AS n FROM a GROUP BY 1")
def root_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many scans reach each root at their time, the most first; -1 is none."""
    e = events(spark, sf_dir)
    at = asof.last_before(e.filter("stream = 'click'").select("user_id", "ts_us", "event_id"), e.filter("stream = 'purchase'"), "user_id", "ts_us", ["value"], "state")
    band: Column = F.coalesce(F.floor(F.round(F.col("state.value")) / 100), F.lit(-1))
    return at.groupBy(band.alias("band")).agg(F.count("*").alias("n"))
