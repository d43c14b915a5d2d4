"""Runs of a link benchmark and their verdicts: an order is a run, its lines are the echoes."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import verdicts
from .profile_queries import E, events
from .registry import query, table

# a run's stage, offered rate (0 idle, null at most), echoes, those lost, received bytes, seconds and latencies of echoes
RUNS = """(SELECT r.*, lat[1 + least(n - 1, n // 2)] AS p50, lat[1 + least(n - 1, (19 * n) // 20)] AS p95, round(bytes * 8 / 1e6 / seconds, 1) AS mbps FROM (
    SELECT o_orderkey AS run, ['tcp', 'ws', 'webrtc'][1 + o_orderkey % 3] AS stage, CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE (1 + o_orderkey % 50) * 1000000 END AS offered, o_custkey AS link,
    count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS lost, sum(round(l_extendedprice)::BIGINT) * 100 AS bytes, (1 + o_orderkey % 5) AS seconds, list((l_quantity * 6)::BIGINT ORDER BY (l_quantity * 6)::BIGINT) AS lat
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3, 4, 8) r)"""


def ranked(n: Column, num: int, den: int) -> Column:
    """The value of the sorted array lat at share num / den: index floor(share * n), the last at most."""
    return F.get("lat", F.least(n - 1, F.expr(f"{num} * n div {den}")).cast("int"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, i = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    g = i.groupBy(F.col("l_orderkey").alias("run")).agg(
        F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("lost"), (F.sum(F.round("l_extendedprice").cast("long")) * 100).alias("bytes"), F.sort_array(F.collect_list((F.col("l_quantity") * 6).cast("long"))).alias("lat")
    )
    k = F.col("o_orderkey")
    stage = F.element_at(F.array(F.lit("tcp"), F.lit("ws"), F.lit("webrtc")), (k % 3 + 1).cast("int"))
    offered = F.when(k % 4 == 0, 0).when(k % 4 == 1, None).otherwise((k % 50 + 1) * 1_000_000)
    r = o.select(k.alias("run"), stage.alias("stage"), offered.alias("offered"), F.col("o_custkey").alias("link"), (k % 5 + 1).alias("seconds")).join(g, "run")
    return r.withColumn("p50", ranked(F.col("n"), 1, 2)).withColumn("p95", ranked(F.col("n"), 19, 20)).withColumn("mbps", F.round(F.col("bytes") * 8 / 1e6 / F.col("seconds"), 1))


@query(f"SELECT run, n, p50, p95, lat[n] AS most, round(100.0 * lost / n, 1)::DOUBLE AS loss, mbps FROM {RUNS}")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).select("run", "n", "p50", "p95", F.element_at("lat", -1).alias("most"), F.round(F.col("lost") * 100.0 / F.col("n"), 1).alias("loss"), "mbps")


@query(f"SELECT stage, arg_max(run, (mbps, -run)) AS best_run, max(mbps) AS best, min(run) FILTER (offered = 0) AS idle_run, round(avg(p50), 4) AS mean_p50 FROM {RUNS} GROUP BY stage")
def best_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per stage: the fastest run, the first of ties, the idle one and the mean of medians."""
    g = runs(spark, sf_dir).groupBy("stage")
    return g.agg(F.max_by("run", F.struct("mbps", -F.col("run"))).alias("best_run"), F.max("mbps").alias("best"), F.min(F.when(F.col("offered") == 0, F.col("run"))).alias("idle_run"), F.round(F.avg("p50"), 4).alias("mean_p50"))


@query(f"SELECT link, arg_max(run, (offered, run)) AS run, max(offered)::BIGINT AS offered FROM {RUNS} WHERE offered > 0 AND p95 < 100 AND mbps >= 0.9 * offered / 1e6 GROUP BY link")
def comfortable_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per link: the highest paced rate at which the delay stays low and nearly all that is offered arrives."""
    calm = runs(spark, sf_dir).filter(verdicts.comfortable(F.col("p95"), F.col("mbps"), F.col("offered")))
    return calm.groupBy("link").agg(F.max_by("run", F.struct("offered", "run")).alias("run"), F.max("offered").cast("long").alias("offered"))


GRADE = "CASE greatest(CASE WHEN share >= 70 THEN 0 WHEN share >= 30 THEN 1 ELSE 2 END, CASE WHEN p95 < 100 THEN 0 WHEN p95 <= 250 THEN 1 ELSE 2 END) WHEN 0 THEN 'good' WHEN 1 THEN 'borderline' ELSE 'bad' END"


@query(
    f"""WITH m AS (SELECT link, stage, max(mbps) AS mbps, arg_max(p95, (mbps, -run)) AS p95 FROM {RUNS} GROUP BY 1, 2)
    SELECT link, stage, round(share, 3) AS share, {GRADE} AS verdict FROM (SELECT m.*, least(100, 100 * m.mbps / t.mbps) AS share FROM m JOIN m t ON t.link = m.link AND t.stage = 'tcp' WHERE m.stage <> 'tcp' AND t.mbps > 0)"""
)
def transport_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each transport's share of what the plain connection carries; the verdict is the worse of that and its delay's."""
    m = runs(spark, sf_dir).groupBy("link", "stage").agg(F.max_by("p95", F.struct("mbps", -F.col("run"))).alias("p95"), F.max("mbps").alias("mbps"))
    tcp = m.filter("stage = 'tcp' AND mbps > 0").select("link", F.col("mbps").alias("most"))
    out = m.filter("stage <> 'tcp'").join(tcp, "link").withColumn("share", F.least(F.lit(100.0), F.col("mbps") * 100 / F.col("most")))
    grade = verdicts.worse(verdicts.above(F.col("share"), verdicts.SHARE), verdicts.below(F.col("p95"), verdicts.LATENCY))
    return out.select("link", "stage", F.round("share", 3).alias("share"), verdicts.named(grade).alias("verdict"))


@query(
    f"""WITH q AS (SELECT *, run % 64 AS queue FROM {RUNS}), b AS (SELECT link, max(mbps) AS best FROM q GROUP BY 1)
    SELECT link, min(queue) FILTER (mbps >= 0.9 * best) AS enough, count(*) FILTER (100 * lost > 30 * n) AS starved FROM q JOIN b USING (link) GROUP BY link"""
)
def queue_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per link: the smallest queue with nine tenths of the best speed, and runs that lost over three tenths."""
    q = runs(spark, sf_dir).withColumn("queue", F.col("run") % 64)
    best = q.groupBy("link").agg(F.max("mbps").alias("best"))
    return q.join(best, "link").groupBy("link").agg(F.min(F.when(F.col("mbps") >= 0.9 * F.col("best"), F.col("queue"))).alias("enough"), F.count_if(100 * F.col("lost") > 30 * F.col("n")).alias("starved"))


@query(f"SELECT run, CASE WHEN p95 < 100 THEN 'good' WHEN p95 <= 250 THEN 'borderline' ELSE 'bad' END AS latency, CASE WHEN mbps >= 20 THEN 'good' WHEN mbps >= 5 THEN 'borderline' ELSE 'bad' END AS throughput FROM {RUNS}")
def run_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir)
    return r.select("run", verdicts.named(verdicts.below(F.col("p95"), verdicts.LATENCY)).alias("latency"), verdicts.named(verdicts.above(F.col("mbps"), verdicts.THROUGHPUT)).alias("throughput"))


@query(f"SELECT link, max(mbps) FILTER (stage = 'tcp') AS tcp_mbps, min(p50) FILTER (offered = 0) AS idle_p50 FROM {RUNS} GROUP BY link")
def history_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = runs(spark, sf_dir).groupBy("link")
    return g.agg(F.max(F.when(F.col("stage") == "tcp", F.col("mbps"))).alias("tcp_mbps"), F.min(F.when(F.col("offered") == 0, F.col("p50"))).alias("idle_p50"))


@query(f"SELECT event_id, round((sent - lag(sent) OVER w) * 8 / 1e6 / ((ts_us - lag(ts_us) OVER w) / 1e6), 2) AS mbps FROM (SELECT *, sum((value * 1e6)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS sent FROM {E}) WINDOW w AS (PARTITION BY user_id ORDER BY ts_us, event_id)")
def rate_per_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Throughput between samples of a counter that only grows; the first of a user has none."""
    w = Window.partitionBy("user_id").orderBy("ts_us", "event_id")
    e = events(spark, sf_dir).withColumn("sent", F.sum((F.col("value") * 1e6).cast("decimal(20,0)").cast("long")).over(w))
    return e.select("event_id", F.round((F.col("sent") - F.lag("sent").over(w)) * 8 / 1e6 / ((F.col("ts_us") - F.lag("ts_us").over(w)) / 1e6), 2).alias("mbps"))


@query(f"SELECT stream, hour, n, lag(n) OVER (PARTITION BY stream ORDER BY hour) - n AS dropped FROM (SELECT stream, ts_us // 3600000000 AS hour, count(*) AS n FROM {E} GROUP BY 1, 2) QUALIFY lag(n) OVER (PARTITION BY stream ORDER BY hour) > n")
def count_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours that kept fewer rows than the hour before in the stream."""
    n = events(spark, sf_dir).groupBy("stream", F.expr("ts_us div 3600000000").alias("hour")).agg(F.count("*").alias("n"))
    before = F.lag("n").over(Window.partitionBy("stream").orderBy("hour"))
    return n.withColumn("dropped", before - F.col("n")).filter("dropped > 0").select("stream", "hour", "n", "dropped")


MOVES = f"(SELECT user_id, stream, ts_us, event_id, abs(value - lag(value) OVER (PARTITION BY user_id, stream ORDER BY ts_us, event_id)) AS move FROM {E})"


@query(f"SELECT user_id, stream, event_id, round(move, 6) AS move FROM {MOVES} WHERE move IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY move DESC, event_id) <= 5")
def largest_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user the five largest moves of a stream's value between its consecutive samples."""
    w = Window.partitionBy("user_id", "stream").orderBy("ts_us", "event_id")
    m = events(spark, sf_dir).withColumn("move", F.abs(F.col("value") - F.lag("value").over(w))).filter("move IS NOT NULL")
    top = m.withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("move"), "event_id"))).filter("i <= 5")
    return top.select("user_id", "stream", "event_id", F.round("move", 6).alias("move"))


@query(f"SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts_us, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS mean, count(*) OVER (PARTITION BY user_id ORDER BY ts_us, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS n FROM {E}")
def recent_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool of the five values before each."""
    w = Window.partitionBy("user_id").orderBy("ts_us", "event_id").rowsBetween(-5, -1)
    return events(spark, sf_dir).select("event_id", F.round(F.avg("value").over(w), 6).alias("mean"), F.count("*").over(w).alias("n"))


@query(f"SELECT user_id, CASE WHEN count(*) < 2 OR max(value) <= min(value) THEN NULL WHEN min(value) >= 0 AND max(abs(value)) / min(abs(value)) FILTER (value <> 0) > 1000 THEN 'log' ELSE 'linear' END AS scale FROM {E} GROUP BY user_id")
def number_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a pool of numbers is scaled: by logarithm when it spans far and has none below 0; not at all when flat."""
    v = F.col("value")
    g = events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.min(F.when(v != 0, F.abs(v))).alias("least"), F.max(F.abs(v)).alias("most"))
    return g.select("user_id", verdicts.scale(*map(F.col, ("n", "lo", "hi", "least", "most"))).alias("scale"))


@query(f"SELECT stream, n, round(log10(n + 1) / log10(max(n) OVER () + 1), 6) AS fill FROM (SELECT user_id % 10 || stream AS stream, count(*) AS n FROM {E} GROUP BY 1)")
def log_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A count's share of the largest, by logarithm. The largest is one row, joined to all."""
    g = events(spark, sf_dir).groupBy(F.concat((F.col("user_id") % 10).cast("string"), "stream").alias("stream")).agg(F.count("*").alias("n"))
    most = F.broadcast(g.agg(F.max("n").alias("most")))
    return g.join(most, how="cross").select("stream", "n", F.round(F.log10(F.col("n") + 1) / F.log10(F.col("most") + 1), 6).alias("fill"))


@query(
    f"""SELECT event_id, ts_us // 1000000 AS sec, ts_us % 1000000 * 1000 AS nsec, floor(value + 0.5)::BIGINT AS half_up, CASE WHEN value < 60 THEN printf('%.1fs', value) ELSE printf('%dm%02ds', floor(value + 0.5)::BIGINT // 60, floor(value + 0.5)::BIGINT % 60) END AS lasted
    FROM (SELECT * REPLACE (round(value, 1) AS value) FROM {E}) WHERE value * 10 % 5 <> 0"""
)
def stamps_and_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds and nanoseconds of a stamp, a value rounded half up, and a span of seconds as text."""
    v = F.round("value", 1)
    whole = F.floor(v + 0.5)
    text = F.when(v < 60, F.format_string("%.1fs", v)).otherwise(F.format_string("%dm%02ds", F.floor(whole / 60), whole % 60))
    return events(spark, sf_dir).filter(v * 10 % 5 != 0).select("event_id", F.expr("ts_us div 1000000").alias("sec"), (F.col("ts_us") % 1_000_000 * 1000).alias("nsec"), whole.cast("long").alias("half_up"), text.alias("lasted"))


@query("SELECT doc_id, sha256(text) AS digest, base64(encode(lang)) AS code FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL")
def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("digest"), F.base64(F.encode("lang", "UTF-8")).alias("code"))


@query("SELECT conv_id, list_slice(list(turn ORDER BY turn), -3, -1)::VARCHAR AS last_turns, len(list_distinct(list(role)))::BIGINT AS roles, count(*)::BIGINT AS n FROM conversations GROUP BY conv_id")
def array_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three of an array, and how many distinct it holds."""
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("t"), F.countDistinct("role").alias("roles"), F.count("*").alias("n"))
    last = F.slice("t", F.greatest(F.lit(1), F.size("t") - 2), F.lit(3))
    return g.select("conv_id", F.concat(F.lit("["), F.array_join(last.cast("array<string>"), ", "), F.lit("]")).alias("last_turns"), "roles", "n")


@query(f"SELECT user_id, string_agg(stream || '=' || n, ',' ORDER BY n DESC, stream) AS kinds, coalesce(max(n) FILTER (stream = 'error'), 0) AS errors FROM (SELECT user_id, stream, count(*) AS n FROM {E} GROUP BY 1, 2) GROUP BY user_id")
def map_entries_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map of counts: its entries, the largest first, and one looked up with a default."""
    n = events(spark, sf_dir).groupBy("user_id", "stream").agg(F.count("*").alias("n"))
    m = n.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("stream", "n"))).alias("m"))
    entries = F.array_sort(F.transform(F.map_entries("m"), lambda e: F.struct((-e["value"]).alias("less"), e["key"].alias("key"))))
    text = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), (-e["less"]).cast("string"))), ",")
    return m.select("user_id", text.alias("kinds"), F.coalesce(F.element_at("m", "error"), F.lit(0)).alias("errors"))
