"""Stream profiling over events: a stream is an event type, a recording a user."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import profile, ranges, thinning, throttle
from ..operators.settle import settled
from .registry import query, table

E = "(SELECT event_id, event_type AS stream, user_id, value, epoch_us(ts) AS ts_us FROM events)"
GAPS = f"(SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY stream ORDER BY ts_us, event_id) AS gap_us FROM {E})"
GAP_RANKS = f"(SELECT stream, gap_us, row_number() OVER (PARTITION BY stream ORDER BY gap_us) AS i, count(*) OVER (PARTITION BY stream) AS n FROM {GAPS} WHERE gap_us IS NOT NULL)"
CUT = 1_705_276_800_000_000


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("stream"), "user_id", "value", profile.micros("ts").alias("ts_us"))


@query(
    f"""SELECT stream, count(*) AS n, min(ts_us) AS start_us, max(ts_us) AS end_us, (max(ts_us) - min(ts_us)) / 1e6 AS duration_s,
    CASE WHEN max(ts_us) > min(ts_us) THEN count(*) / ((max(ts_us) - min(ts_us)) / 1e6) ELSE 0.0 END AS hz FROM {E} GROUP BY stream"""
)
def stream_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.summary(events(spark, sf_dir), "stream", "ts_us")


@query(
    f"""SELECT *, max_gap_us / nullif(mean_gap_us, 0) AS max_ratio, p99_gap_us / nullif(mean_gap_us, 0) AS p99_ratio
    FROM (SELECT stream, max(gap_us) AS max_gap_us, max(gap_us) FILTER (i = ceil(0.99 * n)) AS p99_gap_us, sum(gap_us) / count(*) AS mean_gap_us FROM {GAP_RANKS} GROUP BY stream)"""
)
def stream_gaps_p99(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.gaps(events(spark, sf_dir), "stream", "ts_us")


@query(f"SELECT count(DISTINCT stream) AS streams, count(*) AS messages, min(ts_us) AS start_us, max(ts_us) AS end_us FROM {E}")
def stream_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).agg(F.countDistinct("stream").alias("streams"), F.count("*").alias("messages"), F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"))


@query(f"SELECT event_id, stream, ts_us FROM (SELECT *, min(ts_us) OVER (PARTITION BY stream) AS b FROM {E}) WHERE ts_us <= b + 86400000000 OR stream = 'error'")
def stream_first_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.first_seconds(events(spark, sf_dir), "stream", "ts_us", 86_400, F.col("stream") == "error").select("event_id", "stream", "ts_us")


@query(f"SELECT event_id, stream FROM (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY ts_us, event_id) - 1 AS i FROM {E}) WHERE i % 7 = 0")
def stream_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.every_nth(events(spark, sf_dir), "stream", ["ts_us", "event_id"], 7).select("event_id", "stream")


@query(f"SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS i FROM {E}) WHERE i <= 5")
def stream_limit_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.first_rows(events(spark, sf_dir), "user_id", ["ts_us", "event_id"], 5).select("event_id", "user_id")


def emitted(every: int) -> str:
    """A recursive query for (stream, ts_us): the stamps of a stream's first row and of each first one `every` after the last of these."""
    return f"""WITH RECURSIVE e AS MATERIALIZED {E}, k AS (SELECT stream, min(ts_us) AS ts_us FROM e GROUP BY stream
        UNION ALL SELECT e.stream, min(e.ts_us) FROM k JOIN e ON e.stream = k.stream AND e.ts_us >= k.ts_us + {every} GROUP BY e.stream)"""


@query(f"{emitted(3_600_000_000)} SELECT min(event_id) AS event_id, stream, ts_us FROM e JOIN k USING (stream, ts_us) GROUP BY stream, ts_us")
def throttle_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return throttle.throttled(events(spark, sf_dir), "stream", "ts_us", 3_600_000_000, ["event_id"]).select("event_id", "stream", "ts_us")


@query(f"{emitted(5_400_000_000)}, f AS (SELECT min(event_id) AS event_id FROM e JOIN k USING (stream, ts_us) GROUP BY stream, ts_us) SELECT event_id, event_id IN (SELECT event_id FROM f) AS emits FROM e")
def republish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a static edge rides along: with a stream's first message, and the first one 90 minutes after it last did."""
    return throttle.republished(events(spark, sf_dir), "stream", "ts_us", 5_400_000_000, ["event_id"]).select("event_id", "emits")


@query(
    f"""WITH RECURSIVE e AS (SELECT stream, list({{'w': value, 't': ts_us, 'id': event_id}} ORDER BY value DESC, ts_us, event_id) AS l FROM {E} GROUP BY stream),
    p AS (SELECT stream, 1 AS i, [l[1]] AS kept FROM e UNION ALL
        SELECT stream, i + 1, CASE WHEN len(list_filter(kept, lambda k: abs(k.t - l[i + 1].t) <= 3600000000)) = 0 THEN list_append(kept, l[i + 1]) ELSE kept END FROM p JOIN e USING (stream) WHERE i < len(l))
    SELECT stream, unnest(list_transform(kept, lambda k: k.id)) AS event_id FROM (SELECT stream, arg_max(kept, i) AS kept FROM p GROUP BY stream)"""
)
def suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by value, each more than an hour from all of its stream that were picked before it."""
    return thinning.suppressed(events(spark, sf_dir), "stream", "ts_us", "value", ["event_id"], 3_600_000_000)[0].select("stream", "event_id")


BUDGET = 5000
STATES = f"(SELECT stream, list({{'v': value, 'n': 12 + 6 * (event_id % 7), 'loose': 0::BIGINT, 'ids': [event_id]}} ORDER BY ts_us, event_id) AS l FROM {E} GROUP BY stream)"
#: A fold over l with the limit m: the size of what it keeps but for its last row, what that adds, and the ids.
FOLD = "list_reduce(l, lambda a, x: CASE WHEN abs(x.v - a.v) > m THEN {'v': x.v, 'n': a.n + x.n, 'loose': 0::BIGINT, 'ids': a.ids || x.ids} ELSE {'v': a.v, 'n': a.n, 'loose': x.n, 'ids': a.ids} END)"


@query(
    f"""WITH RECURSIVE s AS MATERIALIZED {STATES}, whole AS (SELECT *, list_sum(list_transform(l, lambda x: x.n)) > {BUDGET} AS large FROM s),
    b AS (SELECT stream, 0 AS i, 0::DOUBLE AS low, 10000::DOUBLE AS high FROM whole WHERE large UNION ALL
        SELECT stream, i + 1, CASE WHEN r.n + r.loose > {BUDGET} THEN m ELSE low END, CASE WHEN r.n + r.loose > {BUDGET} THEN high ELSE m END
        FROM (SELECT *, {FOLD} AS r FROM (SELECT stream, i, low, high, (low + high) / 2 AS m, l FROM b JOIN s USING (stream) WHERE i < 30))),
    f AS (SELECT stream, m, list_distinct({FOLD}.ids || l[-1].ids) AS ids FROM (SELECT stream, high AS m, l FROM b JOIN s USING (stream) WHERE i = 30)
        UNION ALL SELECT stream, 0, list_transform(l, lambda x: x.ids[1]) FROM whole WHERE NOT large)
    SELECT stream, unnest(ids) AS event_id, round(m, 5) AS limit_m FROM f"""
)
def thinned_to_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States kept so that a stream's value is never further from the last one kept than the least limit that fits 5,000 bytes."""
    states = events(spark, sf_dir).withColumn("size", F.expr("12 + 6 * (event_id % 7)"))
    out = thinning.thinned(states, "stream", ["ts_us", "event_id"], ["value"], "size", BUDGET)
    return out.select("stream", "event_id", F.round("limit", 5).alias("limit_m"))


@query(f"SELECT stream, arg_max(event_id, (ts_us, event_id)) AS last_id, max(ts_us) AS last_us, arg_min(event_id, (ts_us, event_id)) AS first_id, min(ts_us) AS first_us FROM {E} GROUP BY stream")
def first_last_per_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.struct("ts_us", "event_id")
    return events(spark, sf_dir).groupBy("stream").agg(F.max_by("event_id", key).alias("last_id"), F.max("ts_us").alias("last_us"), F.min_by("event_id", key).alias("first_id"), F.min("ts_us").alias("first_us"))


@query(f"SELECT stream, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY ts_us DESC, event_id DESC) AS i FROM {E}) WHERE i = 1")
def latest_per_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = F.max(F.struct("ts_us", "event_id", "value")).alias("m")
    return events(spark, sf_dir).groupBy("stream").agg(latest).select("stream", "m.event_id", "m.value")


@query(f"SELECT event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS delta, ts_us - lag(ts_us) OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS gap_us FROM {E}")
def counter_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts_us", "event_id")
    return events(spark, sf_dir).select("event_id", (F.col("value") - F.lag("value").over(w)).alias("delta"), (F.col("ts_us") - F.lag("ts_us").over(w)).alias("gap_us"))


@query(f"SELECT event_id, stream, ts_us, CASE stream WHEN 'view' THEN 1 ELSE 2 END AS stream_ord FROM {E} WHERE stream IN ('view', 'click')")
def merge_time_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("event_id", "stream", "ts_us")
    both = e.filter("stream = 'view'").withColumn("stream_ord", F.lit(1)).unionByName(e.filter("stream = 'click'").withColumn("stream_ord", F.lit(2)))
    return both.orderBy("ts_us", "stream_ord", "event_id")


@query(f"SELECT CASE WHEN ts_us < {CUT} THEN 'head' ELSE 'tail' END AS part, count(*) AS n, min(ts_us) AS start_us, max(ts_us) AS end_us FROM {E} GROUP BY 1")
def cut_head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    head, tail = profile.cut(events(spark, sf_dir), "ts_us", CUT)
    both = head.withColumn("part", F.lit("head")).unionByName(tail.withColumn("part", F.lit("tail")))
    return both.groupBy("part").agg(F.count("*").alias("n"), F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"))


LATE = 1_706_630_000_000_000


@query(f"SELECT user_id, arg_max(event_id, (ts_us, event_id)) AS event_id FROM {E} GROUP BY user_id HAVING max(ts_us) < {LATE}")
def carry_over_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.carry_over(events(spark, sf_dir), "user_id", "ts_us", LATE, "event_id").select("user_id", "event_id")


@query(f"SELECT stream, max(gap_us) FILTER (i = ceil(0.5 * n)) AS p50, max(gap_us) FILTER (i = ceil(0.99 * n)) AS p99 FROM {GAP_RANKS} GROUP BY stream")
def pctl_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = profile.with_gap(events(spark, sf_dir).select("event_id", "stream", "ts_us"), "stream", "ts_us", "event_id")
    return ranges.at_ranks(settled(g.select("stream", "gap_us")), ["stream"], "gap_us", {"p50": ranges.nearest_rank(0.5), "p99": ranges.nearest_rank(0.99)})


RANKED = f"(SELECT stream, value, row_number() OVER (PARTITION BY stream ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY stream) AS n FROM {E})"


@query(f"SELECT stream, max(value) FILTER (i = least(n - 1, floor(0.5 * n))) AS p50, max(value) FILTER (i = least(n - 1, floor(0.95 * n))) AS p95 FROM {RANKED} GROUP BY stream")
def pctl_floor_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.at_ranks(events(spark, sf_dir), ["stream"], "value", {"p50": ranges.floor_rank(0.5), "p95": ranges.floor_rank(0.95)})


@query(f"SELECT stream, max(value) FILTER (i = n // 2) AS median FROM {RANKED} GROUP BY stream")
def median_upper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.at_ranks(events(spark, sf_dir), ["stream"], "value", {"median": F.expr("n div 2")})


@query(f"SELECT stream, round(quantile_cont(value, 0.05), 6) AS p05 FROM {E} GROUP BY stream")
def pctl_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.linear_percentile(events(spark, sf_dir), ["stream"], "value", 0.05, "p05").withColumn("p05", F.round("p05", 6))


@query(f"SELECT stream, ts_us // 60000000 AS minute, count(*) AS n FROM {E} GROUP BY 1, 2")
def window_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("stream", F.expr("ts_us div 60000000").alias("minute")).agg(F.count("*").alias("n"))


@query(
    f"""SELECT stream, (w * 1800000000)::BIGINT AS start_us, count(*) AS n FROM (SELECT stream, unnest([ts_us // 1800000000 - 1, ts_us // 1800000000]) AS w FROM {E}) GROUP BY 1, 2"""
)
def window_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.expr("ts_us div 1800000000")
    starts = events(spark, sf_dir).select("stream", F.explode(F.array((at - 1) * 1_800_000_000, at * 1_800_000_000)).alias("start_us"))
    return starts.groupBy("stream", "start_us").agg(F.count("*").alias("n"))


SESSIONS = "(SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS gap FROM " + E + "))"


@query(f"SELECT user_id, min(ts_us) AS start_us, max(ts_us) AS last_us, count(*) AS n FROM {SESSIONS} GROUP BY user_id, s")
def window_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("t", F.timestamp_micros("ts_us"))
    return e.groupBy("user_id", F.session_window("t", "6 hours")).agg(F.min("ts_us").alias("start_us"), F.max("ts_us").alias("last_us"), F.count("*").alias("n")).drop("session_window")


@query(f"SELECT event_id, (row_number() OVER w - 1) / nullif(count(*) OVER (PARTITION BY stream) - 1, 0) AS share, lead(event_id) OVER w AS next_id FROM {E} WINDOW w AS (PARTITION BY stream ORDER BY ts_us, event_id)")
def path_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ranges.placed(events(spark, sf_dir).select("event_id", "stream", "ts_us"), ["stream"], ["ts_us", "event_id"], rank="i", total="n", after={"next_id": "event_id"})
    return e.select("event_id", (F.col("i") / F.nullif(F.col("n") - 1, F.lit(0))).alias("share"), "next_id")


@query(f"SELECT event_id, lead(value) OVER w - lag(value) OVER w AS dv, lead(ts_us) OVER w - lag(ts_us) OVER w AS dt_us FROM {E} WINDOW w AS (PARTITION BY user_id ORDER BY ts_us, event_id)")
def central_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts_us", "event_id")
    diff = lambda c: F.lead(c).over(w) - F.lag(c).over(w)
    return events(spark, sf_dir).select("event_id", diff("value").alias("dv"), diff("ts_us").alias("dt_us"))


@query(f"SELECT event_id, stream, value FROM (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY value DESC, event_id) AS i FROM {E}) WHERE i <= 5")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.first_rows(events(spark, sf_dir), "stream", [F.desc("value"), F.asc("event_id")], 5).select("event_id", "stream", "value")


@query(f"SELECT event_id, stream, i AS rank FROM (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY value DESC, event_id) AS i FROM {E}) ORDER BY i, stream LIMIT 12")
def roundrobin_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("stream").orderBy(F.desc("value"), "event_id")
    return events(spark, sf_dir).withColumn("rank", F.row_number().over(w)).filter("rank <= 12").orderBy("rank", "stream").limit(12).select("event_id", "stream", "rank")
