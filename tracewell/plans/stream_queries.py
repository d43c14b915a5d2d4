"""Streams over the events table as a file source, run over what there is."""

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import profile
from ..streaming import live, machines
from ..streaming.drain import drained
from .profile_queries import E
from .registry import query, table


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return source.select("event_id", "user_id", F.col("event_type").alias("stream"), F.timestamp_micros(profile.micros("ts")).alias("at"))


#: How far a stream's watermark got: ten minutes behind the newest row, in whole milliseconds.
MARK = f"(SELECT (max(ts_us) // 1000 - 600000) * 1000 FROM {E})"


@query(f"SELECT ts_us // 3600000000 * 3600000000 AS start_us, stream, count(*) AS n FROM {E} GROUP BY 1, 2")
def live_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All windows, those too that the watermark has not closed."""
    return drained(live.tumbling_counts(rows(spark, sf_dir), "1 hour"), "complete")


@query(f"SELECT start_us, stream, n / 86400.0 AS hz FROM (SELECT ts_us // 86400000000 * 86400000000 AS start_us, stream, count(*) AS n FROM {E} GROUP BY 1, 2) WHERE n / 86400.0 >= 0.00005")
def live_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(live.rates(rows(spark, sf_dir), "1 day", 86_400.0, 0.00005), "complete")


@query(
    f"""SELECT user_id, min(ts_us) AS open_us, max(ts_us) + 21600000000 AS fold_us, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS s
    FROM (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY user_id ORDER BY ts_us, event_id) < 21600000000 THEN 0 ELSE 1 END AS fresh FROM {E})) GROUP BY user_id, s"""
)
def live_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(live.panels(rows(spark, sf_dir), "6 hours"), "complete")


@query(
    f"""SELECT user_id, open_us, fold_us, n, last FROM (SELECT user_id, min(ts_us) FILTER (stream <> 'error') AS open_us, coalesce(min(ts_us) FILTER (stream = 'error'), max(ts_us) + 21600000000) AS fold_us, count(*) FILTER (stream <> 'error') AS n,
        arg_max(stream, ts_us) FILTER (stream <> 'error') AS last, bool_or(stream = 'error') AS marked FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS s
        FROM (SELECT *, CASE WHEN lag(stream) OVER w = 'error' OR ts_us - lag(ts_us) OVER w > 21600000000 OR lag(ts_us) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM {E} WINDOW w AS (PARTITION BY user_id ORDER BY ts_us, event_id))) GROUP BY user_id, s)
    WHERE n > 0 AND (marked OR fold_us + 1 <= {MARK})"""
)
def live_tool_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panels that a marker folds at once, and silence of six hours else, without a next row."""
    e = rows(spark, sf_dir).select("user_id", "at", "event_id", F.col("stream").alias("kind"), F.col("stream").alias("text"))
    return drained(machines.run(e, partial(machines.Panel, "error", 6 * 3600 * machines.SECOND), "user_id", ["event_id", "kind", "text"], machines.Panel.schema))


AGENT, BEAT = 12 * 3_600_000_000, 3 * 3_600_000_000


@query(
    f"""WITH e AS MATERIALIZED {E}, t AS (SELECT user_id, ts_us AS at_us FROM e UNION SELECT user_id, ts_us + {AGENT} FROM e WHERE stream = 'click' AND ts_us + {AGENT} <= {MARK} UNION SELECT user_id, ts_us + {BEAT} FROM e WHERE stream = 'view' AND ts_us + {BEAT} <= {MARK}),
    s AS (SELECT t.user_id, at_us, max(e.ts_us) FILTER (stream = 'click') OVER w AS agent, max(e.ts_us) FILTER (stream = 'view') OVER w AS beat, max(e.ts_us) FILTER (stream = 'signup') OVER w AS up, max(e.ts_us) FILTER (stream = 'error') OVER w AS down,
        count(*) FILTER (stream = 'purchase') OVER w AS runs FROM t LEFT JOIN e ON e.user_id = t.user_id AND e.ts_us = t.at_us WINDOW w AS (PARTITION BY t.user_id ORDER BY at_us)),
    a AS (SELECT user_id, at_us, CASE WHEN up IS NULL OR down > up THEN 'no-bridge' WHEN at_us - agent < {AGENT} OR at_us - beat < {BEAT} THEN 'live' WHEN agent IS NOT NULL THEN 'stale' WHEN runs > 0 THEN 'probably' ELSE 'searching' END AS state FROM s)
    SELECT user_id, at_us, state FROM (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY at_us) AS before FROM a) WHERE state IS DISTINCT FROM before"""
)
def live_presence_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five states of whether anyone listens; what silence changes is told when the watermark passes it."""
    names = {"signup": "up", "error": "down", "click": "agent", "view": "agent_module", "purchase": "run"}
    signal = F.coalesce(*[F.when(F.col("stream") == k, v) for k, v in names.items()])
    e = rows(spark, sf_dir).select("user_id", "at", signal.alias("signal"))
    make = partial(machines.Presence, AGENT, BEAT, 366 * 86_400 * machines.SECOND)
    return drained(machines.run(e, make, "user_id", ["signal"], machines.Presence.schema))


GRACE, POLL = 3 * 86_400_000_000, 86_400_000_000


@query(
    f"""WITH e AS MATERIALIZED (SELECT user_id, ts_us, user_id || '/' || event_id % 9 AS child, event_id % 9 // 2 + event_id % 8 // 7 AS parent FROM {E}),
    f AS (SELECT user_id, child, parent, min(ts_us) AS ts_us FROM e GROUP BY 1, 2, 3), m AS (SELECT user_id, child, ts_us FROM (SELECT *, row_number() OVER (PARTITION BY user_id, child ORDER BY ts_us) AS i FROM f) WHERE i = 2),
    b AS (SELECT user_id, min(ts_us) + {GRACE} AS first FROM e GROUP BY 1), p AS (SELECT user_id, first + greatest(0, ceil((min(ts_us) - first) / {POLL}))::BIGINT * {POLL} AS at_us FROM m JOIN b USING (user_id) GROUP BY user_id, first)
    SELECT user_id, p.at_us, 'multiple parents' AS kind, string_agg(child, ',' ORDER BY child) AS frames FROM p JOIN m USING (user_id) WHERE m.ts_us <= p.at_us AND p.at_us <= {MARK} GROUP BY 1, 2"""
)
def live_broken_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first look, three days after a recording begins and then each day, that finds frames with more than one parent."""
    child = F.concat(F.col("user_id").cast("string"), F.lit("/"), (F.col("event_id") % 9).cast("string"))
    parent = (F.floor(F.col("event_id") % 9 / 2) + F.floor(F.col("event_id") % 8 / 7)).cast("string")
    e = rows(spark, sf_dir).select("user_id", "at", child.alias("child"), parent.alias("parent"))
    return drained(machines.run(e, partial(machines.BrokenTree, GRACE, POLL), "user_id", ["child", "parent"], machines.BrokenTree.schema)).filter("kind = 'multiple parents'")


@query(f"SELECT DISTINCT user_id, stream FROM {E}")
def live_firsts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(live.firsts(rows(spark, sf_dir), ["user_id", "stream"]))


IDLE, AWAY = 6 * 3_600_000_000, 48 * 3_600_000_000


@query(
    f"""WITH g AS (SELECT user_id, ts_us, lag(ts_us) OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS last FROM {E})
    SELECT user_id, ts_us AS at_us, 'online' AS state FROM g WHERE last IS NULL OR ts_us - last > {IDLE} UNION ALL SELECT user_id, last + {IDLE}, 'idle' FROM g WHERE ts_us - last > {IDLE} UNION ALL SELECT user_id, last + {AWAY}, 'away' FROM g WHERE ts_us - last > {AWAY}"""
)
def live_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(live.presence(rows(spark, sf_dir), IDLE, AWAY))


@query(f"SELECT event_id FROM {E} JOIN (SELECT user_id, min(ts_us) AS opened FROM {E} WHERE stream = 'purchase' GROUP BY 1) USING (user_id) WHERE stream = 'view' AND ts_us >= opened")
def live_released(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(live.released(rows(spark, sf_dir), "purchase", "view"))


PATIENCE = 3 * 86_400_000_000


@query(
    f"""WITH e AS MATERIALIZED (SELECT event_id, user_id, stream, ts_us FROM {E} WHERE stream IN ('purchase', 'view')), h AS (SELECT user_id, min(ts_us) FILTER (stream = 'purchase') AS opened, min(ts_us) FILTER (stream = 'view') + {PATIENCE} AS due, max(ts_us) AS latest FROM e GROUP BY user_id)
    SELECT event_id FROM e JOIN h USING (user_id) WHERE stream = 'view' AND CASE WHEN opened <= due THEN ts_us >= opened ELSE due <= {MARK} OR latest > due END"""
)
def live_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views held until their user's first purchase; all pass where none comes within three days of the first."""
    e = rows(spark, sf_dir).filter("stream IN ('purchase', 'view')").select("user_id", "at", "stream", "event_id")
    return drained(machines.run(e, partial(machines.Held, "purchase", PATIENCE), "user_id", ["stream", "event_id"], machines.Held.schema)).select("event_id")
