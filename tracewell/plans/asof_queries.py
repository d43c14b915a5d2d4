"""As-of joins: clicks probe the same user's views."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import asof
from .profile_queries import E, events
from .registry import query

SIDES = f"""p AS (SELECT * FROM {E} WHERE stream = 'click'), s AS (SELECT * FROM {E} WHERE stream = 'view'),
b AS (SELECT p.event_id, p.ts_us, s.ts_us AS bt, s.value AS bv FROM p ASOF LEFT JOIN s ON p.user_id = s.user_id AND p.ts_us >= s.ts_us),
n AS (SELECT b.*, s.ts_us AS nt, s.value AS av FROM b JOIN p USING (event_id) ASOF LEFT JOIN s ON p.user_id = s.user_id AND p.ts_us <= s.ts_us)"""
LERP = "CASE WHEN bt IS NULL THEN av WHEN nt IS NULL OR nt = bt THEN bv ELSE bv + (ts_us - bt) / (nt - bt) * (av - bv) END"


def both(spark: SparkSession, sf_dir: str, **sides: bool) -> DataFrame:
    e = events(spark, sf_dir)
    return asof.neighbours(e.filter("stream = 'click'"), e.filter("stream = 'view'"), "user_id", "ts_us", "value", "event_id", **sides)


@query(f"WITH {SIDES} SELECT event_id, bt AS sample_us, bv AS value FROM n")
def asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return both(spark, sf_dir, ahead=False).select("event_id", F.col("before.ts").alias("sample_us"), F.col("before.value").alias("value"))


@query(f"WITH {SIDES} SELECT event_id, coalesce(nt, bt) AS sample_us, coalesce(av, bv) AS value FROM n")
def asof_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At or after, clamped to the last sample."""
    s = F.coalesce("after", "before")
    return both(spark, sf_dir).select("event_id", s["ts"].alias("sample_us"), s["value"].alias("value"))


@query(f"WITH {SIDES} SELECT event_id, CASE WHEN nt - ts_us <= 7200000000 THEN av WHEN ts_us - bt <= 7200000000 THEN bv END AS value FROM n")
def asof_nearest_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return both(spark, sf_dir).select("event_id", asof.nearest_within("ts_us", 7_200_000_000).alias("value"))


@query(f"WITH {SIDES} SELECT event_id, round({LERP}, 6) AS value FROM n")
def asof_interpolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return both(spark, sf_dir).select("event_id", F.round(asof.interpolated("ts_us"), 6).alias("value"))


@query(
    f"""WITH {SIDES}, d AS (SELECT *, coalesce(ts_us - bt, 4611686018427387904) AS tb, coalesce(nt - ts_us, 4611686018427387904) AS ta FROM n)
    SELECT event_id, round(CASE WHEN nt - bt <= 86400000000 THEN {LERP} WHEN tb <= ta AND tb <= 7200000000 THEN bv WHEN ta <= 7200000000 THEN av END, 6) AS value FROM d"""
)
def asof_gap_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return both(spark, sf_dir).select("event_id", F.round(asof.gap_limited("ts_us", 86_400_000_000, 7_200_000_000), 6).alias("value"))


@query(f"WITH {SIDES} SELECT event_id, nt AS first_us FROM n WHERE nt - ts_us <= 36000000000")
def state_after_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first state within ten hours after an event."""
    return both(spark, sf_dir, back=False).filter("after.ts - ts_us <= 36000000000").select("event_id", F.col("after.ts").alias("first_us"))


STATES = f"""v AS (SELECT * FROM {E} WHERE stream = 'view'), st AS (SELECT * FROM {E} WHERE stream = 'purchase'),
j AS (SELECT v.event_id, v.user_id, v.ts_us, v.value, st.ts_us AS state_us, st.value AS state FROM v ASOF LEFT JOIN st ON v.user_id = st.user_id AND v.ts_us >= st.ts_us)"""


@query(f"WITH {STATES} SELECT event_id, state_us, round(CASE WHEN state IS NULL THEN value ELSE state + value END, 4) AS belief FROM j")
def state_as_of_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is believed at each view: the newest state with the view's raw reading carried on it; the raw one where there is no state yet."""
    e = events(spark, sf_dir)
    out = asof.last_before(e.filter("stream = 'view'").select("user_id", "ts_us", "event_id", "value"), e.filter("stream = 'purchase'"), "user_id", "ts_us", ["value"], "state")
    return out.select("event_id", F.col("state.ts").alias("state_us"), F.round(F.coalesce(F.col("state.value") + F.col("value"), "value"), 4).alias("belief"))


@query(f"WITH {STATES} SELECT user_id, count(*) AS views, count(state_us) AS placed, max(state_us) AS last_state_us FROM j GROUP BY user_id")
def last_edge_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user: views, those with an edge event at or before them, and the last such event of all."""
    e = events(spark, sf_dir)
    out = asof.last_before(e.filter("stream = 'view'").select("user_id", "ts_us"), e.filter("stream = 'purchase'"), "user_id", "ts_us", ["value"], "state")
    return out.groupBy("user_id").agg(F.count("*").alias("views"), F.count("state").alias("placed"), F.max("state.ts").alias("last_state_us"))


@query(
    f"""WITH r AS (SELECT user_id, stream, min(ts_us) AS a, max(ts_us) AS b FROM {E} GROUP BY 1, 2)
    SELECT x.user_id, x.stream, round(greatest(0, least(x.b, y.b) - greatest(x.a, y.a))::DOUBLE / greatest(x.b - x.a, 1), 6) AS overlap, greatest(0, least(x.b, y.b) - greatest(x.a, y.a))::DOUBLE / greatest(x.b - x.a, 1) < 0.9 AS refused
    FROM r x JOIN r y ON x.user_id = y.user_id AND y.stream = 'view' AND x.stream <> 'view'"""
)
def clock_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each stream's span that the user's views cover; under nine tenths the two clocks are not joined."""
    r = events(spark, sf_dir).groupBy("user_id", "stream").agg(F.min("ts_us").alias("a"), F.max("ts_us").alias("b"))
    views = r.filter("stream = 'view'").select("user_id", F.col("a").alias("va"), F.col("b").alias("vb"))
    share = F.greatest(F.lit(0), F.least("b", "vb") - F.greatest("a", "va")) / F.greatest(F.col("b") - F.col("a"), F.lit(1))
    return r.filter("stream <> 'view'").join(views, "user_id").select("user_id", "stream", F.round(share, 6).alias("overlap"), (share < 0.9).alias("refused"))
