"""Rigid transforms: vectors of embeddings stand for poses, events for a robot's samples over time."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pose
from ..operators import asof, chains, spatial
from ..operators.profile import micros
from .registry import query, table

UNIT = "list_transform({q}, lambda x: x / sqrt(list_sum(list_transform({q}, lambda y: y * y))))"
Q, R = UNIT.format(q="embedding[1:4]"), UNIT.format(q="embedding[5:8]")
BASE = f"(SELECT vec_id, {Q.replace('embedding', 'CAST(embedding AS DOUBLE[])')} AS q, {R.replace('embedding', 'CAST(embedding AS DOUBLE[])')} AS r, CAST(embedding AS DOUBLE[])[9:11] AS v, CAST(embedding AS DOUBLE[])[12:14] AS w FROM embeddings)"
#: The product as a 4 x 4 matrix of p times q, and a rotation as a 3 x 3 matrix times v.
PRODUCT = "[{p}[4]*{q}[1] - {p}[3]*{q}[2] + {p}[2]*{q}[3] + {p}[1]*{q}[4], {p}[3]*{q}[1] + {p}[4]*{q}[2] - {p}[1]*{q}[3] + {p}[2]*{q}[4], -{p}[2]*{q}[1] + {p}[1]*{q}[2] + {p}[4]*{q}[3] + {p}[3]*{q}[4], -{p}[1]*{q}[1] - {p}[2]*{q}[2] - {p}[3]*{q}[3] + {p}[4]*{q}[4]]"
MATRIX = "[[1 - 2*({q}[2]*{q}[2] + {q}[3]*{q}[3]), 2*({q}[1]*{q}[2] - {q}[3]*{q}[4]), 2*({q}[1]*{q}[3] + {q}[2]*{q}[4])], [2*({q}[1]*{q}[2] + {q}[3]*{q}[4]), 1 - 2*({q}[1]*{q}[1] + {q}[3]*{q}[3]), 2*({q}[2]*{q}[3] - {q}[1]*{q}[4])], [2*({q}[1]*{q}[3] - {q}[2]*{q}[4]), 2*({q}[2]*{q}[3] + {q}[1]*{q}[4]), 1 - 2*({q}[1]*{q}[1] + {q}[2]*{q}[2])]]"
TURNED = "[{m}[1][1]*{v}[1] + {m}[1][2]*{v}[2] + {m}[1][3]*{v}[3], {m}[2][1]*{v}[1] + {m}[2][2]*{v}[2] + {m}[2][3]*{v}[3], {m}[3][1]*{v}[1] + {m}[3][2]*{v}[2] + {m}[3][3]*{v}[3]]"


def rounded(names: str, columns: tuple[Column, ...]) -> list[Column]:
    """Columns at five digits; adding 0 makes a negative zero positive."""
    return [(F.round(c, 5) + 0.0).alias(n) for n, c in zip(names.split(), columns, strict=True)]


def listed(names: str, source: str) -> str:
    return ", ".join(f"round({source}[{i}], 5) + 0.0 AS {n}" for i, n in enumerate(names.split(), 1))


def base(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, tuple, tuple, tuple, tuple]:
    d = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    part = lambda a, n: tuple(F.col("e")[a + i] for i in range(n))
    return d, pose.unit(part(0, 4)), pose.unit(part(4, 4)), part(8, 3), part(11, 3)


@query(f"SELECT vec_id, {listed('x y z w', 'p')} FROM (SELECT vec_id, {PRODUCT.format(p='q', q='r')} AS p FROM {BASE})")
def quaternion_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, q, r, _, _ = base(spark, sf_dir)
    return d.select("vec_id", *rounded("x y z w", pose.multiply(q, r)))


@query(f"SELECT vec_id, {listed('x y z', 't')} FROM (SELECT vec_id, {TURNED.format(m='m', v='v')} AS t FROM (SELECT vec_id, v, {MATRIX.format(q='q')} AS m FROM {BASE}))")
def vector_rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, q, _, v, _ = base(spark, sf_dir)
    return d.select("vec_id", *rounded("x y z", pose.rotate(q, v)))


@query(
    f"""SELECT vec_id, {listed('x y z', 't')}, {listed('qx qy qz qw', 'p')} FROM (SELECT vec_id, list_transform(list_zip(v, {TURNED.format(m='m', v='w')}), lambda x: x[1] + x[2]) AS t, {PRODUCT.format(p='q', q='r')} AS p
    FROM (SELECT *, {MATRIX.format(q='q')} AS m FROM {BASE}))"""
)
def pose_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, q, r, v, w = base(spark, sf_dir)
    t, p = pose.compose((v, q), (w, r))
    return d.select("vec_id", *rounded("x y z", t), *rounded("qx qy qz qw", p))


@query(
    f"""SELECT vec_id, {listed('x y z', 't')}, {listed('qx qy qz qw', 'c')} FROM (SELECT vec_id, list_transform({TURNED.format(m='m', v='v')}, lambda x: -x) AS t, c
    FROM (SELECT vec_id, v, c, {MATRIX.format(q='c')} AS m FROM (SELECT vec_id, v, [-q[1], -q[2], -q[3], q[4]] AS c FROM {BASE})))"""
)
def pose_invert(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, q, _, v, _ = base(spark, sf_dir)
    t, c = pose.invert((v, q))
    return d.select("vec_id", *rounded("x y z", t), *rounded("qx qy qz qw", c))


@query(f"SELECT vec_id, round(m[1][1], 5) + 0.0 AS m11, round(m[1][2], 5) + 0.0 AS m12, round(m[2][1], 5) + 0.0 AS m21, round(m[2][3], 5) + 0.0 AS m23, round(m[3][1], 5) + 0.0 AS m31, round(m[3][3], 5) + 0.0 AS m33 FROM (SELECT vec_id, {MATRIX.format(q='q')} AS m FROM {BASE})")
def rotation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, q, _, _, _ = base(spark, sf_dir)
    m = pose.matrix(q)
    return d.select("vec_id", *rounded("m11 m12 m21 m23 m31 m33", (m[0][0], m[0][1], m[1][0], m[1][2], m[2][0], m[2][2])))


@query(f"SELECT vec_id, round(atan2(m[3][2], m[3][3]), 5) + 0.0 AS roll, round(asin(greatest(-1, least(1, -m[3][1]))), 5) + 0.0 AS pitch, round(atan2(m[2][1], m[1][1]), 5) + 0.0 AS heading FROM (SELECT vec_id, {MATRIX.format(q='q')} AS m FROM {BASE})")
def quaternion_rpy(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, q, _, _, _ = base(spark, sf_dir)
    return d.select("vec_id", *rounded("roll pitch heading", pose.to_rpy(q)))


@query(
    f"""SELECT vec_id, {listed('x y z w', 'q')} FROM (SELECT vec_id, [sr*cp*cy - cr*sp*sy, cr*sp*cy + sr*cp*sy, cr*cp*sy - sr*sp*cy, cr*cp*cy + sr*sp*sy] AS q FROM (SELECT vec_id, sin(v[1]/2) AS sr, cos(v[1]/2) AS cr, sin(v[2]/2) AS sp, cos(v[2]/2) AS cp, sin(v[3]/2) AS sy, cos(v[3]/2) AS cy FROM {BASE}))"""
)
def rpy_quaternion(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, _, _, v, _ = base(spark, sf_dir)
    return d.select("vec_id", *rounded("x y z w", pose.from_rpy(*v)))


SHARE = 0.3
NEAR = "SELECT vec_id, q, CASE WHEN list_dot_product(q, r) < 0 THEN list_transform(r, lambda x: -x) ELSE r END AS n, abs(list_dot_product(q, r)) AS c FROM " + BASE
STRAIGHT = f"list_transform(list_zip(q, n), lambda x: {1 - SHARE} * x[1] + {SHARE} * x[2])"


@query(
    f"""SELECT vec_id, {listed('x y z w', 's')} FROM (SELECT vec_id, CASE WHEN c > 0.9995 THEN {UNIT.format(q='l')} ELSE list_transform(list_zip(q, n), lambda x: sin({1 - SHARE} * acos(c)) / sin(acos(c)) * x[1] + sin({SHARE} * acos(c)) / sin(acos(c)) * x[2]) END AS s
    FROM (SELECT *, {STRAIGHT} AS l FROM ({NEAR})))"""
)
def quaternion_slerp(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, q, r, _, _ = base(spark, sf_dir)
    return d.select("vec_id", *rounded("x y z w", pose.slerp(q, r, F.lit(SHARE))))


@query(f"SELECT vec_id, {listed('x y z w', 's')} FROM (SELECT vec_id, {UNIT.format(q='l')} AS s FROM (SELECT vec_id, {STRAIGHT} AS l FROM ({NEAR})))")
def quaternion_nlerp(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, q, r, _, _ = base(spark, sf_dir)
    return d.select("vec_id", *rounded("x y z w", pose.nlerp(q, r, F.lit(SHARE))))


@query(
    f"""SELECT vec_id, round(v[1] + cos(v[3]) * w[1] - sin(v[3]) * w[2], 5) + 0.0 AS x, round(v[2] + sin(v[3]) * w[1] + cos(v[3]) * w[2], 5) + 0.0 AS y, round(atan2(sin(v[3] + w[3]), cos(v[3] + w[3])), 5) + 0.0 AS heading,
    round(-(cos(v[3]) * v[1] + sin(v[3]) * v[2]), 5) + 0.0 AS back_x, round(sin(v[3]) * v[1] - cos(v[3]) * v[2], 5) + 0.0 AS back_y FROM {BASE}"""
)
def planar_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, _, _, v, w = base(spark, sf_dir)
    return d.select("vec_id", *rounded("x y heading", pose.compose_planar(v, w)), *rounded("back_x back_y", pose.invert_planar(v)[:2]))


# a sample's pose: x from its value, the heading from its tag
SAMPLE = "value / 100 AS x, CAST(json_extract(props, '$.k') AS BIGINT) / 16.0 AS h"
POSES = f"(SELECT event_id, event_type AS stream, user_id, epoch_us(ts) AS ts_us, value::DOUBLE / 100 AS x, CAST(json_extract(props, '$.k') AS BIGINT)::DOUBLE / 16 AS h FROM events)"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("event_type").alias("stream"), "user_id", micros("ts").alias("ts_us"), (F.col("value") / 100).alias("x"), (F.get_json_object("props", "$.k").cast("double") / 16).alias("h"))


def sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks with the views of their user before and after, as structs (ts, x, h)."""
    s = samples(spark, sf_dir)
    return asof.around(s.filter("stream = 'click'").select("user_id", "ts_us", "event_id"), s.filter("stream = 'view'").select("user_id", "ts_us", "x", "h"), "user_id", "ts_us", ["x", "h"])


PROBED = f"""p AS (SELECT * FROM {POSES} WHERE stream = 'click'), s AS (SELECT * FROM {POSES} WHERE stream = 'view'),
b AS (SELECT p.event_id, p.user_id, p.ts_us, s.ts_us AS bt, s.x AS bx, s.h AS bh FROM p ASOF LEFT JOIN s ON p.user_id = s.user_id AND p.ts_us >= s.ts_us),
n AS (SELECT b.*, s.ts_us AS nt, s.x AS ax, s.h AS ah FROM b ASOF LEFT JOIN s ON b.user_id = s.user_id AND b.ts_us <= s.ts_us),
f AS (SELECT *, CASE WHEN bt IS NULL OR nt IS NULL OR bt = nt THEN 0.0 ELSE (ts_us - bt)::DOUBLE / (nt - bt) END AS t, coalesce(bx, ax) AS x0, coalesce(bh, ah) AS h0, CASE WHEN bt IS NULL OR nt IS NULL THEN coalesce(bx, ax) ELSE ax END AS x1, CASE WHEN bt IS NULL OR nt IS NULL THEN coalesce(bh, ah) ELSE ah END AS h1 FROM n)"""
# about one axis the arc is a turn by a share of the difference, the shorter way round
TURN = "atan2(sin(h1 - h0), cos(h1 - h0))"


def interpolated(d: DataFrame) -> tuple[DataFrame, Column]:
    """d with the neighbours as structs b and a and the share s of the way between them, and x there; the nearest end's beyond the span."""
    b, a = F.coalesce("before", "after"), F.coalesce("after", "before")
    d = d.withColumns({"b": b, "a": a})
    share = F.when(F.col("before").isNull() | F.col("after").isNull() | (F.col("a.ts") == F.col("b.ts")), F.lit(0.0)).otherwise((F.col("ts_us") - F.col("b.ts")) / (F.col("a.ts") - F.col("b.ts")))
    return d.withColumn("s", share), F.col("b.x") + F.col("s") * (F.col("a.x") - F.col("b.x"))


@query(f"WITH {PROBED} SELECT event_id, round(x0 + t * (x1 - x0), 5) + 0.0 AS x, round(abs(sin((h0 + t * {TURN}) / 2)), 4) + 0.0 AS qz, round(abs(cos((h0 + t * {TURN}) / 2)), 4) + 0.0 AS qw FROM f")
def asof_pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position linear, rotation along the arc; the quaternion's sign is free, so sizes are told."""
    d, x = interpolated(sides(spark, sf_dir))
    turn = lambda h: pose.from_rpy(F.lit(0.0), F.lit(0.0), F.col(h))
    d, q = pose.held_slerp(d, "turn", turn("b.h"), turn("a.h"), F.col("s"))
    return d.select("event_id", (F.round(x, 5) + 0.0).alias("x"), (F.round(F.abs(q[2]), 4) + 0.0).alias("qz"), (F.round(F.abs(q[3]), 4) + 0.0).alias("qw"))


GAP, TOLERANCE = 86_400_000_000, 7_200_000_000


@query(
    f"""WITH {PROBED} SELECT event_id, round(CASE WHEN nt - bt <= {GAP} THEN x0 + t * (x1 - x0) WHEN bt IS NOT NULL AND ts_us - bt <= {TOLERANCE} AND (nt IS NULL OR ts_us - bt <= nt - ts_us) THEN bx
    WHEN nt - ts_us <= {TOLERANCE} THEN ax END, 5) + 0.0 AS x FROM f"""
)
def asof_pose_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interpolated over gaps that are short enough; else the nearer sample within tolerance, else null."""
    d, x = interpolated(sides(spark, sf_dir))
    b, a = F.col("before"), F.col("after")
    to_b, to_a = F.col("ts_us") - b["ts"], a["ts"] - F.col("ts_us")
    near = F.when((to_b <= TOLERANCE) & (a.isNull() | (to_b <= to_a)), b["x"]).when(to_a <= TOLERANCE, a["x"])
    return d.select("event_id", (F.round(F.when(a["ts"] - b["ts"] <= GAP, x).otherwise(near), 5) + 0.0).alias("x"))


@query(f"WITH {PROBED} SELECT event_id, CASE WHEN coalesce(ts_us - bt, nt - ts_us) <= 3600000000 OR (bt IS NOT NULL AND nt IS NOT NULL) THEN round(x0 + t * (x1 - x0) - (SELECT avg(x) FROM s), 4) + 0.0 END AS x FROM f")
def truth_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth at a probe's time, relative to the mean of all; null farther than an hour beyond the samples' span."""
    d, x = interpolated(sides(spark, sf_dir))
    mean = samples(spark, sf_dir).filter("stream = 'view'").agg(F.avg("x").alias("mean"))
    beyond = F.coalesce(F.col("ts_us") - F.col("before.ts"), F.col("after.ts") - F.col("ts_us"))
    inside = F.col("before").isNotNull() & F.col("after").isNotNull()
    return d.join(F.broadcast(mean), how="cross").select("event_id", F.when(inside | (beyond <= 3_600_000_000), F.round(x - F.col("mean"), 4) + 0.0).alias("x"))


CHAIN = ("click", "view", "purchase")


@query(
    "WITH e AS (SELECT * FROM " + POSES + "), "
    + ", ".join(f"{s} AS (SELECT * FROM e WHERE stream = '{s}')" for s in CHAIN)
    + """, p AS (SELECT event_id, user_id, ts_us FROM e WHERE stream = 'error'),
    a AS (SELECT p.*, click.x AS x1, click.h AS h1 FROM p ASOF JOIN click ON p.user_id = click.user_id AND p.ts_us >= click.ts_us),
    b AS (SELECT a.*, view.x AS x2, view.h AS h2 FROM a ASOF JOIN view ON a.user_id = view.user_id AND a.ts_us >= view.ts_us),
    c AS (SELECT b.*, purchase.x AS x3, purchase.h AS h3 FROM b ASOF JOIN purchase ON b.user_id = purchase.user_id AND b.ts_us >= purchase.ts_us)
    SELECT event_id, round(x1 + cos(h1) * x2 + cos(h1 + h2) * x3, 4) + 0.0 AS x, round(sin(h1) * x2 + sin(h1 + h2) * x3, 4) + 0.0 AS y, round(cos(h1 + h2 + h3), 4) + 0.0 AS cos_heading FROM c"""
)
def chain_at_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transforms from a frame up to the root at each error's time: each edge's last sample, composed. Probes that lack an edge go."""
    s = samples(spark, sf_dir)
    at = s.filter("stream = 'error'").select("user_id", "ts_us", "event_id")
    for i, stream in enumerate(CHAIN):
        edge = s.filter(F.col("stream") == stream).select("user_id", "ts_us", "x", "h")
        at = asof.last_before(at, edge, "user_id", "ts_us", ["x", "h"], f"e{i}").filter(F.col(f"e{i}").isNotNull())
    place = lambda i: (F.col(f"e{i}.x"), F.lit(0.0), F.col(f"e{i}.h"))
    x, y, h = pose.compose_planar(place(0), pose.compose_planar(place(1), place(2)))
    return at.select("event_id", *[(F.round(c, 4) + 0.0).alias(n) for n, c in (("x", x), ("y", y), ("cos_heading", F.cos(h)))])


# a tree of eleven frames in each recording; a frame's samples change parent now and then
FRAMES = "(SELECT event_id, user_id % 20 AS rec, event_id % 11 + 1 AS child, CASE WHEN (h * 16)::BIGINT % 5 = 0 THEN (event_id % 11 + 1) // 3 ELSE (event_id % 11 + 1) // 2 END AS parent, ts_us, x, h, stream FROM " + POSES + ")"


def frame_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec, child, parent, ts, pose, event_id, stream): planar poses as full ones."""
    s = samples(spark, sf_dir)
    child = F.col("event_id") % 11 + 1
    parent = F.when((F.col("h") * 16) % 5 == 0, F.floor(child / 3)).otherwise(F.floor(child / 2))
    q = pose.from_rpy(F.lit(0.0), F.lit(0.0), F.col("h"))
    numbers = dict(zip(chains.POSE, (F.col("x"), F.lit(0.0), F.lit(0.0), *q), strict=True))
    return s.select("event_id", "stream", (F.col("user_id") % 20).alias("rec"), child.alias("child"), parent.alias("parent"), F.col("ts_us").alias("ts"), *[c.alias(n) for n, c in numbers.items()])


@query(
    f"""WITH RECURSIVE s AS MATERIALIZED (SELECT rec, child, ts_us, arg_min(parent, event_id) AS parent, arg_min(x, event_id) AS x, arg_min(h, event_id) AS h FROM {FRAMES} WHERE stream <> 'error' GROUP BY rec, child, ts_us),
    p AS (SELECT event_id, rec, ts_us, c.child FROM {FRAMES} f JOIN (SELECT DISTINCT rec AS r, child FROM s) c ON f.rec = c.r WHERE stream = 'error'),
    b AS (SELECT p.*, s.ts_us AS bt, s.parent AS bp, s.x AS bx, s.h AS bh FROM p ASOF LEFT JOIN s ON p.rec = s.rec AND p.child = s.child AND p.ts_us >= s.ts_us),
    n AS (SELECT b.*, s.ts_us AS nt, s.parent AS ap, s.x AS ax, s.h AS ah FROM b ASOF LEFT JOIN s ON b.rec = s.rec AND b.child = s.child AND b.ts_us <= s.ts_us),
    f AS (SELECT *, CASE WHEN bt IS NULL THEN 1.0 WHEN nt IS NULL THEN 0.0 WHEN bp = ap AND nt > bt THEN (ts_us - bt)::DOUBLE / (nt - bt) WHEN ts_us - bt <= nt - ts_us THEN 0.0 ELSE 1.0 END AS t FROM n),
    e AS MATERIALIZED (SELECT event_id, child, CASE WHEN bt IS NULL OR (t = 1 AND nt IS NOT NULL) THEN ap ELSE bp END AS parent, coalesce(bx, ax) + t * (coalesce(ax, bx) - coalesce(bx, ax)) AS x,
        CASE WHEN abs(c) > 0.9995 THEN 2 * atan2((1 - t) * sin(h0 / 2) + t * sign(c) * sin(h1 / 2), (1 - t) * cos(h0 / 2) + t * sign(c) * cos(h1 / 2)) ELSE h0 + t * {TURN} END AS h
        FROM (SELECT *, cos((h1 - h0) / 2) AS c FROM (SELECT *, coalesce(bh, ah) AS h0, coalesce(ah, bh) AS h1 FROM f))),
    walk AS (SELECT event_id, event_id % 11 + 1 AS frame, 0 AS depth, 0::DOUBLE AS x, 0::DOUBLE AS y, 0::DOUBLE AS h FROM events WHERE event_type = 'error'
        UNION ALL SELECT w.event_id, e.parent, depth + 1, e.x + cos(e.h) * w.x - sin(e.h) * w.y, sin(e.h) * w.x + cos(e.h) * w.y, e.h + w.h FROM walk w JOIN e ON w.event_id = e.event_id AND w.frame = e.child)
    SELECT event_id, arg_max(frame, depth) AS root, max(depth)::BIGINT AS depth, round(arg_max(x, depth), 4) + 0.0 AS x, round(arg_max(y, depth), 4) + 0.0 AS y, round(cos(arg_max(h, depth)), 4) + 0.0 AS cos_heading FROM walk GROUP BY event_id"""
)
def chain_to_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each error's frame in the root of its recording's tree as it stood then: edges interpolated between samples, parents may change."""
    s = frame_samples(spark, sf_dir)
    edges = s.filter("stream <> 'error'").groupBy("rec", "child", "ts").agg(F.min_by(F.struct("parent", *chains.POSE), "event_id").alias("e")).select("rec", "child", "ts", "e.*")
    probes = s.filter("stream = 'error'").select("rec", "event_id", F.col("child").alias("frame"), "ts")
    out = chains.chains_at(probes, edges, "rec", "event_id", "frame")
    heading = pose.heading(tuple(F.col(c) for c in chains.POSE[3:]))
    return out.select("event_id", "root", "depth", *rounded4("x y cos_heading", (F.col("x"), F.col("y"), F.cos(heading))))


def rounded4(names: str, columns: tuple[Column, ...]) -> list[Column]:
    return [(F.round(c, 4) + 0.0).alias(n) for n, c in zip(names.split(), columns, strict=True)]


#: Fixed edges: frame c hangs on c // 2 in every recording, at a place that depends on c alone; in recording r, frame r % 9 + 2 moves and frame 11 has two parents if r % 4 = 0.
MOUNT = """(SELECT user_id % 20 AS rec, event_id % 11 + 1 AS child, CASE WHEN event_id % 11 = 10 AND user_id % 20 % 4 = 0 AND event_id % 2 = 0 THEN 1 ELSE (event_id % 11 + 1) // 2 END AS parent, event_id,
    (event_id % 11 + 1)::DOUBLE / 2 + CASE WHEN event_id % 11 + 1 = user_id % 20 % 9 + 2 THEN event_id / 1000.0 ELSE 0 END AS x, (event_id % 11)::DOUBLE / 7 AS h FROM events)"""


@query(
    f"""WITH RECURSIVE s AS MATERIALIZED (SELECT rec, child, count(DISTINCT parent) AS n, min(parent) AS parent, max(x) - min(x) <= 1e-9 AS still, min(x) AS x, min(h) AS h FROM {MOUNT} GROUP BY rec, child),
    walk AS (SELECT DISTINCT rec, child AS start, child AS frame, 0 AS depth, 0::DOUBLE AS x, 0::DOUBLE AS y, 0::DOUBLE AS h FROM s
        UNION ALL SELECT w.rec, start, s.parent, depth + 1, s.x + cos(s.h) * w.x - sin(s.h) * w.y, sin(s.h) * w.x + cos(s.h) * w.y, s.h + w.h FROM walk w JOIN s ON w.rec = s.rec AND w.frame = s.child WHERE w.frame <> 1 AND s.n = 1 AND s.still),
    top AS (SELECT rec, start, arg_max(frame, depth) AS frame, max(depth) AS depth, arg_max(x, depth) AS x, arg_max(y, depth) AS y, arg_max(h, depth) AS h FROM walk GROUP BY rec, start),
    v AS (SELECT t.*, CASE WHEN t.frame = 1 THEN 'fixed' WHEN n > 1 THEN 'two parents' WHEN NOT still THEN 'moves' ELSE 'not under' END AS verdict FROM top t LEFT JOIN s ON t.rec = s.rec AND t.frame = s.child)
    SELECT rec, start, verdict, CASE WHEN verdict = 'fixed' THEN depth::BIGINT END AS depth, CASE WHEN verdict = 'fixed' THEN round(x, 4) + 0.0 END AS x, CASE WHEN verdict = 'fixed' THEN round(y, 4) + 0.0 END AS y,
    CASE WHEN verdict = 'fixed' THEN round(cos(h), 4) + 0.0 END AS cos_heading FROM v"""
)
def mount_to_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed pose of each frame in frame 1, or why there is none: an edge on the way moves, or a frame has two parents."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 20).alias("rec"), (F.col("event_id") % 11 + 1).alias("child"))
    twice = (F.col("child") == 11) & (F.col("rec") % 4 == 0) & (F.col("event_id") % 2 == 0)
    x = F.col("child") / 2 + F.when(F.col("child") == F.col("rec") % 9 + 2, F.col("event_id") / 1000).otherwise(0.0)
    q = pose.from_rpy(F.lit(0.0), F.lit(0.0), (F.col("child") - 1) / 7)
    numbers = dict(zip(chains.POSE, (x, F.lit(0.0), F.lit(0.0), *q), strict=True))
    edges = e.select("rec", "child", F.when(twice, F.lit(1)).otherwise(F.floor(F.col("child") / 2)).cast("long").alias("parent"), F.col("event_id").alias("ts"), *[c.alias(n) for n, c in numbers.items()])
    walks = edges.select("rec", F.col("child").alias("start"), F.lit(1).cast("long").alias("goal")).distinct()
    out = chains.mounts(edges, walks, "rec")
    heading = pose.heading(tuple(F.col(c) for c in chains.POSE[3:]))
    return out.select("rec", "start", "verdict", "depth", *rounded4("x y cos_heading", (F.col("x"), F.col("y"), F.cos(heading))))


@query(
    f"""WITH p AS (SELECT user_id, ts_us, event_id, x, h * 2 AS y, h AS heading FROM {POSES}), w AS (SELECT *, lead(x) OVER o - lag(x) OVER o AS dx, lead(y) OVER o - lag(y) OVER o AS dy, (lead(ts_us) OVER o - lag(ts_us) OVER o) / 1e10 AS dt FROM p WINDOW o AS (PARTITION BY user_id ORDER BY ts_us, event_id)),
    m AS (SELECT user_id, degrees(abs(atan2(sin(heading - atan2(dy, dx)), cos(heading - atan2(dy, dx))))) AS angle FROM w WHERE dx IS NOT NULL AND sqrt(dx * dx + dy * dy) / greatest(dt, 1e-6) > 0.2)
    SELECT user_id, CASE WHEN count(*) >= 5 THEN round(median(angle), 4) END AS angle, count(*) AS n FROM m GROUP BY user_id"""
)
def heading_vs_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a robot's heading is from the way it goes, while it goes."""
    s = samples(spark, sf_dir).select("user_id", "event_id", (F.col("ts_us") / 1e10).alias("t"), "x", (F.col("h") * 2).alias("y"), F.col("h").alias("heading"))
    return spatial.arrow_vs_travel(s, "user_id", "t", ["event_id"]).select("user_id", F.round("angle", 4).alias("angle"), "n")
