"""Points are the first three elements of embeddings; labels are scans."""

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import pose
from ..operators import spatial
from .registry import query, table

P = "(SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"
VOXELS = f"(SELECT floor(x / 0.08)::BIGINT AS ix, floor(y / 0.08)::BIGINT AS iy, floor(z / 0.08)::BIGINT AS iz, count(*) AS hits FROM {P} GROUP BY 1, 2, 3)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda i: F.col("embedding")[i].cast("double")
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))


@query(f"SELECT * FROM {VOXELS}")
def voxel_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.voxels(points(spark, sf_dir), 0.08)


@query(f"SELECT ix, iy, count(*) AS height FROM {VOXELS} WHERE hits >= 2 GROUP BY 1, 2")
def voxel_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.columns(spatial.voxels(points(spark, sf_dir), 0.08), 2)


@query(f"SELECT floor((x + 1) * 64)::BIGINT AS px, floor((y + 1) * 64)::BIGINT AS py, count(*) AS n FROM {P} WHERE z BETWEEN -0.2 AND 0.2 GROUP BY 1, 2")
def density_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = points(spark, sf_dir).filter(F.col("z").between(-0.2, 0.2))
    return band.groupBy(F.floor((F.col("x") + 1) * 64).alias("px"), F.floor((F.col("y") + 1) * 64).alias("py")).agg(F.count("*").alias("n"))


@query(
    f"""WITH b AS (SELECT floor(z / 0.05)::BIGINT AS bin, count(*) AS n FROM {P} GROUP BY 1), c AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS cum, sum(n) OVER () AS total FROM b)
    SELECT s.share::DOUBLE AS share, min(bin) AS bin FROM c, (VALUES (0.05), (0.5), (0.98)) s(share) WHERE cum >= s.share::DOUBLE * total GROUP BY 1"""
)
def z_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.histogram_percentiles(points(spark, sf_dir), "z", 0.05, [0.05, 0.5, 0.98])


@query(f"WITH p AS {P}, b AS (SELECT min(x) - 0.02 AS x0, max(x) + 0.02 AS x1, min(y) - 0.02 AS y0, max(y) + 0.02 AS y1 FROM p WHERE label = 0) SELECT p.vec_id FROM p, b WHERE p.x BETWEEN x0 AND x1 AND p.y BETWEEN y0 AND y1")
def extent_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    box = p.filter("label = 0").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    inside = F.col("x").between(F.col("x0") - 0.02, F.col("x1") + 0.02) & F.col("y").between(F.col("y0") - 0.02, F.col("y1") + 0.02)
    return p.join(F.broadcast(box), how="cross").filter(inside).select("vec_id")  # the box is one row


ANGLES = f"WITH a AS (SELECT a.d AS deg, round(x * cos(radians(a.d)) + y * sin(radians(a.d)), 9) AS u, round(y * cos(radians(a.d)) - x * sin(radians(a.d)), 9) AS v FROM {P}, (SELECT unnest(range(0, 90, 5)) AS d) a)"


@query(
    f"""{ANGLES}, s AS (SELECT deg, sum(n * n) AS s FROM (SELECT deg, count(*) AS n FROM a GROUP BY deg, floor(u / 0.08) UNION ALL SELECT deg, count(*) FROM a GROUP BY deg, floor(v / 0.08)) GROUP BY deg)
    SELECT deg, s::BIGINT AS score FROM s"""
)
def wall_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per angle, the sum of squared row and column counts; a wall stands where it is greatest."""
    turned = []
    for d in range(0, 90, 5):
        r = math.radians(d)
        u, v = F.col("x") * math.cos(r) + F.col("y") * math.sin(r), F.col("y") * math.cos(r) - F.col("x") * math.sin(r)
        turned.append(F.struct(F.lit(d).cast("long").alias("deg"), F.round(u, 9).alias("u"), F.round(v, 9).alias("v")))
    p = points(spark, sf_dir).select(F.explode(F.array(*turned)).alias("a")).select("a.*")
    both = p.select("deg", F.explode(F.array(F.struct(F.lit("u").alias("side"), F.floor(F.col("u") / 0.08).alias("i")), F.struct(F.lit("v").alias("side"), F.floor(F.col("v") / 0.08).alias("i")))).alias("c"))
    counts = both.groupBy("deg", "c.side", "c.i").agg(F.count("*").alias("n"))
    return counts.groupBy("deg").agg(F.sum(F.col("n") * F.col("n")).alias("score"))


PAIRS = f"(SELECT a.vec_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y FROM {P} a JOIN {P} b ON b.vec_id = a.vec_id + 1)"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    nxt = p.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return p.select("vec_id", F.col("x").alias("ax"), F.col("y").alias("ay")).join(nxt, "vec_id")


@query(f"SELECT round(covar_pop(ax, bx), 8) + 0.0 AS xx, round(covar_pop(ax, b_y), 8) + 0.0 AS xy, round(covar_pop(ay, bx), 8) + 0.0 AS yx, round(covar_pop(ay, b_y), 8) + 0.0 AS yy FROM {PAIRS}")
def align_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).agg(*[(F.round(F.covar_pop(f"a{p}", f"b{q}"), 8) + 0.0).alias(p + q) for p in "xy" for q in "xy"])


@query(f"SELECT round(sqrt(avg((ax - bx) * (ax - bx) + (ay - b_y) * (ay - b_y))), 8) AS rmse FROM {PAIRS}")
def fit_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    return pairs(spark, sf_dir).agg(F.round(F.sqrt(F.avg(dx * dx + dy * dy)), 8).alias("rmse"))


@query(f"SELECT label, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY label, floor(x / 0.25), floor(y / 0.25) ORDER BY vec_id) AS i FROM {P}) WHERE i = 1")
def point_thinning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).groupBy("label", F.floor(F.col("x") / 0.25), F.floor(F.col("y") / 0.25)).agg(F.min("vec_id").alias("vec_id")).select("label", "vec_id")


@query(f"SELECT label, arg_max(axis, (spread, axis)) AS axis FROM (SELECT label, 'x' AS axis, max(x) - min(x) AS spread FROM {P} GROUP BY 1 UNION ALL SELECT label, 'y', max(y) - min(y) FROM {P} GROUP BY 1) GROUP BY label")
def widest_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = points(spark, sf_dir).groupBy("label").agg((F.max("x") - F.min("x")).alias("sx"), (F.max("y") - F.min("y")).alias("sy"))
    return g.select("label", F.when(F.col("sy") >= F.col("sx"), "y").otherwise("x").alias("axis"))


@query(f"SELECT vec_id, round(y * -1, 9) + 0.0 AS x, round(x, 9) + 0.0 AS y, round(z, 9) + 0.0 AS z FROM {P}")
def rotate_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turned by a quarter about z."""
    h = F.lit(math.sqrt(0.5))
    x, y, z = pose.rotate((F.lit(0.0), F.lit(0.0), h, h), (F.col("x"), F.col("y"), F.col("z")))
    return points(spark, sf_dir).select("vec_id", *[(F.round(c, 9) + 0.0).alias(n) for c, n in ((x, "x"), (y, "y"), (z, "z"))])


@query(f"SELECT vec_id, x - lag(x) OVER (PARTITION BY label ORDER BY vec_id) AS dx FROM {P}")
def travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("vec_id", (F.col("x") - F.lag("x").over(Window.partitionBy("label").orderBy("vec_id"))).alias("dx"))


# points that were turned by 40 degrees about an oblique axis, moved, and shaken a little
HALF_TURN = math.radians(20)
AXIS = (2 / 3, -1 / 3, 2 / 3)
SHAKEN = f"""(SELECT label, x AS sx, y AS sy, z AS sz, 1.5 + (1 - 2 * (q[2]*q[2] + q[3]*q[3])) * x + 2 * (q[1]*q[2] - q[3]*q[4]) * y + 2 * (q[1]*q[3] + q[2]*q[4]) * z + k[1] / 20 AS tx,
    -0.5 + 2 * (q[1]*q[2] + q[3]*q[4]) * x + (1 - 2 * (q[1]*q[1] + q[3]*q[3])) * y + 2 * (q[2]*q[3] - q[1]*q[4]) * z + k[2] / 20 AS ty,
    0.25 + 2 * (q[1]*q[3] - q[2]*q[4]) * x + 2 * (q[2]*q[3] + q[1]*q[4]) * y + (1 - 2 * (q[1]*q[1] + q[2]*q[2])) * z + k[3] / 20 AS tz
    FROM (SELECT *, [{", ".join(repr(a * math.sin(HALF_TURN)) for a in AXIS)}, {math.cos(HALF_TURN)!r}]::DOUBLE[] AS q FROM (SELECT label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, CAST(embedding[4:6] AS DOUBLE[]) AS k FROM embeddings)))"""
COVARIANCES = ", ".join(f"covar_pop(s{a}, t{b}) AS {a}{b}" for a in "xyz" for b in "xyz")


@query(
    f"""WITH RECURSIVE p AS MATERIALIZED {SHAKEN}, c AS (SELECT label, count(*) AS n, avg(sx) AS mx, avg(sy) AS my, avg(sz) AS mz, avg(tx) AS ux, avg(ty) AS uy, avg(tz) AS uz, {COVARIANCES} FROM p GROUP BY label),
    m AS MATERIALIZED (SELECT *, [[xx + yy + zz, yz - zy, zx - xz, xy - yx], [yz - zy, xx - yy - zz, xy + yx, zx + xz], [zx - xz, xy + yx, yy - xx - zz, yz + zy], [xy - yx, zx + xz, yz + zy, zz - xx - yy]] AS a FROM c),
    v AS (SELECT label, 0 AS i, [1, 0, 0, 0]::DOUBLE[] AS q FROM m UNION ALL
        SELECT label, i + 1, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) FROM (SELECT v.label, i, list_transform([1, 2, 3, 4], lambda r: list_dot_product(a[r]::DOUBLE[], q) + 3 * q[r]) AS w FROM v JOIN m USING (label) WHERE i < 2000)),
    e AS (SELECT label, [q[2], q[3], q[4], q[1]] AS q FROM (SELECT label, CASE WHEN q[1] < 0 THEN list_transform(q, lambda x: -x) ELSE q END AS q FROM v WHERE i = 2000)),
    r AS (SELECT m.label, n, q, [[1 - 2*(q[2]*q[2] + q[3]*q[3]), 2*(q[1]*q[2] - q[3]*q[4]), 2*(q[1]*q[3] + q[2]*q[4])], [2*(q[1]*q[2] + q[3]*q[4]), 1 - 2*(q[1]*q[1] + q[3]*q[3]), 2*(q[2]*q[3] - q[1]*q[4])], [2*(q[1]*q[3] - q[2]*q[4]), 2*(q[2]*q[3] + q[1]*q[4]), 1 - 2*(q[1]*q[1] + q[2]*q[2])]] AS o,
        [mx, my, mz] AS s, [ux, uy, uz] AS t FROM m JOIN e USING (label)),
    x AS (SELECT label, n, q, o, [t[i] - list_dot_product(o[i]::DOUBLE[], s) FOR i IN [1, 2, 3]] AS t FROM r),
    d AS (SELECT label, sqrt(avg(list_sum([pow(o[i][1] * sx + o[i][2] * sy + o[i][3] * sz + t[i] - [tx, ty, tz][i], 2) FOR i IN [1, 2, 3]]))) AS rmse FROM p JOIN x USING (label) GROUP BY label)
    SELECT label, n, round(t[1], 5) + 0.0 AS x, round(t[2], 5) + 0.0 AS y, round(t[3], 5) + 0.0 AS z, round(q[1], 5) + 0.0 AS qx, round(q[2], 5) + 0.0 AS qy, round(q[3], 5) + 0.0 AS qz, round(q[4], 5) + 0.0 AS qw, round(rmse, 5) AS rmse FROM x JOIN d USING (label)"""
)
def align_rigid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per scan the rigid transform that carries its points onto the same ones turned, moved and shaken; with the error left."""
    e = lambda i: F.col("embedding")[i].cast("double")
    q = (*(F.lit(a * math.sin(HALF_TURN)) for a in AXIS), F.lit(math.cos(HALF_TURN)))
    turned = pose.rotate(q, (e(0), e(1), e(2)))
    t = [F.lit(m) + x + e(3 + i) / 20 for i, (m, x) in enumerate(zip((1.5, -0.5, 0.25), turned, strict=True))]
    pairs = table(spark, sf_dir, "embeddings").select("label", *[e(i).alias(f"s{c}") for i, c in enumerate("xyz")], *[x.alias(f"t{c}") for x, c in zip(t, "xyz", strict=True)])
    out = spatial.aligned(pairs, ["label"], ("sx", "sy", "sz"), ("tx", "ty", "tz"))
    return out.select("label", "n", *[(F.round(c, 5) + 0.0).alias(c) for c in ("x", "y", "z", "qx", "qy", "qz", "qw")], F.round("rmse", 5).alias("rmse"))


# walls along two directions, 23.4 degrees off the axes: a point is as far along as its first element tells, on one of seven lines
WALL = math.radians(23.4)
WALLS = f"""(SELECT (floor((m * {math.cos(WALL)!r} - k * {math.sin(WALL)!r}) / 0.02) + 0.5) * 0.02 AS x, (floor((m * {math.sin(WALL)!r} + k * {math.cos(WALL)!r}) / 0.02) + 0.5) * 0.02 AS y
    FROM (SELECT CASE WHEN vec_id % 2 = 0 THEN x * 20 ELSE vec_id % 7 END AS m, CASE WHEN vec_id % 2 = 0 THEN vec_id % 7 ELSE x * 20 END AS k FROM {P}))"""


def scores(degrees: str) -> str:
    return f"""(SELECT degrees, sum(n * n)::BIGINT AS score FROM (SELECT degrees, count(*) AS n FROM (SELECT d AS degrees, x * cos(radians(-d)) - y * sin(radians(-d)) AS u FROM w, {degrees}) GROUP BY degrees, floor(u / 0.1 + 0.5)
        UNION ALL SELECT degrees, count(*) FROM (SELECT d AS degrees, x * sin(radians(-d)) + y * cos(radians(-d)) AS v FROM w, {degrees}) GROUP BY degrees, floor(v / 0.1 + 0.5)) GROUP BY degrees)"""


@query(
    f"""WITH w AS MATERIALIZED {WALLS}, c AS MATERIALIZED (SELECT degrees, score, false AS fine FROM {scores("(SELECT unnest(range(90))::DOUBLE AS d)")} ORDER BY score DESC, degrees LIMIT 1),
    f AS (SELECT degrees, score, true AS fine FROM {scores("(SELECT degrees - 1 + unnest(range(21)) / 10 AS d FROM c)")})
    SELECT round(degrees, 4) AS degrees, score FROM (SELECT * FROM c UNION ALL SELECT * FROM f) ORDER BY score DESC, fine, degrees LIMIT 1"""
)
def wall_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turn that brings the walls in line with the axes, to a tenth of a degree."""
    along = F.col("x") * 20
    p = points(spark, sf_dir).select(F.when(F.col("vec_id") % 2 == 0, along).otherwise(F.col("vec_id") % 7).alias("m"), F.when(F.col("vec_id") % 2 == 0, F.col("vec_id") % 7).otherwise(along).alias("k"))
    p = p.select((F.col("m") * math.cos(WALL) - F.col("k") * math.sin(WALL)).alias("x"), (F.col("m") * math.sin(WALL) + F.col("k") * math.cos(WALL)).alias("y"))
    return spatial.wall_turn(p, cell=0.02).select(F.round("degrees", 4).alias("degrees"), "score")
