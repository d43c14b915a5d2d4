"""Voxel and density aggregation of points (x, y, z), alignment sums and trajectories."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pose
from .ranges import linear_percentile, placed
from .settle import settled


def voxels(points: DataFrame, size: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Points per voxel: floor of each coordinate over size, as three whole numbers."""
    cells = [F.floor(F.col(c) / F.lit(size)).alias(f"i{c}") for c in ("x", "y", "z")]
    return points.groupBy(*keys, *cells).agg(F.count("*").alias("hits"))


def columns(voxel: DataFrame, least: int = 1) -> DataFrame:
    """Occupied voxels per (ix, iy), of those hit at least least times."""
    return voxel.filter(F.col("hits") >= least).groupBy("ix", "iy").agg(F.count("*").alias("height"))


def histogram_percentiles(points: DataFrame, value: str, bin_size: float, shares: list[float]) -> DataFrame:
    """Per share: the first bin at which the cumulative count reaches that share of all. Windows run over bins only."""
    bins = points.groupBy(F.floor(F.col(value) / F.lit(bin_size)).alias("bin")).agg(F.count("*").alias("n"))
    running = bins.withColumn("cum", F.sum("n").over(Window.orderBy("bin"))).withColumn("all", F.sum("n").over(Window.partitionBy(F.lit(0))))
    picked = running.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    return picked.filter(F.col("cum") >= F.col("share") * F.col("all")).groupBy("share").agg(F.min("bin").alias("bin"))


#: Squarings of the 4 x 4 matrix: as many multiplications as 2 ** SQUARINGS steps of a power iteration.
SQUARINGS = 30


def dominant(matrix: Column) -> Column:
    """The unit vector (4 doubles) of the largest eigenvalue of a symmetric 4 x 4 matrix, row after row in an array; its largest component is positive.

    The matrix is shifted, so that this eigenvalue is the largest in size too, and squared again and again; its columns all turn to the vector.
    """
    most = F.array_max(F.transform(matrix, F.abs))
    shifted = F.transform(matrix, lambda x, i: x + F.when(i % 5 == 0, 3 * F.greatest(most, F.lit(1.0))).otherwise(0.0))

    def squared(m: Column, _: Column) -> Column:
        cell = lambda i, k: F.element_at(m, (F.floor(i / 4) * 4 + k + 1).cast("int")) * F.element_at(m, (4 * k + i % 4 + 1).cast("int"))
        product = F.transform(m, lambda _, i: cell(i, 0) + cell(i, 1) + cell(i, 2) + cell(i, 3))
        return F.transform(F.array(product), lambda p: F.transform(p, lambda x: x / F.array_max(F.transform(p, F.abs))))[0]

    power = F.aggregate(F.sequence(F.lit(1), F.lit(SQUARINGS)), shifted, squared)
    # the column of the largest diagonal element is farthest from vanishing
    diagonal = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(F.element_at(power, 5 * i + 1).alias("d"), (-i).alias("i")))
    column = -F.array_max(diagonal)["i"]
    vector = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.element_at(power, 4 * i + column + 1))
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(vector, lambda x: x / length)


def aligned(pairs: DataFrame, by: list[str], source: tuple[str, str, str], target: tuple[str, str, str]) -> DataFrame:
    """Per group the rigid transform that carries source points onto their targets with the least squares: (by, n, x, y, z, qx, qy, qz, qw, rmse).

    One aggregate holds all that is needed: sums of the coordinates and their products. The rotation is the dominant eigenvector of a
    matrix of covariances, its qw at least 0. Pairs with a null coordinate take no part; a group without pairs has no row; points on one line or in one place
    leave turns about it open, and one of them is given.
    """
    p = pairs.dropna(subset=[*source, *target])
    products = [F.covar_pop(s, t).alias(f"c{i}{j}") for i, s in enumerate(source) for j, t in enumerate(target)]
    spread = sum((F.var_pop(c) for c in (*source, *target)), F.lit(0.0)).alias("spread")
    sums = p.groupBy(*by).agg(F.count("*").alias("n"), *products, *[F.avg(s).alias(f"s{i}") for i, s in enumerate(source)], *[F.avg(t).alias(f"t{i}") for i, t in enumerate(target)], spread)
    c = lambda i, j: F.col(f"c{i}{j}")
    cross = [c(1, 2) - c(2, 1), c(2, 0) - c(0, 2), c(0, 1) - c(1, 0)]
    rows = [
        [c(0, 0) + c(1, 1) + c(2, 2), *cross],
        [cross[0], c(0, 0) - c(1, 1) - c(2, 2), c(0, 1) + c(1, 0), c(2, 0) + c(0, 2)],
        [cross[1], c(0, 1) + c(1, 0), c(1, 1) - c(0, 0) - c(2, 2), c(1, 2) + c(2, 1)],
        [cross[2], c(2, 0) + c(0, 2), c(1, 2) + c(2, 1), c(2, 2) - c(0, 0) - c(1, 1)],
    ]
    out = sums.withColumn("q", dominant(F.array(*[x for row in rows for x in row])))
    sign = F.when(F.col("q")[0] < 0, -1.0).otherwise(1.0)
    out = out.withColumns({n: sign * F.col("q")[i] for i, n in enumerate(("qw", "qx", "qy", "qz"))})
    q = tuple(F.col(n) for n in ("qx", "qy", "qz", "qw"))
    turned = pose.rotate(q, tuple(F.col(f"s{i}") for i in range(3)))
    out = out.withColumns({n: F.col(f"t{i}") - turned[i] for i, n in enumerate("xyz")})
    # what is left over: the spreads of both sides less twice the covariance that the rotation brings in line
    m = pose.matrix(q)
    fit = sum((m[j][i] * c(i, j) for i in range(3) for j in range(3)), F.lit(0.0))
    return out.withColumn("rmse", F.sqrt(F.greatest(F.col("spread") - 2 * fit, F.lit(0.0)))).select(*by, "n", *"xyz", "qx", "qy", "qz", "qw", "rmse")


def peakiness(cells: DataFrame, bin_size: float) -> DataFrame:
    """Per angle (degrees) the sum of squared row and column counts of cells (x, y, n, degrees) turned back by it."""
    a = F.radians(-F.col("degrees"))
    turned = {"u": F.col("x") * F.cos(a) - F.col("y") * F.sin(a), "v": F.col("x") * F.sin(a) + F.col("y") * F.cos(a)}
    lines = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.floor(c / bin_size + 0.5).alias("i")) for s, c in turned.items()]))
    counts = cells.select("degrees", "n", lines.alias("l")).groupBy("degrees", "l.side", "l.i").agg(F.sum("n").alias("n"))
    return counts.groupBy("degrees").agg(F.sum(F.col("n") * F.col("n")).alias("score"))


def wall_turn(points: DataFrame, bin_size: float = 0.1, cell: float | None = None) -> DataFrame:
    """One row (degrees, score): the turn within a quarter circle at which points (x, y) pile up most in rows and columns.

    Whole degrees first, then tenths around the best; of equal scores the first. Points are folded to cells of that size first (to equal
    points, if None), so what is turned 111 times grows with the place, not with the points. No row where there are no points.
    """
    at = [F.col(c) if cell is None else (F.floor(F.col(c) / cell) + 0.5) * cell for c in "xy"]
    cells = settled(points.dropna(subset=["x", "y"]).groupBy(at[0].alias("x"), at[1].alias("y")).agg(F.count("*").alias("n")))
    best = lambda scores: scores.orderBy(F.desc("score"), "fine", "degrees").limit(1)
    coarse = best(peakiness(cells.withColumn("degrees", F.explode(F.sequence(F.lit(0), F.lit(89)).cast("array<double>"))), bin_size).withColumn("fine", F.lit(False)))
    coarse = settled(coarse)
    tenths = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.col("best") - 1 + i / 10)
    near = cells.join(F.broadcast(coarse.select(F.col("degrees").alias("best"))), how="cross").withColumn("degrees", F.explode(tenths))  # one row
    return best(coarse.unionByName(peakiness(near, bin_size).withColumn("fine", F.lit(True)))).select("degrees", "score")


def arrow_vs_travel(rows: DataFrame, stream: str, ts: str, ties: list[str], least: int = 5, speed: float = 0.2) -> DataFrame:
    """Per stream of samples (x, y, heading; ts in seconds) the median angle in degrees between heading and travel, over samples that move faster than speed; null with fewer than least, and how many there are.

    Travel at a sample is from the one before to the one after it, so a stream's first and last have none.
    """
    at = placed(rows, [stream], [ts, *ties], before={"__bt": ts, "__bx": "x", "__by": "y"}, after={"__at": ts, "__ax": "x", "__ay": "y"})
    dx, dy = F.col("__ax") - F.col("__bx"), F.col("__ay") - F.col("__by")
    moving = at.filter(F.sqrt(dx * dx + dy * dy) / F.greatest(F.col("__at") - F.col("__bt"), F.lit(1e-6)) > speed)
    off = F.col("heading") - F.atan2(dy, dx)
    turned = settled(moving.select(stream, F.degrees(F.abs(F.atan2(F.sin(off), F.cos(off)))).alias("angle")))
    n = turned.groupBy(stream).agg(F.count("*").alias("n"))
    return n.join(linear_percentile(turned, [stream], "angle", 0.5, "angle"), stream).select(stream, F.when(F.col("n") >= least, F.col("angle")).alias("angle"), "n")
