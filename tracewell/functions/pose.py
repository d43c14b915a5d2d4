"""Rigid transforms as Column expressions: vectors are tuples (x, y, z), quaternions (x, y, z, w), poses (vector, quaternion).

All functions are compositions of arithmetic on Columns, so they stay inside generated code and add no Python worker. An
expression names its inputs many times over: what one function gives is made a column with held() before the next takes it.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]
Quaternion = tuple[Column, Column, Column, Column]
Pose = tuple[Vector, Quaternion]
#: Cosine above which spherical interpolation divides by next to nothing, and a straight line serves.
STRAIGHT = 0.9995


def held(df: DataFrame, name: str, pose: Pose) -> tuple[DataFrame, Pose]:
    """df with the pose's seven numbers as columns, and the pose by those names."""
    names = [f"{name}_{c}" for c in ("x", "y", "z", "qx", "qy", "qz", "qw")]
    df = df.withColumns(dict(zip(names, [*pose[0], *pose[1]], strict=True)))
    return df, (tuple(map(F.col, names[:3])), tuple(map(F.col, names[3:])))


def dot(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        out = out + x * y
    return out


def cross(a: Vector, b: Vector) -> Vector:
    return tuple(a[(i + 1) % 3] * b[(i + 2) % 3] - a[(i + 2) % 3] * b[(i + 1) % 3] for i in range(3))


def times(s: Column, v: tuple[Column, ...]) -> tuple[Column, ...]:
    return tuple(s * x for x in v)


def plus(*vs: tuple[Column, ...]) -> tuple[Column, ...]:
    out = vs[0]
    for v in vs[1:]:
        out = tuple(x + y for x, y in zip(out, v, strict=True))
    return out


def unit(q: tuple[Column, ...]) -> tuple[Column, ...]:
    """q at length 1; null components where its length is 0."""
    n = F.sqrt(dot(q, q))
    return tuple(F.when(n > 0, x / n) for x in q)


def conjugate(q: Quaternion) -> Quaternion:
    return (-q[0], -q[1], -q[2], q[3])


def multiply(p: Quaternion, q: Quaternion) -> Quaternion:
    """First q, then p, as rotations: by scalar and vector part, (s, u)(t, v) = (st - u.v, sv + tu + u x v)."""
    u, s, v, t = p[:3], p[3], q[:3], q[3]
    return (*plus(times(s, v), times(t, u), cross(u, v)), s * t - dot(u, v))


def rotate(q: Quaternion, v: Vector) -> Vector:
    """v turned by the unit quaternion q: v + 2 s (u x v) + 2 u x (u x v)."""
    u, s = q[:3], q[3]
    once = cross(u, v)
    return plus(v, times(2 * s, once), times(F.lit(2.0), cross(u, once)))


def compose(a: Pose, b: Pose) -> Pose:
    """First b, then a; the rotation is normalised."""
    return plus(a[0], rotate(a[1], b[0])), unit(multiply(a[1], b[1]))


def invert(a: Pose) -> Pose:
    back = conjugate(a[1])
    return times(F.lit(-1.0), rotate(back, a[0])), back


def toward(q: Quaternion, r: Quaternion) -> Quaternion:
    """r or its negative, which is the same rotation, whichever is nearer to q."""
    sign = F.when(dot(q, r) < 0, -1.0).otherwise(1.0)
    return times(sign, r)


def nlerp(q: Quaternion, r: Quaternion, t: Column) -> Quaternion:
    """Straight from q to r by the share t, the shorter way, normalised."""
    return unit(plus(times(1 - t, q), times(t, toward(q, r))))


def slerp(q: Quaternion, r: Quaternion, t: Column) -> Quaternion:
    """Along the arc from q to r by the share t, the shorter way; straight where they are nearly equal."""
    near = toward(q, r)
    cosine = F.least(dot(q, near), F.lit(1.0))
    angle = F.acos(cosine)
    arc = plus(times(F.sin((1 - t) * angle) / F.sin(angle), q), times(F.sin(t * angle) / F.sin(angle), near))
    line = nlerp(q, r, t)
    return tuple(F.when(cosine > STRAIGHT, x).otherwise(y) for x, y in zip(line, arc, strict=True))


def held_slerp(df: DataFrame, name: str, q: Quaternion, r: Quaternion, t: Column) -> tuple[DataFrame, Quaternion]:
    """The same with what it takes again and again kept as columns, so that a plan holds each once."""
    df = df.withColumns({f"{name}_{x}{i}": c for x, v in (("q", q), ("r", r)) for i, c in enumerate(v)} | {f"{name}_t": t})
    q, r, t = (*(tuple(F.col(f"{name}_{x}{i}") for i in range(4)) for x in "qr"), F.col(f"{name}_t"))
    df = df.withColumn(f"{name}_c", dot(q, r))
    c = F.col(f"{name}_c")
    df = df.withColumns({f"{name}_sign": F.when(c < 0, -1.0).otherwise(1.0), f"{name}_a": F.acos(F.least(F.abs(c), F.lit(1.0)))})
    a, sign, straight = F.col(f"{name}_a"), F.col(f"{name}_sign"), F.abs(c) > STRAIGHT
    df = df.withColumns({f"{name}_u": F.when(straight, 1 - t).otherwise(F.sin((1 - t) * a) / F.sin(a)), f"{name}_v": sign * F.when(straight, t).otherwise(F.sin(t * a) / F.sin(a))})
    df = df.withColumns(dict(zip(names := [f"{name}_m{i}" for i in range(4)], plus(times(F.col(f"{name}_u"), q), times(F.col(f"{name}_v"), r)), strict=True)))
    mixed = tuple(map(F.col, names))
    df = df.withColumn(f"{name}_n", F.when(straight, F.sqrt(dot(mixed, mixed))).otherwise(F.lit(1.0)))
    return df, tuple(x / F.col(f"{name}_n") for x in mixed)


def from_rpy(roll: Column, pitch: Column, heading: Column) -> Quaternion:
    """Turned about x, then y, then z."""
    half = lambda a, axis: tuple(F.sin(a / 2) if i == axis else F.cos(a / 2) if i == 3 else F.lit(0.0) for i in range(4))
    return multiply(half(heading, 2), multiply(half(pitch, 1), half(roll, 0)))


def to_rpy(q: Quaternion) -> Vector:
    """Roll, pitch and heading; the sine of the pitch is held within -1 and 1."""
    m = matrix(q)
    return F.atan2(m[2][1], m[2][2]), F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -m[2][0]))), heading(q)


def heading(q: Quaternion) -> Column:
    m = matrix(q)
    return F.atan2(m[1][0], m[0][0])


def matrix(q: Quaternion) -> list[Vector]:
    """Rows of the rotation matrix of a unit quaternion: its columns are the turned axes."""
    axes = [rotate(q, tuple(F.lit(1.0 if i == j else 0.0) for j in range(3))) for i in range(3)]
    return [tuple(axes[j][i] for j in range(3)) for i in range(3)]


def compose_planar(a: Vector, b: Vector) -> Vector:
    """First b, then a, of planar poses (x, y, heading); the heading is brought into -pi .. pi."""
    c, s = F.cos(a[2]), F.sin(a[2])
    turn = a[2] + b[2]
    return a[0] + c * b[0] - s * b[1], a[1] + s * b[0] + c * b[1], F.atan2(F.sin(turn), F.cos(turn))


def invert_planar(a: Vector) -> Vector:
    c, s = F.cos(a[2]), F.sin(a[2])
    return -(c * a[0] + s * a[1]), s * a[0] - c * a[1], -a[2]
