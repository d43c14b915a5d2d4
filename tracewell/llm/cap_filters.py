"""Near-duplicate vectors by spherical-cap filters.

A filter is a direction, made of one random unit codeword for each half of the (randomly rotated) space: a random
product code of M * M directions that is never written down. A vector passes the filters whose direction it is near to
(inner product over a threshold); they are list-decoded from the two halves' sorted scores. Vectors close to each other
pass common filters, so pairs are sought only among vectors that share one, and verified exactly. Equal vectors are
folded into one first, with their count. A pair is counted where its least common filter is, so nothing is emitted per
pair: a bucket gives each vector's number of links and a spanning forest. Buckets over BUCKET vectors are cut into
blocks and met block by block.
"""

from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .components import components
from .tables import settled

#: Filters that a vector is meant to pass, and passes at least.
PASSED, LEAST = 28, 12
BUCKET = 1024
SEED = 20240917
FOUND = "rep long, links long, other long"
FOUND_SCHEMA = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])


@lru_cache(maxsize=4)
def code(dim: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random rotation and the codewords of either half."""
    rng = np.random.default_rng([SEED, dim, m])
    q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
    halves = [rng.standard_normal((m, n)) for n in (dim - dim // 2, dim // 2)]
    return (q * np.sign(np.diag(r)), *(h / np.maximum(np.linalg.norm(h, axis=1, keepdims=True), 1e-300) for h in halves))


def passed(units: np.ndarray, m: int) -> list[np.ndarray]:
    """The filters each unit vector passes, ascending."""
    dim = units.shape[1]
    rotation, left, right = code(dim, m)
    x = units @ rotation
    a, b = x[:, : left.shape[1]] @ left.T, x[:, left.shape[1] :] @ right.T
    # the sum of the halves' scores is near to normal with this deviation
    limit = NormalDist(0, (2 / dim) ** 0.5).inv_cdf(1 - PASSED / (m * m))
    oa, ob = np.argsort(-a, axis=1), np.argsort(-b, axis=1)
    out = []
    for r in range(len(units)):
        sa, sb = a[r, oa[r]], b[r, ob[r]]
        cut = limit
        while True:
            n = int(np.searchsorted(-sa, -(cut - sb[0]), "right"))
            per = np.searchsorted(-sb, -(cut - sa[:n]), "right")
            if per.sum() >= min(LEAST, m * m):
                break
            cut -= 0.05 * abs(limit) + 1e-6
        got = [oa[r, i] * m + ob[r, : per[i]] for i in range(n)]
        out.append(np.sort(np.concatenate(got)))
    return out


def unit_rows(column, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision and the rows they come from; rows without a direction are left out."""
    rows, units = [], []
    for i, v in enumerate(column.to_pylist()):
        if v and None not in v:
            x = np.array(v, np.float64)
            if np.isfinite(x).all():
                most = np.abs(x).max()
                if most > 0:
                    x = x / most
                    rows.append(i)
                    units.append(x / np.sqrt(x @ x))
    return ids[rows] if rows else ids[:0], units


def near_vectors(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of vectors.

    Two vectors of one label (not null) link if their cosine, in double precision, is at least threshold. Vectors that
    are null, empty or zero, or hold a null, NaN or infinity, and rows without a label link with nothing; vectors of
    different length never link. n_links counts the other rows linked directly, component_id is the least vec_id
    reachable, kept says whether that is the row's own. vec_id is expected to be unique; an empty table gives an empty
    result; other columns are ignored. Links below the threshold are never reported; a link is missed only if the two
    share no filter (recall measured in tests and README).
    """
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    keyed = base.filter("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").select(
        "vec_id", "label", F.xxhash64("label", "v").alias("h1"), F.xxhash64(F.lit(1), "v", "label").alias("h2"), "v"
    )
    reps = settled(keyed.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"), F.first("label").alias("label"), F.first("v").alias("v")))
    n = reps.count()
    # filters grow with the vectors, so that a filter has about as many at any size
    m = int(2 ** np.clip(np.ceil(np.log2(max(n, 1)) / 2 - 1), 5, 12))

    def decode(parts):
        for part in parts:
            ids = np.arange(part.num_rows)
            rows, units = unit_rows(part.column("v"), ids)
            got = {}
            for dim in {len(u) for u in units}:
                at = [i for i, u in enumerate(units) if len(u) == dim]
                for lo in range(0, len(at), 512):
                    some = at[lo : lo + 512]
                    got |= dict(zip(some, passed(np.array([units[i] for i in some]), m), strict=True))
            data = [units[i].tobytes() for i in range(len(units))]
            yield pa.RecordBatch.from_arrays(
                [part.column("rep").take(pa.array(rows)), part.column("m").take(pa.array(rows)), part.column("label").take(pa.array(rows)), pa.array(data, pa.binary()), pa.array([got[i] for i in range(len(units))], pa.list_(pa.int64()))],
                names=["rep", "m", "label", "unit", "filters"],
            )

    kind = dict(reps.dtypes)["label"]
    decoded = settled(reps.select("rep", "m", "label", "v").mapInArrow(decode, f"rep long, m long, label {kind}, unit binary, filters array<long>"))
    slim = decoded.select("label", "rep", F.explode("filters").alias("filter")).withColumn("dim", F.lit(0))
    sizes = slim.groupBy("label", "filter").agg(F.count("*").alias("size")).filter("size > 1")
    parts = max(12, n * PASSED // 20_000)
    rows = decoded.withColumn("filter", F.explode("filters")).join(sizes, ["label", "filter"])
    rows = rows.withColumn("blocks", F.expr(f"CAST(ceil(size / {BUCKET}) AS INT)")).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # block pairs (i, j), i <= j, that this vector's block is in
    rows = rows.withColumn("pair", F.explode(F.expr("transform(sequence(0, blocks - 1), x -> struct(least(x, own) AS i, greatest(x, own) AS j))")))
    rows = rows.select("rep", "m", "unit", "filters", "filter", "own", "pair.i", "pair.j", F.xxhash64("label", "filter", "pair").alias("bucket"))
    rows = rows.withColumn("part", F.pmod("bucket", F.lit(parts)))

    def meet(table: pa.Table) -> pa.Table:
        K.release()
        table = table.sort_by([("bucket", "ascending")])
        bucket = table["bucket"].to_numpy()
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        rep, weight, filt = (table[x].to_numpy() for x in ("rep", "m", "filter"))
        own, i, j = (table[x].to_numpy() for x in ("own", "i", "j"))
        out = [[], [], []]
        for lo, hi in zip([0, *cuts], [*cuts, len(bucket)], strict=True):
            if hi - lo < 2:
                continue
            units = [np.frombuffer(x, np.float64) for x in table["unit"].slice(lo, hi - lo).to_pylist()]
            if len({len(u) for u in units}) > 1:
                width = max(map(len, units))
                size = np.array([len(u) for u in units])
                units = np.array([np.pad(u, (0, width - len(u))) for u in units])
            else:
                units, size = np.array(units), None
            near = units @ units.T >= threshold
            if size is not None:
                near &= size[:, None] == size[None, :]
            np.fill_diagonal(near, False)
            if i[lo] != j[lo]:
                near &= own[lo:hi, None] != own[None, lo:hi]
            if not near.any():
                continue
            # links that an earlier common filter has counted
            earlier = [[f for f in x if f < filt[lo]] for x in table["filters"].slice(lo, hi - lo).to_pylist()]
            names = {f: c for c, f in enumerate({f for x in earlier for f in x})}
            if names:
                grid = np.zeros((hi - lo, len(names)), np.float32)
                for r, x in enumerate(earlier):
                    grid[r, [names[f] for f in x]] = 1
                near &= grid @ grid.T == 0
            links = near @ weight[lo:hi]
            forest = span(near, rep[lo:hi])
            some = np.flatnonzero(links)
            for column, values in zip(out, (rep[lo:hi][some], links[some], forest[some]), strict=True):
                column.append(values)
        return pa.Table.from_arrays([pa.array(np.concatenate(c) if c else [], pa.int64()) for c in out], schema=FOUND_SCHEMA)

    found = settled(rows.groupBy("part").applyInArrow(meet, FOUND))
    links = found.groupBy("rep").agg(F.sum("links").alias("near"))
    groups = components(found, "rep", "other")
    known = reps.select("h1", "h2", "rep", "m").join(links, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.withColumn("alone", F.lit(False))
    # which representatives have a direction at all
    live = decoded.select("rep", F.lit(True).alias("live"))
    known = known.join(live, "rep", "left").drop("alone")
    out = keyed.select("vec_id", "h1", "h2").join(known, ["h1", "h2"])
    out = out.select(
        "vec_id",
        F.when(F.col("live"), F.col("m") - 1 + F.coalesce("near", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("live"), F.coalesce("component", "rep")).otherwise(F.col("vec_id")).alias("component_id"),
    )
    rest = base.filter("vec_id IS NULL OR label IS NULL OR v IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def span(near: np.ndarray | tuple, ids: np.ndarray) -> np.ndarray:
    """For each row the least id of its connected part of near, a matrix or the places of links in one."""
    label = np.arange(len(ids))
    by = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[by] = np.arange(len(ids))
    label = place.copy()
    a, b = near if isinstance(near, tuple) else np.nonzero(near)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = np.minimum(new, new[by[new]])
        if (new == label).all():
            return ids[by[label]]
        label = new
