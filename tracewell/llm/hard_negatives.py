"""Hard negatives of anchor vectors, by a vector-approximation file.

Components become whole numbers, and each dimension is cut into CELLS cells at the quantiles of a bounded sample; a vector's
approximation is one byte for each dimension. For an anchor, a table per dimension has the least and the most that a cell can add to
the inner product, so sums of looked-up numbers bound every row's score from below and above. Exact scores are
made only for rows that the bounds leave: those that may be among an anchor's best positives, or that may enter the
window of one of them and be among its best there.

Anchors come in rounds of bounded size, which are broadcast; the file is scanned where it lies. A task keeps the best of what it
has seen, whose worst also narrows the search, and yields no more than that; a top-k by rank joins the tasks' lists.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .tables import settled

CELLS = 256
#: Rows that the cells are fitted on, by hash of their ids. Only how narrow the bounds are depends on them, never a result.
SAMPLE = 4096
#: Bytes of anchors' vectors that one round broadcasts.
ROUND_BYTES = 8 << 20
#: Bytes of the tables of those anchors, and rows, whose bounds are made at once.
TABLE_BYTES, ROWS = 16 << 20, 4096
PAIRS = 1 << 15
LEAST = np.iinfo(np.int64).min
FILE = "vec_id long, label long, cells binary, vector binary"
FILE_SCHEMA = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("cells", pa.binary()), ("vector", pa.binary())])
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def whole_vectors(vectors: DataFrame, scale: int, id_col: str, label: str, vector: str) -> DataFrame:
    """(vec_id, label, q array<long>): the rows that take part, one for each id (of rows that share one, the least label and vector)."""
    x = F.col(vector).cast("array<double>")
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), x.alias("v"))
    good = base.filter("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")
    q = good.select("vec_id", F.struct("label", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("q")).alias("r"))
    return q.groupBy("vec_id").agg(F.min("r").alias("r")).select("vec_id", "r.label", "r.q")


def padded(column, width: int) -> np.ndarray:
    """Rows of an array column as a matrix; shorter ones count as 0 beyond their end."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy()
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


class Cells:
    """Borders of the cells of each dimension, with the least and the most value that a cell's rows can have."""

    def __init__(self, sample: np.ndarray, least: np.ndarray, most: np.ndarray):
        n = max(1, len(sample))
        at = (np.arange(1, CELLS) * n) // CELLS
        ordered = np.sort(sample, axis=0) if len(sample) else np.zeros((1, len(least)), np.int64)
        self.borders = np.ascontiguousarray(ordered[np.minimum(at, len(ordered) - 1)].T)  # a row for each dimension, ascending
        self.low = np.concatenate([least[:, None], self.borders], axis=1)
        # a cell ends one before the next border; an empty cell's end may lie below its start, and is never looked up
        self.high = np.concatenate([self.borders - 1, most[:, None]], axis=1)

    def of(self, q: np.ndarray) -> np.ndarray:
        out = np.empty(q.shape, np.uint8)
        for d, borders in enumerate(self.borders):
            out[:, d] = np.searchsorted(borders, q[:, d], "right")
        return out

    def tables(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each dimension, cell and anchor the least and the most that the cell adds to the score."""
        a = anchors.T[:, None, :]
        x, y = self.low[:, :, None] * a, self.high[:, :, None] * a
        return np.minimum(x, y), np.maximum(x, y)


def bounds(cells: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, anchors) sums of the tables' entries: no score is below the first or above the second."""
    out = []
    for table in tables:
        total = np.zeros((len(cells), table.shape[2]), np.int64)
        for d in range(cells.shape[1]):
            total += table[d].take(cells[:, d], axis=0)
        out.append(total)
    return out[0], out[1]


class Best:
    """The best entries of each slot so far: highest score first, ties by smaller id."""

    def __init__(self, slots: int, k: int):
        self.k, self.slots = k, slots
        self.slot = self.score = self.id = np.zeros(0, np.int64)
        self.floor = np.full(slots, LEAST)  # a slot's k-th score: lower ones can't enter

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        slot, score, ids = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, slot))
        slot = slot[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        kept = place < self.k
        self.slot, self.score, self.id = slot[kept], score[order][kept], ids[order][kept]
        last = place == self.k - 1
        self.floor[slot[last]] = score[order][last]


def kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each column; LEAST where there are fewer."""
    if len(values) < k:
        return np.full(values.shape[1], LEAST)
    return np.partition(values, len(values) - k, axis=0)[len(values) - k]


class Anchors:
    """One round: ids, labels and vectors of the anchors, ascending by id."""

    def __init__(self, table: pa.Table, width: int):
        table = table.sort_by("vec_id")
        self.id, self.label = (table[c].to_numpy() for c in ("vec_id", "label"))
        self.q = matrix(table["vector"], width)


def matrix(column, width: int, kind=np.int64) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def pages(batches, width: int):
    """(ids, labels, cells, vectors) of up to ROWS rows of the file at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            part = batch.slice(lo, ROWS)
            yield part.column("vec_id").to_numpy(), part.column("label").to_numpy(), matrix(part.column("cells"), width, np.uint8), matrix(part.column("vector"), width)


def some(of: np.ndarray, width: int) -> list[np.ndarray]:
    """Anchors in parts whose tables have TABLE_BYTES at most."""
    size = max(1, TABLE_BYTES // (width * CELLS * 8))
    return [of[i : i + size] for i in range(0, len(of), size)]


def exact(q: np.ndarray, anchors: np.ndarray, row: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Scores of pairs, a bounded number at a time."""
    parts = [np.einsum("ij,ij->i", q[row[i : i + PAIRS]], anchors[anchor[i : i + PAIRS]]) for i in range(0, len(row), PAIRS)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def best_positives(batches, anchors: Anchors, cells: Cells, width: int, k: int) -> Best:
    """The k best rows of each anchor's label among those of the file."""
    best = Best(len(anchors.id), k)
    for ids, labels, codes, q in pages(batches, width):
        found = []
        for label in np.intersect1d(labels, anchors.label):
            rows, of_label = np.flatnonzero(labels == label), np.flatnonzero(anchors.label == label)
            found += [same_label(rows, at, codes, q, ids, anchors, cells, best) for at in some(of_label, width)]
        if found:
            best.add(*(np.concatenate(x) for x in zip(*found, strict=True)))
    return best


def same_label(rows: np.ndarray, at: np.ndarray, codes: np.ndarray, q: np.ndarray, ids: np.ndarray, anchors: Anchors, cells: Cells, best: Best) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, score, id) of rows that may be among the best of the anchors at, all of one label."""
    low, high = bounds(codes[rows], cells.tables(anchors.q[at]))
    other = ids[rows][:, None] != anchors.id[at][None, :]
    need = np.maximum(best.floor[at], kth(np.where(other, low, LEAST), best.k))
    r, a = np.nonzero(other & (high >= need))
    return at[a], exact(q, anchors.q, rows[r], at[a]), ids[rows[r]]


def best_negatives(batches, anchors: Anchors, cells: Cells, width: int, k: int, window: tuple[np.ndarray, np.ndarray]) -> Best:
    """The k best rows of another label whose score lies in a positive's window (anchors, positives), for each of them."""
    low_end, high_end = window
    n, m = low_end.shape
    best = Best(n * m, k)
    for ids, labels, codes, q in pages(batches, width):
        found = []
        for at in some(np.arange(n), width):
            low, high = bounds(codes, cells.tables(anchors.q[at]))
            other = labels[:, None] != anchors.label[at][None, :]
            may = []
            for p in range(m):
                a, b = low_end[at, p], high_end[at, p]
                inside = other & (high >= a) & (low <= b)
                sure = inside & (low >= a) & (high <= b)
                need = np.maximum(best.floor[at * m + p], kth(np.where(sure, low, LEAST), k))
                may.append(inside & (high >= need))
            r, c = np.nonzero(np.logical_or.reduce(may)) if may else (np.zeros(0, np.int64),) * 2
            score = exact(q, anchors.q, r, at[c])
            for p in range(m):
                own = may[p][r, c] & (score >= low_end[at[c], p]) & (score <= high_end[at[c], p])
                found.append((at[c][own] * m + p, score[own], ids[r[own]]))
        if found:
            best.add(*(np.concatenate(x) for x in zip(*found, strict=True)))
    return best


def first_of(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first k of each group: highest score first, ties by smaller id; with rank."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, anchors: str = "vec_id % 100 = 0", positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, scale: int = 256,
    id_col: str = "vec_id", label: str = "label", vector: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), by exact scores.

    Components become floor(scale * x); a score is the inner product of whole numbers; higher scores come first, ties by
    smaller vec_id. anchors picks the anchors by vec_id and label. An anchor's positives are its first rows of the same label, itself
    excluded; for each, the negatives are the first rows of another label with least * positive <= 100 * score <= most * positive.

    Rows without id or label, or whose vector is null or holds a null, NaN or infinity, take no part. Of rows that share an id one takes
    part, that of least label and vector. A vector that is shorter than others counts as 0 beyond its end. Scores must fit 64
    bits. An anchor without positives, and a positive without negatives, has no row; an empty table gives an empty result; other columns are
    ignored.
    """
    spark = vectors.sparkSession
    rows = settled(whole_vectors(vectors, scale, id_col, label, vector))
    longest, total = rows.agg(F.max(F.size("q")), F.count("*")).first()
    width, n = max(1, longest or 0), rows.filter(anchors).count()
    if not n:
        return spark.createDataFrame([], OUT)
    # a row for each dimension, and a bounded sample, are all that reaches the driver
    ends = rows.select(F.posexplode("q").alias("d", "x")).groupBy("d").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n")).toArrow()
    least_of, most_of = np.zeros((2, width), np.int64)
    d, short = ends["d"].to_numpy(), ends["n"].to_numpy() < total  # where some rows have ended, 0 counts
    least_of[d] = np.where(short, np.minimum(ends["low"].to_numpy(), 0), ends["low"].to_numpy())
    most_of[d] = np.where(short, np.maximum(ends["high"].to_numpy(), 0), ends["high"].to_numpy())
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("q").toArrow()
    cells = Cells(padded(sample.column("q"), width), least_of, most_of)

    def approximate(batches):
        for part in batches:
            q = padded(part.column("q"), width)
            raw = [np.ascontiguousarray(x) for x in (cells.of(q), q)]
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), *[pa.array([r.tobytes() for r in x], pa.binary()) for x in raw]], schema=FILE_SCHEMA)

    file = settled(rows.mapInArrow(approximate, FILE))
    rounds = -(-n * width * 8 // ROUND_BYTES)
    mine = file.filter(anchors).withColumn("round", F.pmod(F.xxhash64("vec_id"), F.lit(rounds)))
    out = None
    for i in range(rounds):
        own = spark.sparkContext.broadcast(Anchors(mine.filter(F.col("round") == i).select("vec_id", "label", "vector").toArrow(), width))
        found = one_round(file, own, cells, width, positives, negatives, least, most)
        found = found if rounds == 1 else settled(found)
        out = found if out is None else out.unionByName(found)
    return out


def one_round(file: DataFrame, own, cells: Cells, width: int, positives: int, negatives: int, least: int, most: int) -> DataFrame:
    """The result for the anchors of one round. own: their broadcast."""

    def near(batches):
        anchors = own.value
        best = best_positives(batches, anchors, cells, width, positives)
        K.release()
        yield pa.RecordBatch.from_arrays([pa.array(anchors.id[best.slot]), pa.array(best.id), pa.array(best.score)], names=["anchor_id", "id", "score"])

    first = first_of(file.mapInArrow(near, "anchor_id long, id long, score long"), ["anchor_id"], positives).toArrow()
    ids = own.value.id
    row, place = np.searchsorted(ids, first["anchor_id"].to_numpy()), first["rank"].to_numpy() - 1
    names, scores, low_end, high_end = np.zeros((4, len(ids), positives), np.int64)
    low_end[:], high_end[:] = 1, 0  # no positive: an empty window
    names[row, place], scores[row, place] = first["id"].to_numpy(), first["score"].to_numpy()
    low_end[row, place], high_end[row, place] = -(-least * scores[row, place] // 100), most * scores[row, place] // 100

    def far(batches):
        best = best_negatives(batches, own.value, cells, width, negatives, (low_end, high_end))
        K.release()
        a, p = best.slot // positives, best.slot % positives
        columns = (ids[a], names[a, p], scores[a, p], best.id, best.score)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor_id", "positive_id", "positive_score", "id", "score"])

    found = first_of(file.mapInArrow(far, "anchor_id long, positive_id long, positive_score long, id long, score long"), ["anchor_id", "positive_id"], negatives)
    return found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
