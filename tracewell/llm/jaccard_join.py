"""Jaccard join on word n-grams, exact, in the metric space of Jaccard distance.

Documents of one set are folded into one. Sets are joined by Voronoi cells: members of a region are sampled as pivots, each
set that is near to one (distance at most NEAR) goes to its nearest pivot's cell, and as a guest to every cell that the
triangle inequality allows a partner to be in (distance at most two radii beyond its nearest, and at most NEAR and one
radius). Sets near to no pivot make an outer cell of their own. A cell that is larger than a leaf is divided again by pivots
of its own, so every region ends in leaves, where links are decided by exact intersection counts. Regions that fit a task
are divided inside it; larger ones by a shuffle per round, dealt in chunks so that no region is one task.

Unrelated documents are all at distance 1 from each other and from any pivot, so the first regions cannot come from pivots
(each round would take out little more than its pivots). They come from a pigeonhole filter: a set is cut by hash into more
classes than a similar pair can differ in elements, so similar sets agree on whole classes, and sets that agree are of one
region. There are twice as many classes as are needed for one to agree, so half of them need not be told: those found to be
frequent and those of few elements, by which documents that share no more than a passage would chain their regions. Which are frequent is
taken from a sample, which only orders them: any order gives the same links. Long documents of many shared passages still
chain; so regions are then split by bitmaps of the sets, a few bits for each element: the bits in which two sets differ are at
most the elements in which they do, so what is not joined by close bitmaps cannot link. Class signatures are folded where they arise, so one that a third of all
documents share is never one task, and nothing is emitted per pair.

Elements are 64-bit hashes of n-grams. A set goes by a 64-bit hash of its own, not by a doc_id, which may be null or have
several sets; regions are formed over 40 bits of it, where a clash only makes a region larger.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .cap_filters import span
from .components import components
from .tables import settled

U = np.uint64
#: Sets of a region that one task divides on its own, and sets of small regions that share a task.
REGION, TASK = 1200, 3000
#: Sets that are compared with each other as they are.
LEAF = 6
#: Distance up to which a set is near to a pivot, and pivots of a round inside a task.
NEAR, PIVOTS = 0.5, 16
#: Rounds of division by shuffles. What is still too large is met in blocks.
VORONOI_ROUNDS = 6
#: Bytes of signatures that a bucket is meant to hold.
BUCKET_BYTES = 8 << 20
#: One in so many sets tells which signatures are frequent; of those, so many are known to all (12 bytes each).
SAMPLE, OFTEN, LEAST_OFTEN = 8, 1 << 16, 3
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SLIM = "doc_id long, key long, key2 long, n long, level long, h1 long, h2 long, bits binary"
SLIM_SCHEMA = pa.schema([(x, pa.binary() if x == "bits" else pa.int64()) for x in ("doc_id", "key", "key2", "n", "level", "h1", "h2", "bits")])
#: Bitmaps that are compared in one go.
BLOCK = 1024
PAIR = "a long, b long"
PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
#: Signatures that a task gathers before it deals them to buckets.
SENT = 500_000
SETS = "region long, rep long, elements binary"
SETS_SCHEMA = pa.schema([("region", pa.int64()), ("rep", pa.int64()), ("elements", pa.binary())])
BUCKET = "bucket long, sigs binary, names binary, pairs binary"
BUCKETS = pa.schema([("bucket", pa.int64()), ("sigs", pa.binary()), ("names", pa.binary()), ("pairs", pa.binary())])


def shingles(column, n: int) -> list[np.ndarray]:
    """Each row's set of word n-grams, A-Z in lower case; fewer words are one n-gram, none are none. Sorted hashes."""
    data, offsets = K.text_bytes(column)
    starts, ends, rows = K.words(data, offsets)
    hashed = K.piece_hashes(LOWER[data], starts, ends)
    m = max(0, len(hashed) - n + 1)
    grams = np.zeros(m, U)
    for i in range(n):
        grams = K.mix(grams + hashed[i : i + m])
    out = []
    for lo, hi in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if hi - lo >= n:
            out.append(np.unique(grams[lo : hi - n + 1]))
        elif hi > lo:
            h = np.full(1, hi - lo, U)
            for i in range(lo, hi):
                h = K.mix(h + hashed[i])
            out.append(K.mix(h + U(12345)))
        else:
            out.append(np.zeros(0, U))
    return out


class Classes:
    """Signatures of sets such that any two sets of similarity num / den or more have one in common."""

    def __init__(self, num: int, den: int):
        #: Levels of size: a set of level l links with levels l - 1 to l + 1 only.
        self.top, low = [], 1
        while low < 1 << 40:
            high = low * den // num
            self.top.append(high)
            low = high + 1
        self.top = np.array(self.top, np.int64)
        # similar sets of at most s elements differ in at most this many
        self.differ = 2 * self.top * (den - num) // (den + num)
        #: Signatures for each element of a set, about.
        self.rate = 4 * (den - num) / (den + num)

    def level(self, n: int) -> int:
        return int(np.searchsorted(self.top, n))

    def width(self, tag: int) -> int:
        """Bits of the bitmaps that sets of this level and of the one below are compared by."""
        return max(256, 1 << (2 * int(self.top[tag])).bit_length() - 1)

    def bits(self, s: np.ndarray) -> bytes:
        """The bitmap of a set, for the level above its own; half as wide a one is the halves, one over the other."""
        out = np.zeros(self.width(self.level(len(s)) + 1), np.uint8)
        out[(K.mix(s) & U(len(out) - 1)).astype(np.int64)] = 1
        return np.packbits(out).tobytes()

    def of(self, s: np.ndarray, often: tuple[np.ndarray, np.ndarray] | None = None, every: bool = False) -> np.ndarray:
        """The signatures of a set; with every, all those that say something.

        Similar sets agree on more classes than they can differ in elements leave over: on k - d of k or more. So each
        needs to tell only its d + 1 rarest, in an order that all sets share (the prefix filter): by how often signatures
        were seen (often: values, ascending, and counts), and then classes of many elements first, as those agree least by chance.
        """
        level = self.level(len(s))
        out = []
        for tag in (level, level + 1):
            d = int(self.differ[tag])
            if d == 0 or len(s) == 0:
                continue  # such sets link only if equal
            k = 2 * (d + 1)
            own = K.mix(s + U(tag + 1))
            cls = ((own >> U(32)) * U(k) >> U(32)).astype(np.int64)
            sums = np.zeros(k, U)
            np.add.at(sums, cls, K.mix(own))
            filled = np.bincount(cls, minlength=k)
            name = np.arange(k, dtype=U) + U(tag) * U(1 << 40)
            sig = K.mix(K.mix(sums + filled.astype(U)) ^ K.mix(name + U(7)))
            if every:
                out.append(sig[filled > 0])
                continue
            seen = np.where(filled > 0, 0, np.iinfo(np.int64).max)
            if often is not None and len(often[0]):
                at = np.minimum(np.searchsorted(often[0], sig), len(often[0]) - 1)
                seen = np.where((often[0][at] == sig) & (filled > 0), often[1][at], seen)
            out.append(sig[np.lexsort((sig, -filled, seen))[: d + 1]])
        return np.unique(np.concatenate(out)) if out else np.zeros(0, U)


def links_within(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Which of these sets link, as a matrix."""
    size = np.array([len(s) for s in sets], np.int64)
    if len(sets) <= 6:
        both = np.zeros((len(sets), len(sets)), np.int64)
        for i in range(len(sets)):
            for j in range(i):
                both[i, j] = both[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        order = np.argsort(flat, kind="stable")
        flat, row = flat[order], row[order]
        fresh = np.ones(len(flat), bool)
        fresh[1:] = flat[1:] != flat[:-1]
        column = np.cumsum(fresh) - 1
        often = np.bincount(column)[column] > 1
        column, row = column[often], row[often]
        if len(column):
            column = np.unique(column, return_inverse=True)[1]
        both = np.zeros((len(sets), len(sets)), np.float32)
        width = 4096
        for lo in range(0, int(column.max()) + 1 if len(column) else 0, width):
            a, b = np.searchsorted(column, [lo, lo + width])
            grid = np.zeros((len(sets), width), np.float32)
            grid[row[a:b], column[a:b] - lo] = 1
            both += grid @ grid.T
        both = np.rint(both).astype(np.int64)
    near = den * both >= num * (size[:, None] + size[None, :] - both)
    np.fill_diagonal(near, False)
    return near


def common(sets: list[np.ndarray], pivots: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set with each pivot."""
    flat = np.concatenate(pivots)
    names, inverse = np.unique(flat, return_inverse=True)
    grid = np.zeros((len(names), len(pivots)), np.int64)
    grid[inverse, np.repeat(np.arange(len(pivots)), [len(p) for p in pivots])] = 1
    out = np.zeros((len(sets), len(pivots)), np.int64)
    for i, s in enumerate(sets):
        at = np.searchsorted(names, s)
        at = at[names[np.minimum(at, len(names) - 1)] == s]
        out[i] = grid[at].sum(axis=0)
    return out


def distances(sets: list[np.ndarray], pivots: list[np.ndarray]) -> np.ndarray:
    both = common(sets, pivots)
    size = np.array([len(s) for s in sets])[:, None] + np.array([len(p) for p in pivots])[None, :]
    return 1 - both / (size - both)


def windows(d: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sets at distances d from pivots: which is each one's pivot, whether it is near, and all cells that it must be in.

    Let x and y link, so d(x, y) <= radius, and x be near to its pivot p. Then d(y, p) <= NEAR + radius, and d(y, p) <=
    d(x, p) + radius <= d(x, q) + radius <= d(y, q) + 2 * radius for y's own pivot q: so y is in p's cell. If neither is near, both
    are in the outer cell.
    """
    home = d.argmin(axis=1)
    least = d.min(axis=1, keepdims=True)
    inside = (d <= least + 2 * radius + 1e-9) & (d <= NEAR + radius + 1e-9)
    return home, least[:, 0] <= NEAR, inside


def voronoi_links(sets: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """All links (i, j) of these sets, by recursive division into Voronoi cells; a link of two guests may come twice.

    A leaf, or a cell that its pivots do not divide, is decided by intersection counts of its sets.
    """
    radius, found = (den - num) / den, []
    size = np.array([len(s) for s in sets])
    work = [np.argsort(size, kind="stable")]
    while work:
        at = work.pop()
        if len(at) < 2:
            continue
        if len(at) <= LEAF:
            i, j = np.nonzero(np.triu(links_within([sets[i] for i in at], num, den)))
            found.append(np.stack([at[i], at[j]]))
            continue
        # pivots evenly spaced in order of size, which is a sample of the cell that reruns alike
        pick = at[np.linspace(0, len(at) - 1, min(PIVOTS, -(-len(at) // LEAF) + 1)).astype(np.int64)]
        _, near, inside = windows(distances([sets[i] for i in at], [sets[i] for i in pick]), radius)
        cells = [at[inside[:, j]] for j in range(len(pick))] + [at[~near]]
        if sum(len(c) ** 2 for c in cells) > 0.7 * len(at) ** 2:  # dense: the cells would be more work than the whole
            i, j = np.nonzero(np.triu(links_within([sets[i] for i in at], num, den)))
            found.append(np.stack([at[i], at[j]]))
        else:
            work += cells
    return tuple(np.concatenate(found, axis=1)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def near_documents(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text: str = "text", region: int = REGION) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of docs.

    A document's set holds its distinct n-word shingles (words `[^\\x20\\x09-\\x0D]+`, A-Z in lower case); fewer words
    are one shingle. Two documents link if intersection * den >= union * num. component_id is the least doc_id reachable
    by links, itself included. Null or empty texts have an empty set and link with nothing; rows that repeat a doc_id are
    taken each; rows of null doc_id link as others, with null as their component where they reach no doc_id; an empty table gives an empty result; other columns are ignored.
    """
    classes = Classes(num, den)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    # a row's text is found again by 128 bits of its id and text
    base = base.withColumn("key", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text")).withColumn("key2", F.xxhash64("text", "doc_id", F.col("doc_id").isNull()))

    def batches(parts):
        for part in parts:
            K.release()
            for at, count in K.batches(part.column("text"), 1 << 20):
                rows = part.slice(at, count)
                yield rows, shingles(rows.column("text"), n)
        K.release()

    def slim(parts):
        for rows, sets in batches(parts):
            h = names_of(sets)
            n_of = [len(s) for s in sets]
            columns = [pa.array(n_of, pa.int64()), pa.array([classes.level(x) for x in n_of], pa.int64()), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array([classes.bits(s) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("key"), rows.column("key2"), *columns], schema=SLIM_SCHEMA)

    every = settled(base.mapInArrow(slim, SLIM))
    full = every.filter("n > 0")
    words = every.agg(F.sum("n")).first()[0] or 0
    buckets = max(24, int(words * classes.rate * 9) // BUCKET_BYTES)

    def sampled(parts):
        told: set[int] = set()
        for _, sets in batches(parts):
            fresh = []
            for name, s in zip(names_of(sets)[:, 0].tolist(), sets, strict=True):
                if name not in told:
                    told.add(name)
                    fresh.append(classes.of(s, every=True))
            sig, seen = np.unique(np.concatenate(fresh) if fresh else np.zeros(0, U), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(seen)], names=["sig", "seen"])

    part = base.filter(F.pmod("key", F.lit(SAMPLE)) == 0).select("text").mapInArrow(sampled, "sig long, seen long")
    top = part.groupBy("sig").agg(F.sum("seen").alias("seen")).filter(F.col("seen") >= LEAST_OFTEN).orderBy(F.desc("seen"), "sig").limit(OFTEN).toArrow()
    values, seen = top["sig"].to_numpy().view(U), top["seen"].to_numpy()
    order = np.argsort(values)
    often = docs.sparkSession.sparkContext.broadcast((values[order], seen[order]))

    def announce(parts):
        """Per bucket the signatures of a few batches, each with its least set; sets that share one here are joined here."""
        told: set[int] = set()
        sig, own, held = [], [], 0
        for _, sets in batches(parts):
            for name, s in zip(short(names_of(sets)[:, 0]).tolist(), sets, strict=True):
                if name in told:
                    continue  # a copy: its signatures are on their way
                told.add(name)
                of = classes.of(s, often.value)
                sig.append(of)
                own.append(np.full(len(of), name))
                held += len(of)
            if held > SENT:
                yield from sent(sig, own)
                sig, own, held = [], [], 0
            if len(told) > 2_000_000:
                told.clear()
        yield from sent(sig, own)

    def sent(sig: list[np.ndarray], own: list[np.ndarray]):
        if not sig:
            return
        # 32 bits tell signatures apart within a bucket: a clash only makes a region larger
        s, o, pair = chained(np.concatenate(sig), np.concatenate(own))
        bucket = ((s >> U(32)) * U(buckets) >> U(32)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        rows = [(int(bucket[lo]), (s[lo:hi] & U(0xFFFFFFFF)).astype("<u4").tobytes(), packed(o[lo:hi]), b"") for lo, hi in zip([0, *cuts], [*cuts, len(s)], strict=True) if hi > lo]
        if pair.size:
            rows.append((int(pair[0, 0]) % buckets, b"", b"", pair.astype("<i8").tobytes()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(BUCKETS)], schema=BUCKETS)

    def meet(table: pa.Table) -> pa.Table:
        K.release()
        sig = np.frombuffer(b"".join(table["sigs"].to_pylist()), "<u4").astype(U)
        own = unpacked(b"".join(table["names"].to_pylist()))
        known = [np.frombuffer(x, "<i8").reshape(2, -1) for x in table["pairs"].to_pylist() if x]
        return pairs(np.concatenate([*known, chained(sig, own)[2]], axis=1))

    agree = base.select("text").mapInArrow(announce, BUCKET).groupBy("bucket").applyInArrow(meet, PAIR)
    regions = components(agree, "a", "b").select(F.col("node").alias("short"), F.col("component").alias("region"))
    # of each set one row says where its text is, and the least doc_id is told
    reps = full.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.min(F.struct("key", "key2", "level", "n", "bits")).alias("row"))
    held = settled(reps.withColumn("short", F.shiftrightunsigned("h1", 24)).join(regions, "short").select("h1", "h2", "rep", "row.*", "region"))
    closer = components(refined(held.select("region", F.col("h1").alias("rep"), "level", "n", "bits"), classes, num, den), "a", "b")
    needed = settled(held.drop("region", "level", "n", "bits").join(closer.select(F.col("node").alias("h1"), F.col("component").alias("region")), "h1"))

    def elements(parts):
        for rows, sets in batches(parts):
            yield pa.RecordBatch.from_arrays([rows.column("region"), rows.column("rep"), pa.array([s.tobytes() for s in sets], pa.binary())], schema=SETS_SCHEMA)

    # only texts of sets that are left in a region are fetched, equal rows once
    texts = base.join(needed.select("key", "key2", F.col("h1").alias("rep"), "region"), ["key", "key2"])
    sets = texts.groupBy("rep").agg(F.first("text").alias("text"), F.first("region").alias("region")).select("text", "rep", "region").mapInArrow(elements, SETS)
    found = join_regions(settled(sets), num, den, region)
    # the least doc_id of a component, told to its sets
    groups = settled(components(found, "a", "b").withColumnRenamed("node", "h1").join(needed.select("h1", "rep"), "h1"))
    least = groups.groupBy("component").agg(F.min("rep").alias("least"))
    told = groups.join(least, "component").select("h1", "least")
    known = reps.select("h1", "h2", "rep").join(told, "h1", "left").select("h1", "h2", F.coalesce("least", "rep").alias("component_id"))
    linked = full.select("doc_id", "n", "h1", "h2").join(known, ["h1", "h2"]).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return linked.unionByName(every.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def refined(sets: DataFrame, classes: Classes, num: int, den: int) -> DataFrame:
    """A spanning forest (a, b) of the sets in a region whose bitmaps are close enough for a link. sets: region, rep, level, n, bits.

    Sets meet those of their own level and of the next. Groups over BLOCK sets are met block by block.
    """
    tagged = sets.withColumn("tag", F.explode(F.array("level", F.col("level") + 1))).drop("level")
    sizes = settled(tagged.groupBy("region", "tag").agg(F.count("*").alias("size")).filter("size > 1"))
    total = sizes.agg(F.sum("size"), F.max("size")).first()
    tasks = max(24, int(total[0] or 0) // TASK)
    rows = tagged.join(sizes, ["region", "tag"])
    if (total[1] or 0) > BLOCK:
        rows = rows.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        rows = rows.withColumn("pair", F.explode(F.expr("transform(sequence(0, blocks - 1), x -> struct(least(x, own) AS i, greatest(x, own) AS j))"))).select("region", "tag", "rep", "n", "bits", "own", "pair.i", "pair.j")
    else:
        rows = rows.select("region", "tag", "rep", "n", "bits", *[F.lit(0).alias(x) for x in ("own", "i", "j")])

    def compare(table: pa.Table) -> pa.Table:
        K.release()
        table = table.sort_by([(x, "ascending") for x in ("region", "tag", "i", "j", "rep")])
        region, tag, rep, n, own, i, j = (table[x].to_numpy() for x in ("region", "tag", "rep", "n", "own", "i", "j"))
        fresh = np.flatnonzero((np.diff(region) != 0) | (np.diff(tag) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
        out = []
        for lo, hi in zip([0, *fresh], [*fresh, len(rep)], strict=True):
            if hi - lo < 2:
                continue
            width = classes.width(int(tag[lo]))
            maps = []
            for x in table["bits"].slice(lo, hi - lo).to_pylist():
                m = np.frombuffer(x, np.uint8)
                while len(m) * 8 > width:
                    m = m[: len(m) // 2] | m[len(m) // 2 :]
                maps.append(m)
            maps = np.stack(maps)
            both = np.zeros((hi - lo, hi - lo), np.float32)
            for at in range(0, maps.shape[1], 512):
                part = np.unpackbits(maps[:, at : at + 512], axis=1).astype(np.float32)
                both += part @ part.T
            ones = np.diag(both)
            # similar sets differ in at most this many elements
            most = (n[lo:hi, None] + n[None, lo:hi]) * (den - num) // (den + num)
            near = ones[:, None] + ones[None, :] - 2 * both <= most
            np.fill_diagonal(near, False)
            root = span(near, rep[lo:hi])
            some = root != rep[lo:hi]
            out.append(np.stack([rep[lo:hi][some], root[some]]))
        return pairs(np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64))

    return rows.withColumn("task", F.pmod(F.xxhash64("region", "tag", "i", "j"), F.lit(tasks))).groupBy("task").applyInArrow(compare, PAIR)


def names_of(sets: list[np.ndarray]) -> np.ndarray:
    """Two hashes of each set."""
    h = np.array([[K.mix(s).sum(dtype=U), K.mix(s ^ U(K.BASE)).sum(dtype=U)] for s in sets], U).reshape(-1, 2)
    return K.mix(h + np.array([len(s) for s in sets], U)[:, None]).view(np.int64)


def short(name: np.ndarray) -> np.ndarray:
    """40 bits of a set's hash."""
    return (name.view(U) >> U(24)).astype(np.int64)


def packed(names: np.ndarray) -> bytes:
    """Short names in five bytes each, by planes."""
    return np.ascontiguousarray(names.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<i8").reshape(-1)


def chained(sig: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct signatures with the least set of each, and pairs that join all other sets of a signature to that one."""
    order = np.lexsort((own, sig))
    sig, own = sig[order], own[order]
    fresh = np.ones(len(sig), bool)
    fresh[1:] = sig[1:] != sig[:-1]
    first = np.flatnonzero(fresh)
    least = own[first][np.cumsum(fresh) - 1] if len(first) else own
    pair = np.unique(np.stack([own[~fresh], least[~fresh]]), axis=1)
    return sig[first], own[first], pair[:, pair[0] != pair[1]]


def pairs(found: np.ndarray) -> pa.Table:
    return pa.Table.from_arrays([pa.array(found[0].astype(np.int64)), pa.array(found[1].astype(np.int64))], schema=PAIRS)


def join_regions(sets: DataFrame, num: int, den: int, most: int) -> DataFrame:
    """Links of all regions (a, b), all or a spanning forest of each. sets: region, rep, elements.

    Regions over most sets are divided by pivots, round after round. One that pivots do not divide is dense: its sets lie
    around the pivots, to which most of them link. Sets that so hang together need no comparison with each other; the
    rest is compared with all, in blocks.
    """
    radius = (den - num) / den
    sizes = settled(sets.groupBy("region").agg(F.count("*").alias("size")))
    tasks = max(24, (sizes.agg(F.sum("size")).first()[0] or 0) // TASK)
    large = sizes.filter(F.col("size") > most)
    ready, links, rounds = [], [], 0
    while not large.isEmpty():
        ready.append(sets.join(large, "region", "left_anti"))
        parts = sets.join(large, "region")
        cells = settled(divide(parts, num, den, most))
        shares = cells.groupBy("region", "cell").agg(F.count("*").cast("double").alias("n"), F.first("size").alias("size"))
        dense = shares.groupBy("region").agg(F.sum(F.col("n") * F.col("n")).alias("pairs"), F.first("size").alias("size"))
        dense = settled(dense.filter(F.lit(rounds >= VORONOI_ROUNDS) | (F.col("pairs") > 0.7 * F.col("size") * F.col("size"))).select("region"))
        rounds += 1
        if not dense.isEmpty():
            around = settled(cells.filter("home").join(dense, "region", "left_semi").select("region", "rep", "elements", "size", "star", "label"))
            links += [around.filter("star IS NOT NULL").select(F.col("rep").alias("a"), F.col("star").alias("b")), around.filter("star IS NOT NULL").select(F.col("star").alias("a"), F.col("label").alias("b")).distinct()]
            ready.append(blocks(around, most))
        sets = settled(cells.join(dense, "region", "left_anti").select(F.xxhash64("region", "cell").alias("region"), "rep", "elements").distinct())
        sizes = settled(sets.groupBy("region").agg(F.count("*").alias("size")))
        large = sizes.filter(F.col("size") > most)
    plain = [F.lit(0).alias(x) for x in ("own", "i", "j")]
    ready = [r if "own" in r.columns else r.select("region", "rep", "elements", *plain) for r in [*ready, sets]]
    small = ready[0]
    for r in ready[1:]:
        small = small.unionByName(r)

    def decide(table: pa.Table) -> pa.Table:
        K.release()
        table = table.sort_by([("region", "ascending"), ("rep", "ascending")])
        at = table["region"].to_numpy()
        cuts = np.flatnonzero(np.diff(at)) + 1
        out = []
        for lo, hi in zip([0, *cuts], [*cuts, len(at)], strict=True):
            if hi - lo < 2:
                continue
            rep = table["rep"].slice(lo, hi - lo).to_numpy()
            own, i, j = (table[x].slice(lo, hi - lo).to_numpy() for x in ("own", "i", "j"))
            members = [np.frombuffer(x, U) for x in table["elements"].slice(lo, hi - lo).to_pylist()]
            if i[0] != j[0]:  # a pair of blocks: those of one with those of the other
                left, right = np.flatnonzero(own == i[0]), np.flatnonzero(own != i[0])
                if not len(left) or not len(right):
                    continue
                both = common([members[x] for x in left], [members[x] for x in right])
                size = np.array([len(s) for s in members])
                a, b = np.nonzero(den * both >= num * (size[left][:, None] + size[right][None, :] - both))
                near = left[a], right[b]
            else:
                near = voronoi_links(members, num, den)
            root = span(near, rep)
            some = root != rep
            out.append(np.stack([rep[some], root[some]]))
        return pairs(np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64))

    found = small.withColumn("task", F.pmod(F.xxhash64("region"), F.lit(tasks))).groupBy("task").applyInArrow(decide, PAIR)
    for more in links:
        found = found.unionByName(more)
    return found


def blocks(around: DataFrame, most: int) -> DataFrame:
    """Dense regions as pairs of blocks that need comparing: all but those within the part that hangs together by its pivots."""
    counts = around.filter("label IS NOT NULL").groupBy("region", "label").agg(F.count("*").alias("n"))
    core = counts.groupBy("region").agg(F.max(F.struct("n", "label")).alias("core")).select("region", "core.*").withColumnRenamed("label", "core").withColumnRenamed("n", "inside")
    half = max(1, most // 2)
    b = around.join(settled(core), "region", "left").withColumn("inside", F.coalesce("inside", F.lit(0)))
    # blocks of the rest come first, then those of the core
    b = b.withColumn("rest", F.ceil((F.col("size") - F.col("inside")) / half).cast("int")).withColumn("cores", F.ceil(F.col("inside") / half).cast("int"))
    at_core = F.coalesce(F.col("label") == F.col("core"), F.lit(False))
    b = b.withColumn("own", F.when(at_core, F.col("rest") + F.pmod(F.xxhash64("rep"), F.greatest("cores", F.lit(1))).cast("int")).otherwise(F.pmod(F.xxhash64("rep"), F.greatest("rest", F.lit(1))).cast("int")))
    others = F.when(at_core, F.filter(F.sequence(F.lit(0), F.col("rest")), lambda x: x < F.col("rest"))).otherwise(F.sequence(F.lit(0), F.greatest(F.col("rest") + F.col("cores") - 1, F.lit(0))))
    b = b.withColumn("pair", F.explode(F.transform(others, lambda x: F.struct(F.least(x, F.col("own")).alias("i"), F.greatest(x, F.col("own")).alias("j")))))
    return b.select(F.xxhash64("region", "pair").alias("region"), "rep", "elements", "own", "pair.i", "pair.j")


CELLS = "region long, rep long, elements binary, home boolean, size long, cell long, star long, label long"
CELLS_SCHEMA = pa.schema([(x, {"elements": pa.binary(), "home": pa.bool_()}.get(x, pa.int64())) for x in ("region", "rep", "elements", "home", "size", "cell", "star", "label")])
OUTER = -1


def divide(sets: DataFrame, num: int, den: int, most: int) -> DataFrame:
    """Rows of large regions (with their size), once per Voronoi cell that they must be in (see windows).

    home marks one row of each set; star is its pivot if the two link, label the least of the pivots that links tie to that one.
    Pivots are about 4 * size / most members, 48 at most, which go to all chunks of their region.
    """
    radius = (den - num) / den
    many = F.least(F.lit(48), F.ceil(F.col("size") * 4 / most)).cast("int")
    chunked = sets.withColumn("chunks", F.ceil(F.col("size") / most).cast("int")).withColumn("chunk", F.pmod(F.xxhash64("rep", F.lit(5)), F.col("chunks")).cast("int"))
    # pivots: members whose hash is under a bound that many are expected to be under; the bound, not the count, is fixed.
    # The region's name is hashed too, so a cell that is divided again has other pivots.
    chosen = F.pmod(F.xxhash64("rep", "region"), F.lit(1_000_000)) < many * 2 / F.col("size") * 1_000_000
    pivots = chunked.filter(chosen).select(F.col("region").alias("to"), F.col("rep").alias("pivot"), F.col("elements").alias("p"), F.explode(F.expr("sequence(0, chunks - 1)")).alias("part"))

    def assign(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return CELLS_SCHEMA.empty_table()
        K.release()
        right = right.sort_by("pivot")
        names, sets = right["pivot"].to_numpy(), [np.frombuffer(x, U) for x in left["elements"].to_pylist()]
        if not len(names):  # no pivot: all in the outer cell
            pick, cell = np.arange(left.num_rows), np.full(left.num_rows, OUTER)
            home, star = np.ones(len(pick), bool), np.full(len(pick), -1)
            label = star
        else:
            pivots = [np.frombuffer(x, U) for x in right["p"].to_pylist()]
            d = distances(sets, pivots)
            nearest, near, inside = windows(d, radius)
            i, j = np.nonzero(np.concatenate([inside, ~near[:, None]], axis=1))
            pick, cell = i, np.where(j < len(names), names[np.minimum(j, len(names) - 1)], OUTER)
            home = np.where(near[i], j == nearest[i], j == len(names))
            size = np.array([len(s) for s in sets]) + np.array([len(p) for p in pivots])[nearest]
            both = np.array([len(np.intersect1d(s, pivots[k], assume_unique=True)) for s, k in zip(sets, nearest, strict=True)])
            linked = den * both >= num * (size - both)
            tied = span(links_within(pivots, num, den), names)
            star, label = np.where(linked, nearest, -1)[pick], tied
        rows = left.take(pa.array(pick))
        named = lambda of: pa.array(np.where(star >= 0, of[np.maximum(star, 0)], 0) if len(of) else star, pa.int64(), mask=star < 0)
        return pa.Table.from_arrays([rows["region"], rows["rep"], rows["elements"], pa.array(home), rows["size"], pa.array(cell), named(names), named(label) if len(names) else named(names)], schema=CELLS_SCHEMA)

    return chunked.groupBy("region", "chunk").cogroup(pivots.groupBy("to", "part")).applyInArrow(assign, CELLS)
