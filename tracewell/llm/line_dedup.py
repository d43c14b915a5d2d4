"""Line dedup with a segment-partition edit join.

A line goes if an equal line occurs earlier in the corpus. A line of at least least code points also goes if one occurs
earlier that has the same digits and is within so many edits (insert, delete, replace a code point) as edits() allows the
shorter of the two. Documents are dealt into blocks, once; steps talk to blocks by messages (see passages.py):

1. Equal lines: each block sends its distinct lines' hashes (128 bits) to buckets, which answer which lines an earlier document has
   and, as the block told them, which an earlier line of the block equals. A line is named by its number in the block, so only
   this step hashes lines; the others find line breaks.
2. First lines are cut into one even segment more than edits are allowed. A line within that many edits of another has one of
   its segments, near to where it stood, so lines send index keys (length, digits, segment number, segment) and probe keys for the
   few substrings of each shorter length that the multi-match-aware windows allow. Lines that differ in their digits (the
   numbered lines of a list, say) never meet. An index key asks as a probe key does, so a line's keys at its own place are sent once. Nearly all
   keys meet nothing: buckets pass on only those that two lines have, and the steps below read these. A key also carries counts of classes of code
   points: pairs whose counts differ by more than edits can are dropped where they meet, in pieces, and not emitted.
3. One earlier line that is near decides a line. So a line is first paired with the few earlier ones of most like counts; their
   texts are fetched and the pairs decided by edit distance in a band of diagonals, bit-parallel over the band and side by
   side over many pairs. Lines that this leaves undecided, and only those, are then paired with all others they meet. A
   group of near lines, however large, so makes about as many pairs as it has lines.

Which of two near lines goes depends on their first places only, so the result does not depend on partitioning. All steps are
one plan, whose exchange of blocks Spark reuses.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import kernels as K
from .blocks import block_count
from .passages import ANSWER, MESSAGE, answers, bucket_of, messages

U = np.uint64
MOST, LEAST = 2, 20
#: Candidate pairs that a task looks at together, and code points of pairs that are compared side by side.
PAIRS, GRID = 1 << 19, 1 << 21
#: Classes of code points that are counted.
CLASSES = 32
#: Earlier lines that a line is first compared with, for each bucket it meets any in.
FEW = 4
#: Bits of a line's number in its block, and one that tells a probe key.
IDX_BITS = 28
#: Entries that a message holds at most, about.
ENTRIES = 1 << 20
FOLD = np.array([0, 1, 2, 1], np.int8)


class Lines:
    """The lines of one block of documents, in order of document and place."""

    def __init__(self, table: pa.Table, id_col: str, text: str):
        K.release()
        order = pa.compute.sort_indices(table, sort_keys=[(id_col, "ascending"), (text, "ascending")], null_placement="at_start")
        self.table = table.take(order)
        self.data, self.offsets = K.text_bytes(self.table[text])
        ids = self.table[id_col].cast(pa.int64())
        self.ids = pa.compute.fill_null(ids, np.iinfo(np.int64).min).to_numpy()
        # every row has one line more than line breaks
        breaks = np.flatnonzero(self.data == 10)
        per = np.searchsorted(breaks, self.offsets)
        self.per_row = np.diff(per) + 1
        self.rows = np.concatenate([[0], np.cumsum(self.per_row)])
        n = int(self.rows[-1])
        self.start, self.end = np.zeros(n, np.int64), np.zeros(n, np.int64)
        first = np.zeros(n, bool)
        first[self.rows[:-1]] = True
        self.start[first], self.start[~first] = self.offsets[:-1], breaks + 1
        last = np.zeros(n, bool)
        last[self.rows[1:] - 1] = True
        self.end[last], self.end[~last] = self.offsets[1:], breaks
        self.row = np.repeat(np.arange(len(self.per_row)), self.per_row)

    def held(self, flags: np.ndarray) -> np.ndarray:
        """How many of the flags, one a byte, each line has."""
        at = np.flatnonzero(flags)
        return np.searchsorted(at, self.end) - np.searchsorted(at, self.start)

    def told(self) -> np.ndarray:
        """Lines that hold a word."""
        return np.flatnonzero(self.held((self.data == 32) | (self.data - np.uint8(9) < 5)) < self.end - self.start)

    def chars(self) -> np.ndarray:
        """Code points of each line: bytes that do not continue one."""
        return self.end - self.start - self.held((self.data & 0xC0) == 0x80)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct lines with a word, by hash: the first of each and its two hashes; and the lines equal to an earlier one."""
        told = self.told()
        h, g = (K.piece_hashes(self.data, self.start[told], self.end[told], salt) for salt in (0, 90))
        order = np.lexsort((g, h))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (h[order[1:]] != h[order[:-1]]) | (g[order[1:]] != g[order[:-1]])
        return told[order[fresh]], h[order[fresh]], g[order[fresh]], told[order[~fresh]]

    def text(self, line: int) -> bytes:
        return self.data[self.start[line] : self.end[line]].tobytes()


def edits(length: np.ndarray, most: int, least: int) -> np.ndarray:
    """Edits allowed to a pair whose shorter line has this length: one for each least code points, most at most."""
    return np.clip(length // max(least, 1), 0, most)


def segment(length: np.ndarray, i: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the i-th of so many even parts, the longer ones last."""
    base, extra = np.divmod(np.maximum(length, 0), parts)
    longer = parts - extra
    return i * base + np.maximum(0, i - longer), base + (i >= longer)


def keys(lines: list[bytes], most: int, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all lines: keys, the line each is of, whether it only probes, and the lines' class counts."""
    text = [np.frombuffer(x.decode("utf-8", "replace").encode("utf-32-le"), "<u4") for x in lines]
    size = np.array([len(t) for t in text], np.int64)
    offset = np.concatenate([[0], np.cumsum(size)])
    points = np.concatenate(text) if text else np.zeros(0, "<u4")
    flat = K.mix(points.astype(U) + U(1))
    line_of = np.repeat(np.arange(len(lines)), size)
    # two bits a class: differences are taken modulo 4, which never makes them larger
    profile = (np.bincount(line_of * CLASSES + (flat & U(CLASSES - 1)).astype(np.int64), minlength=len(lines) * CLASSES).reshape(-1, CLASSES) & 3).astype(np.uint8)
    sums = K.prefix(flat)
    # the digits of each line, in order: a digit's symbol is mixed with its place among the line's digits
    digit = np.flatnonzero((points >= 48) & (points <= 57))
    owner = line_of[digit]
    place = np.arange(len(digit)) - np.searchsorted(owner, owner)
    digits = np.zeros(len(lines), U)
    np.add.at(digits, owner, K.mix(flat[digit] ^ K.mix(place.astype(U) + U(1))))
    digits = K.mix(digits + U(3))
    out_key, out_line, out_probe = [], [], []

    def put(at: np.ndarray, start: np.ndarray, n: np.ndarray, length: np.ndarray, part: int, probe: bool) -> None:
        name = U(K.BASE) * (length.astype(U) * U(64) + U(part + 1)) + digits[at]
        out_key.append(K.mix(K.ranges(sums, offset[at] + start, offset[at] + start + n) + name))
        out_line.append(at)
        out_probe.append(np.full(len(at), probe))

    for t in range(1, most + 1):
        for less in range(t + 1):
            on = np.flatnonzero((size > less) & (edits(size - less, most, least) == t))
            if not len(on):
                continue
            length = size[on] - less
            for i in range(t + 1):
                p, n = segment(length, i, t + 1)
                if less == 0:
                    put(on, p, n, length, i, False)
                low = np.maximum(0, np.maximum(p - i, p + less - (t - i)))
                high = np.minimum(size[on] - n, np.minimum(p + i, p + less + (t - i)))
                for d in range(-t, 2 * t + 1):
                    x = np.flatnonzero((p + d >= low) & (p + d <= high))
                    if len(x) and (less or d):  # the index key itself asks for lines of its length
                        put(on[x], p[x] + d, n[x], length[x], i, True)
    if not out_key:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, bool), profile
    return np.concatenate(out_key), np.concatenate(out_line), np.concatenate(out_probe), profile


def several(key: np.ndarray) -> np.ndarray:
    """Indices of the keys that occur more than once, equal ones together."""
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    keep = np.zeros(len(key), bool)
    keep[1:] = same
    keep[:-1] |= same
    return order[keep]


def candidates(key: np.ndarray, ref: np.ndarray, probe: np.ndarray, profile: np.ndarray, most: int, place: np.ndarray, few: int | None = None, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (later, earlier) refs of lines that meet at a key and whose class counts allow most edits, and refs cut short.

    place: about where each line stands in the corpus (float32, so lines near to each other may tie: such a pair comes both ways). few:
    pairs that each later line has at most, those of most like counts; lines that have more are told. only: the later lines asked for.
    """
    order = np.lexsort((probe, key))
    key, ref, probe, profile, place = key[order], ref[order], probe[order], profile[order].astype(np.int8), place[order]
    wanted = np.isin(ref, only) if only is not None else None
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    group = np.cumsum(fresh) - 1
    begin = np.flatnonzero(fresh)
    indexed = np.bincount(group, weights=~probe).astype(np.int64) if len(group) else np.zeros(0, np.int64)
    asks = np.flatnonzero(indexed[group] > 0) if len(group) else np.zeros(0, np.int64)
    many = indexed[group[asks]]
    ends = np.cumsum(many)
    found, short, i = np.zeros((3, 0), np.int64), np.zeros(0, np.int64), 0
    while i < len(asks):
        before = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, before + PAIRS, "right")))
        a = np.repeat(asks[i:j], many[i:j])
        b = begin[group[a]] + np.arange(len(a)) - np.repeat(ends[i:j] - many[i:j] - before, many[i:j])
        i = j
        on = ref[a] != ref[b]
        if wanted is not None:
            on &= wanted[a] | wanted[b]
        a, b = a[on], b[on]
        apart = FOLD[(profile[a] - profile[b]) & 3].sum(axis=1)
        on = apart <= 2 * most
        a, b, apart = a[on], b[on], apart[on]
        ways = [(a, b, place[a] >= place[b]), (b, a, place[b] >= place[a])]
        new = [np.stack([ref[x[w]], ref[y[w]], apart[w]]) for x, y, w in ways]
        found = np.concatenate([found, *new], axis=1)
        if only is not None:
            found = found[:, np.isin(found[0], only)]
        found = np.unique(found, axis=1)
        if few:
            by = np.lexsort((found[1], found[2], found[0]))
            found = found[:, by]
            first = np.ones(found.shape[1], bool)
            first[1:] = found[0, 1:] != found[0, :-1]
            rank = np.arange(found.shape[1]) - np.maximum.accumulate(np.where(first, np.arange(found.shape[1]), 0))
            short = np.union1d(short, found[0, rank >= few])
            found = found[:, rank < few]
    return found[:2], short


def near_lines(a: list[str], b: list[str], most: int, least: int) -> np.ndarray:
    """Which pairs have equal digits and are within the edits they are allowed; compared in batches of GRID code points."""
    shorter = np.array([min(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.int64)
    longer = np.array([max(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.int64)
    allowed = edits(shorter, most, least)
    ok = np.array([re.findall("[0-9]", x) == re.findall("[0-9]", y) for x, y in zip(a, b, strict=True)], bool) & (longer - shorter <= allowed)
    out = np.zeros(len(a), bool)
    for t in range(1, most + 1):
        some = np.flatnonzero(ok & (allowed == t))
        some = some[np.argsort(longer[some], kind="stable")]
        lo = 0
        while lo < len(some):
            # lines of like length go together, so a batch is about as large as its padded grid
            hi = lo + 1
            while hi < len(some) and (hi + 1 - lo) * longer[some[hi]] <= GRID:
                hi += 1
            batch = some[lo:hi]
            out[batch] = within([a[i] for i in batch], [b[i] for i in batch], t)
            lo = hi
    return out


def within(a: list[str], b: list[str], most: int) -> np.ndarray:
    """Which pairs are within most edits: a band of 2 * most + 1 diagonals, one bit each, for all pairs at once."""
    n = len(a)
    la, lb = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    result = np.zeros(n, bool)
    if not n:
        return result
    order = np.argsort(lb, kind="stable")
    width = int(max(la.max(), lb.max())) + 2 * most + 2
    ga, gb = np.full((n, width + most), 0xFFFFFFFF, np.uint32), np.full((n, width), 0xFFFFFFFE, np.uint32)
    for r, i in enumerate(order.tolist()):
        ga[r, most : most + la[i]] = np.frombuffer(a[i].encode("utf-32-le"), "<u4")
        gb[r, : lb[i]] = np.frombuffer(b[i].encode("utf-32-le"), "<u4")
    la, lb = la[order], lb[order]
    full = (1 << (2 * most + 1)) - 1
    # bit d + most of state[e]: the first j + d code points of a and j of b are within e edits
    state = [np.full(n, sum(1 << (d + most) for d in range(e + 1)), np.int32) for e in range(most + 1)]
    shift = la - lb + most
    fits = (shift >= 0) & (shift <= 2 * most)
    done = 0
    for j in range(int(lb.max()) + 1):
        stop = int(np.searchsorted(lb, j, "right"))
        if stop > done:
            bit = np.clip(shift[done:stop], 0, 30).astype(np.int32)
            result[order[done:stop]] = ((state[most][done:stop] >> bit & 1) == 1) & fits[done:stop]
            done = stop
        if done == n:
            break
        equal = np.zeros(n - done, np.int32)
        for d in range(2 * most + 1):
            equal |= (ga[done:, j + d] == gb[done:, j]).astype(np.int32) << d
        last = None
        for e in range(most + 1):
            old = state[e][done:].copy()
            new = old & equal
            if e:
                new |= last[0] | (last[0] >> 1) | (last[1] << 1)
            new &= full
            state[e][done:] = new
            last = (old, new)
    return result


def dedupe_lines(docs: DataFrame, most: int = MOST, least: int = LEAST, id_col: str = "doc_id", text: str = "text", blocks: int | None = None) -> DataFrame:
    """docs with the text's removed lines taken out, and n_lines and n_removed_lines (which replace such columns).

    Lines are what lies between \\n; those without a word `[^\\x20\\x09-\\x0D]` stay. Another goes if an equal one starts
    earlier (smaller doc_id, or same document, earlier line). One of at least least code points also goes if it is the first of
    its text and there is a line of at least least code points whose first place is earlier, whether that one stays or not,
    with the same digits 0-9 in the same order, within as many edits as whole times least goes into the shorter one's length,
    most at most: lines are judged on the input. Lines left are joined by \\n. Null text stays null and counts no lines; a null doc_id comes before all others; rows that repeat a
    doc_id count in the order of their texts; an empty table gives an empty result; other columns pass unchanged.
    """
    count = blocks or block_count(docs, text)
    docs = docs.drop("n_lines", "n_removed_lines", "__block")
    dealt = docs.withColumn(text, F.col(text).cast("string")).withColumn("__block", F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(count)))

    def announce(table: pa.Table) -> pa.Table:
        b, block = Lines(table, id_col, text), table["__block"][0].as_py()
        first, h, g, again = b.distinct()
        to, rows = bucket_of(h, count), []
        cuts = np.flatnonzero(np.diff(to)) + 1
        doc = b.ids[b.row[first]].astype(np.int64)
        for lo, hi in zip([0, *cuts], [*cuts, len(to)], strict=True):
            if hi > lo:
                data = np.concatenate([h[lo:hi], g[lo:hi], doc[lo:hi].view(U)]).tobytes() + first[lo:hi].astype("<u4").tobytes()
                rows.append((1, int(to[lo]), block, None, None, None, None, None, None, data))
        if len(again):
            rows.append((3, block, block, None, None, None, None, None, None, again.astype("<u4").tobytes()))
        return messages(rows)

    def judge(table: pa.Table) -> pa.Table:
        """By block, its lines that an earlier one equals."""
        K.release()
        known = table.filter(pa.compute.equal(table["kind"], 3))
        rows = list(zip(known["block"].to_pylist(), [1] * known.num_rows, known["data"].to_pylist(), strict=True))
        table = table.filter(pa.compute.equal(table["kind"], 1))
        data = table["data"].to_pylist()
        sizes = [len(x) // 28 for x in data]
        if not data:
            return answers(rows)
        key, pr, doc = np.concatenate([np.frombuffer(x, U, 3 * n).reshape(3, n) for x, n in zip(data, sizes, strict=True)], axis=1)
        line = np.concatenate([np.frombuffer(x, "<u4", n, 24 * n) for x, n in zip(data, sizes, strict=True)])
        block = np.repeat(table["block"].to_numpy(), sizes)
        order = several(key)
        order = order[np.lexsort((doc.view(np.int64)[order], pr[order], key[order]))]
        gone = order[1:][(key[order[1:]] == key[order[:-1]]) & (pr[order[1:]] == pr[order[:-1]])]
        gone = gone[np.argsort(block[gone], kind="stable")]
        for at in np.split(gone, np.flatnonzero(np.diff(block[gone])) + 1):
            if len(at):
                rows.append((int(block[at[0]]), 1, line[at].tobytes()))
        return answers(rows)

    def read(table: pa.Table, kind: int) -> np.ndarray:
        """Lines that the answers of this kind name."""
        got = table.filter(pa.compute.equal(table["kind"], kind))["data"].to_pylist() if table.num_rows else []
        return np.frombuffer(b"".join(got), "<u4").astype(np.int64)

    def sign(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return messages([])
        b, block = Lines(left, id_col, text), left["__block"][0].as_py()
        chars = b.chars()
        own = np.zeros(len(chars), bool)
        own[b.told()] = True
        own &= chars >= least
        own[read(right, 1)] = False
        own = np.flatnonzero(own)
        ends = np.cumsum(chars[own])
        lo, held, rows = 0, [], []
        while lo < len(own):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + K.PIECE, "right")))
            part, lo = own[lo:hi], hi
            key, line, probe, profile = keys([b.text(x) for x in part], most, least)
            four = profile.reshape(len(part), -1, 4)
            counts = four[:, :, 0] | four[:, :, 1] << 2 | four[:, :, 2] << 4 | four[:, :, 3] << 6
            entry = (key << U(IDX_BITS)) | (part[line].astype(U) << U(1)) | probe.astype(U)
            held.append((bucket_of(key, count), entry, counts[line], b.ids[b.row[part]].astype("<f4")[line]))
            if lo == len(own) or sum(len(x[0]) for x in held) > ENTRIES:
                to, entry, counts, where = (np.concatenate(x) for x in zip(*held, strict=True))
                order, held = np.argsort(to, kind="stable"), []
                for at in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
                    if len(at):
                        rows.append((2, int(to[at[0]]), block, None, None, None, None, None, None, entry[at].tobytes() + counts[at].tobytes() + where[at].tobytes()))
        return messages(rows)

    low = (1 << IDX_BITS) - 1
    shared_schema = pa.schema([("bucket", pa.int64()), ("data", pa.binary())])

    def share(table: pa.Table) -> pa.Table:
        """Of a bucket's entries, those of keys that two lines have, one of them as an index key: key and probe bit, line, counts, place."""
        K.release()
        data, blocks = table["data"].to_pylist(), table["block"].to_pylist()
        sizes = [len(x) // 20 for x in data]
        e = np.concatenate([np.frombuffer(x, U, n) for x, n in zip(data, sizes, strict=True)])
        key = e >> U(IDX_BITS)
        order = several(key)
        ref = (np.repeat(np.array(blocks, np.int64), sizes) << np.int64(IDX_BITS)) | ((e & U(low)) >> U(1)).astype(np.int64)
        begin = np.flatnonzero(np.concatenate([[True], key[order[1:]] != key[order[:-1]]])) if len(order) else np.zeros(0, np.int64)
        if len(begin):
            asked = np.logical_or.reduceat((e[order] & U(1)) == 0, begin) & (np.minimum.reduceat(ref[order], begin) < np.maximum.reduceat(ref[order], begin))
            order = order[np.repeat(asked, np.diff(np.append(begin, len(order))))]
        counts = np.concatenate([np.frombuffer(x, np.uint8, 8 * n, 8 * n).reshape(n, 8) for x, n in zip(data, sizes, strict=True)])
        place = np.concatenate([np.frombuffer(x, "<f4", n, 16 * n) for x, n in zip(data, sizes, strict=True)])
        name, bucket = (key << U(1)) | (e & U(1)), table["bucket"][0].as_py()
        rows = [name[at].tobytes() + ref[at].tobytes() + counts[at].tobytes() + place[at].tobytes() for at in (order[i : i + ENTRIES] for i in range(0, len(order), ENTRIES))]
        return pa.Table.from_arrays([pa.array([bucket] * len(rows), pa.int64()), pa.array(rows, pa.binary())], schema=shared_schema)

    pair_schema = pa.schema([(x, pa.int64()) for x in ("short", "block_a", "idx_a", "block_b", "idx_b")])

    def meet(table: pa.Table) -> pa.Table:
        return met(table, FEW, None)

    def meet_rest(left: pa.Table, right: pa.Table) -> pa.Table:
        """All pairs of the lines that the first few have left undecided."""
        if not left.num_rows or not right.num_rows:
            return pair_schema.empty_table()
        return met(left, None, np.unique((right["block_a"].to_numpy() << IDX_BITS) | right["idx_a"].to_numpy()))

    def met(table: pa.Table, few: int | None, only: np.ndarray | None) -> pa.Table:
        K.release()
        data = table["data"].to_pylist()
        sizes = [len(x) // 28 for x in data]
        name, ref = np.concatenate([np.frombuffer(x, U, 2 * n).reshape(2, n) for x, n in zip(data, sizes, strict=True)], axis=1)
        counts = np.concatenate([np.frombuffer(x, np.uint8, 8 * n, 16 * n).reshape(n, 8) for x, n in zip(data, sizes, strict=True)])
        place = np.concatenate([np.frombuffer(x, "<f4", n, 24 * n) for x, n in zip(data, sizes, strict=True)])
        profile = np.stack([counts >> shift & 3 for shift in (0, 2, 4, 6)], axis=2).reshape(-1, CLASSES)
        got, short = candidates(name >> U(1), ref.view(np.int64), (name & U(1)).astype(bool), profile, most, place, few, only)
        got = np.unique(np.sort(got, axis=0), axis=1)
        cut = np.zeros(got.shape[1] + len(short), np.int64)
        cut[got.shape[1] :] = 1
        a, b = np.concatenate([got[0], short]), np.concatenate([got[1], np.full(len(short), table["bucket"][0].as_py() << IDX_BITS)])
        return pa.Table.from_arrays([pa.array(x) for x in (cut, a >> IDX_BITS, a & low, b >> IDX_BITS, b & low)], schema=pair_schema)

    line_schema = pa.schema([("block", pa.int64()), ("idx", pa.int64()), ("doc", pa.int64()), ("line", pa.string())])

    def fetch(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return line_schema.empty_table()
        b, block = Lines(left, id_col, text), left["__block"][0].as_py()
        line = np.unique(right["idx"].to_numpy())
        return pa.Table.from_arrays([pa.array(np.full(len(line), block)), pa.array(line), pa.array(b.ids[b.row[line]].astype(np.int64)), pa.array([b.text(x).decode("utf-8", "replace") for x in line], pa.string())], schema=line_schema)

    def verify(parts):
        for part in parts:
            ok = near_lines(part.column("line_a").to_pylist(), part.column("line_b").to_pylist(), most, least)
            yield from pa.Table.from_batches([part]).select(["block", "idx"]).filter(pa.array(ok)).to_batches()

    verdicts = dealt.groupBy("__block").applyInArrow(announce, MESSAGE).groupBy("bucket").applyInArrow(judge, ANSWER)
    sent = dealt.groupBy("__block").cogroup(verdicts.groupBy("block")).applyInArrow(sign, MESSAGE)
    shared = sent.groupBy("bucket").applyInArrow(share, "bucket long, data binary")
    refs = "short long, block_a long, idx_a long, block_b long, idx_b long"

    def decided(pairs: DataFrame) -> DataFrame:
        """(block, idx) of lines that are near to the earlier one of a pair."""
        pairs = pairs.select("block_a", "idx_a", "block_b", "idx_b").distinct()
        wanted = pairs.select(F.explode(F.array(F.struct(F.col("block_a").alias("block"), F.col("idx_a").alias("idx")), F.struct(F.col("block_b").alias("block"), F.col("idx_b").alias("idx")))).alias("w")).select("w.*").distinct()
        lines = dealt.groupBy("__block").cogroup(wanted.groupBy("block")).applyInArrow(fetch, "block long, idx long, doc long, line string")
        side = lambda x: lines.select(*[F.col(c).alias(f"{c}_{x}") for c in ("block", "idx", "doc", "line")])
        both = pairs.join(side("a"), ["block_a", "idx_a"]).join(side("b"), ["block_b", "idx_b"])
        # one document's lines are all in one block, where idx tells their order
        first_is_a = (F.col("doc_a") < F.col("doc_b")) | ((F.col("doc_a") == F.col("doc_b")) & (F.col("idx_a") < F.col("idx_b")))
        both = both.select(F.when(first_is_a, F.col("block_b")).otherwise(F.col("block_a")).alias("block"), F.when(first_is_a, F.col("idx_b")).otherwise(F.col("idx_a")).alias("idx"), "line_a", "line_b")
        return both.mapInArrow(verify, "block long, idx long").distinct()

    first = shared.groupBy("bucket").applyInArrow(meet, refs)
    near = decided(first.filter("short = 0"))
    left = first.filter("short = 1").select("block_a", "idx_a", F.col("block_b").alias("at"))
    left = left.join(near, (left.block_a == near.block) & (left.idx_a == near.idx), "left_anti")
    rest = shared.groupBy("bucket").cogroup(left.groupBy("at")).applyInArrow(meet_rest, refs)
    near = near.unionByName(decided(rest))

    def pack(table: pa.Table) -> pa.Table:
        return answers([(table["block"][0].as_py(), 2, table["idx"].to_numpy().astype("<u4").tobytes())])

    told = verdicts.unionByName(near.groupBy("block").applyInArrow(pack, ANSWER))
    columns = [f for f in dealt.schema if f.name != "__block"]
    schema = StructType([*columns, StructField("n_lines", LongType()), StructField("n_removed_lines", LongType())])
    names = [f.name for f in columns]

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            empty = left.select(names)
            return empty.append_column("n_lines", pa.array([], pa.int64())).append_column("n_removed_lines", pa.array([], pa.int64()))
        b = Lines(left, id_col, text)
        gone = np.zeros(len(b.start), bool)
        gone[read(right, 1)] = True
        gone[read(right, 2)] = True
        null = b.table[text].is_null().to_numpy()
        per = np.where(null, 0, b.per_row)
        removed = K.sums(gone, b.rows)
        texts, raw = [], b.data.tobytes()
        for r, n in enumerate(removed.tolist()):
            if null[r]:
                texts.append(None)
            elif n == 0:
                texts.append(raw[b.offsets[r] : b.offsets[r + 1]])
            else:
                kept = [i for i in range(b.rows[r], b.rows[r + 1]) if not gone[i]]
                texts.append(b"\n".join([raw[b.start[i] : b.end[i]] for i in kept]))
        column = pa.array(texts, pa.binary()).cast(b.table[text].type)
        table = b.table.select(names).set_column(names.index(text), text, column)
        return table.append_column("n_lines", pa.array(per.astype(np.int64))).append_column("n_removed_lines", pa.array(removed))

    return dealt.groupBy("__block").cogroup(told.groupBy("block")).applyInArrow(finish, schema)
