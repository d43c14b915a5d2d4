"""Repeated windows of n symbols across a corpus, exactly, without an all-pairs step.

Used by the suffix-array operator (symbols are bytes) and the suffix-automaton operator (symbols are words).

1. Documents are dealt into blocks. A block turns each document into spans: runs of windows that share their
   minimizer k-gram. Two equal windows have equal minimizers at the same place, so they lie in spans of one key.
2. A block sends each distinct (key, print of the span) once, with its least document id, to a bucket by key. The
   bucket answers which spans share their key with another block's span, or with another span of their block: only
   those can hold a repeat. This is a filter on prefixes; it decides nothing about repeats.
3. Those spans go to the buckets again, with their symbols, where the operator's own method says which of their
   windows occur earlier. A key with more than HOT spans would fill one task: its spans go window by window, to buckets by
   the window's own hash, and through the same method.
4. Blocks mark the windows found and cut the symbols that they cover.

Only counts reach the driver. All steps are deterministic functions of the blocks, so lost tasks can rerun.
"""

import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from .blocks import block_count, by_id, in_blocks

U = np.uint64
#: Spans of one key that a task takes together.
HOT = 4000
CONTESTED, SPLIT = 2, 3
#: Buckets for each block in which spans meet with their symbols, which take more room than the text they are of.
SPREAD = 2
MESSAGE = "kind int, bucket long, block long, idx long, doc long, pos long, head int, count int, key long, data binary"
NAMES = [x.split()[0] for x in MESSAGE.split(", ")]
TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
SCHEMA = pa.schema(list(zip(NAMES, TYPES, strict=True)))
ANSWER = "block long, kind int, data binary"
ANSWERS = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])


def messages(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(TYPES)], schema=SCHEMA)


def answers(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(ANSWERS)], schema=ANSWERS)


class Block:
    """Spans of one block; which of them are the block's first of their print."""

    def __init__(self, table: pa.Table, unit, n: int, k: int):
        K.release()
        self.table = by_id(table)
        self.sym, self.offsets, self.extra = unit(self.table["text"])
        ids = self.table["doc_id"]
        self.ids = pa.compute.fill_null(ids, np.iinfo(np.int64).min).to_numpy()
        s = K.window_spans(self.sym, self.offsets, n, k)
        self.start, self.count, self.anchor, self.key, self.print = (s[x] for x in ("start", "count", "anchor", "key", "print"))
        order = np.lexsort((self.start, self.print, self.key))
        key, pr = self.key[order], self.print[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (pr[1:] != pr[:-1])
        #: Distinct spans, by key and print: the index of the first.
        self.first = order[fresh]
        self.again = np.ones(len(order), bool)
        self.again[self.first] = False

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, at, "right") - 1

    def send(self, block: int, buckets: int, kind: int, key: np.ndarray, pr: np.ndarray, doc: np.ndarray) -> list[tuple]:
        """One message for each bucket; key is sorted."""
        to = bucket_of(key, buckets)
        cuts = np.flatnonzero(np.diff(to)) + 1
        rows = []
        for lo, hi in zip([0, *cuts], [*cuts, len(key)], strict=True):
            if hi > lo:
                data = np.concatenate([key[lo:hi], pr[lo:hi], doc[lo:hi].view(U)]).tobytes()
                rows.append((kind, int(to[lo]), block, int(lo), None, None, None, None, None, data))
        return rows


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


def shared(rows: pa.Table, hot: int) -> list[tuple]:
    """For messages of one bucket: (block, indices and verdicts) of the spans whose key another span has."""
    blocks, base = rows["block"].to_numpy(), rows["idx"].to_numpy()
    parts = [np.frombuffer(x, U).reshape(3, -1)[0] for x in rows["data"].to_pylist()]
    sizes = np.array([len(p) for p in parts])
    key, row = np.concatenate(parts), np.repeat(np.arange(len(parts)), sizes)
    idx = np.arange(len(key)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + base[row]
    _, inverse, many = np.unique(key, return_inverse=True, return_counts=True)
    many = many[inverse]
    verdict = np.where(many > hot, SPLIT, np.where(many > 1, CONTESTED, 0))
    keep = verdict > 0
    order = np.argsort(blocks[row[keep]], kind="stable")
    at, idx, verdict = blocks[row[keep]][order], idx[keep][order], verdict[keep][order]
    cuts = np.flatnonzero(np.diff(at)) + 1
    return [(int(at[lo]), np.concatenate([idx[lo:hi].astype(U), verdict[lo:hi].astype(U)]).tobytes()) for lo, hi in zip([0, *cuts], [*cuts, len(at)], strict=True) if hi > lo]


def masks(block: np.ndarray, idx: np.ndarray, mask: np.ndarray) -> list[tuple]:
    """Rows (block, data) that say which windows of which spans occur earlier."""
    keep = mask != 0
    block, idx, mask = block[keep], idx[keep], mask[keep]
    order = np.argsort(block, kind="stable")
    block, idx, mask = block[order], idx[order], mask[order]
    cuts = np.flatnonzero(np.diff(block)) + 1
    return [(int(block[lo]), np.concatenate([idx[lo:hi].astype(U), mask[lo:hi]]).tobytes()) for lo, hi in zip([0, *cuts], [*cuts, len(block)], strict=True) if hi > lo]


def split_windows(b: Block, spans: np.ndarray, n: int) -> tuple[Block, np.ndarray, np.ndarray]:
    """The block's distinct windows of these spans, as spans of one window; and, of all of them, place and distinct window."""
    count = b.count[spans]
    span = np.repeat(spans, count)
    at = b.start[span] + np.arange(len(span)) - np.repeat(np.cumsum(count) - count, count)
    value = np.zeros(len(at), U)
    for lo in range(0, len(b.sym), K.PIECE):
        here = np.flatnonzero((at >= lo) & (at < lo + K.PIECE))
        if len(here):
            part = b.sym[lo : lo + K.PIECE + n]
            sums = K.prefix(K.BYTE[part] if part.dtype == np.uint8 else part)
            value[here] = K.ranges(sums, at[here] - lo, at[here] - lo + n)
    value = K.mix(value)
    order = np.lexsort((at, value))
    value, at = value[order], at[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = value[1:] != value[:-1]
    w = copy.copy(b)
    w.start = w.anchor = at[fresh]
    w.key, w.count, w.first = value[fresh], np.ones(int(fresh.sum()), np.int64), np.arange(int(fresh.sum()))
    return w, at, np.cumsum(fresh) - 1


def remove_repeats(docs: DataFrame, unit, cut, out_schema: str, n: int, k: int, pack, method, id_col: str = "doc_id", text: str = "text", hot: int = HOT, blocks: int | None = None) -> DataFrame:
    """Marks every symbol that an n-symbol window covers that also starts earlier, and returns what cut makes of it.

    unit: text column -> (symbols, row offsets, whatever cut needs). pack: (Block, span indices, bucket count, block)
    -> messages with the contested spans' symbols. method: messages of one bucket -> masks(). cut: (Block, covered
    symbols) -> Arrow table of out_schema. k: length of the minimizer's k-gram; n - k < 64.
    """
    assert 0 < n - k < 64
    count = blocks or block_count(docs, text)
    dealt = in_blocks(docs, count, id_col, text)

    def announce(table: pa.Table) -> pa.Table:
        b = Block(table, unit, n, k)
        doc = b.ids[b.doc_of(b.start[b.first])] if len(b.first) else np.zeros(0, np.int64)
        return messages(b.send(table["block"][0].as_py(), count, 1, b.key[b.first], b.print[b.first], doc))

    def judge(table: pa.Table) -> pa.Table:
        K.release()
        return answers([(block, 1, data) for block, data in shared(table, hot)])

    verdicts = dealt.groupBy("block").applyInArrow(announce, MESSAGE).groupBy("bucket").applyInArrow(judge, ANSWER)

    def read(table: pa.Table, kind: int) -> np.ndarray:
        got = table.filter(pa.compute.equal(table["kind"], kind))["data"].to_pylist() if table.num_rows else []
        return np.concatenate([np.frombuffer(x, U).reshape(2, -1) for x in got], axis=1) if got else np.zeros((2, 0), U)

    def split(b: Block, got: np.ndarray):
        return split_windows(b, np.sort(b.first[got[0][got[1] == SPLIT].astype(np.int64)]), n)

    def contest(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return messages([])
        block = left["block"][0].as_py()
        got = read(right, 1)
        if not (got[1] >= CONTESTED).any():
            return messages([])
        b = Block(left, unit, n, k)
        rows = []
        spans = np.sort(got[0][got[1] == CONTESTED].astype(np.int64))
        if len(spans):
            rows += pack(b, spans, SPREAD * count, block)
        if (got[1] == SPLIT).any():
            w, _, _ = split(b, got)
            rows += [(3, *r[1:]) for r in pack(w, w.first, SPREAD * count, block)]
        return messages(rows)

    def decide(table: pa.Table) -> pa.Table:
        K.release()
        kinds, rows = table["kind"].to_numpy(), []
        for kind in (2, 3):
            if (kinds == kind).any():
                rows += [(block, kind, data) for block, data in method(table.filter(pa.array(kinds == kind)))]
        K.release()
        return answers(rows)

    fought = dealt.groupBy("block").cogroup(verdicts.groupBy("block")).applyInArrow(contest, MESSAGE)
    found = fought.groupBy("bucket").applyInArrow(decide, ANSWER)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return cut(None, None)
        b = Block(left, unit, n, k)
        got = read(right, 1)
        steps = np.zeros(len(b.sym) + 1, np.int32)

        def cover(first: np.ndarray, windows) -> None:
            np.add.at(steps, first, 1)
            np.add.at(steps, first + windows - 1 + n, -1)

        cover(b.start[b.again], b.count[b.again])
        idx, mask = read(right, 2)
        span = b.first[idx.astype(np.int64)]
        for w in range(n - k + 1 if len(idx) else 0):
            on = (mask >> U(w) & U(1)).astype(bool)
            cover(b.start[span[on]] + w, 1)
        if (got[1] == SPLIT).any():
            w, at, which = split(b, got)
            early = np.zeros(len(w.first), bool)
            early[read(right, 3)[0].astype(np.int64)] = True
            again = np.ones(len(at), bool)
            again[np.searchsorted(which, w.first)] = False
            cover(at[again | early[which]], 1)
        return cut(b, np.cumsum(steps[:-1], out=steps[:-1]) > 0)

    both = verdicts.unionByName(found)
    return dealt.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(finish, out_schema)
