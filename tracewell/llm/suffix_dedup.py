"""Suffix-array dedup: removes every byte of a long repeat but the first, exactly.

A sparse suffix array: one suffix per run of windows, starting at the run's minimizer (see passages.py). Suffixes whose
prefix is contested are sorted where they arise, front-coded (length of the prefix shared with the suffix before, and the rest) and
exchanged by the hash of their first k bytes; each bucket merges its runs by a loser tree that compares suffixes only
beyond the prefix it knows to be shared. Runs of neighbours with a long common prefix, and equal bytes to the left of
the minimizer, are the repeated windows.

Buckets are by the prefix's hash and not by range: no later step needs one order over all buckets.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from .passages import NAMES, Block, bucket_of, masks, remove_repeats

U = np.uint64
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
OUT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def symbols(column):
    data, offsets = K.text_bytes(column)
    return data, offsets, None


def lcps(texts: list[bytes]) -> np.ndarray:
    """Bytes that each text shares with the one before it."""
    if not texts:
        return np.zeros(0, np.int64)
    size = np.array([len(x) for x in texts])
    width = int(size.max())
    grid = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in texts), np.uint8).reshape(len(texts), width)
    out = np.zeros(len(texts), np.int64)
    if len(texts) > 1:
        differ = grid[1:] != grid[:-1]
        out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        out[1:] = np.minimum(out[1:], np.minimum(size[1:], size[:-1]))
    return out


def front_coded(texts: list[bytes]) -> bytes:
    """Sorted texts as shared-prefix lengths, lengths of the rest, and the rests."""
    shared = lcps(texts)
    rest = [t[s:] for t, s in zip(texts, shared, strict=True)]
    return np.array([len(texts)], "<u4").tobytes() + shared.astype("<u2").tobytes() + np.array([len(r) for r in rest], "<u2").tobytes() + b"".join(rest)


def front_decoded(data: bytes) -> tuple[int, int, Iterator[tuple[bytes, int]]]:
    """How many texts there are, where they end in data, and the texts with their shared-prefix lengths, one after another."""
    n = int(np.frombuffer(data, "<u4", 1)[0])
    shared, size = np.frombuffer(data, "<u2", n, 4), np.frombuffer(data, "<u2", n, 4 + 2 * n)

    def texts() -> Iterator[tuple[bytes, int]]:
        at, last = 4 + 4 * n, b""
        for s, r in zip(shared.tolist(), size.tolist(), strict=True):
            last = last[:s] + data[at : at + r]
            at += r
            yield last, s

    return n, 4 + 4 * n + int(size.sum(dtype=np.int64)), texts()


def common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix, at of which is known."""
    end = min(len(a), len(b))
    step = 16
    while at < end and a[at : at + step] == b[at : at + step]:
        at += step
    at = min(at, end)
    while at < end and a[at] == b[at]:
        at += 1
    return at


def merge(runs: list[Iterator[tuple[bytes, int]]]) -> Iterator[tuple[int, int]]:
    """Merges sorted runs of (text, prefix shared with the one before); yields (run, prefix shared with the text yielded before).

    A loser tree; of each run only the head is held. A head carries the length of the prefix it shares with the last winner. Of
    two heads, the one with the longer prefix is the smaller, with nothing compared; only at equal lengths are bytes beyond it read.
    """
    n = len(runs)
    if n == 1:
        yield from ((0, s) for _, s in runs[0])
        return
    size = 1 << (n - 1).bit_length()
    nothing = (None, 0)
    head: list[bytes | None] = [next(r, nothing)[0] for r in runs] + [None] * (size - n)
    known = [0] * size
    losers = [0] * size

    def less(a: int, b: int) -> bool:
        """Whether head a goes before head b; the loser's known prefix becomes that shared with the winner."""
        x, y = head[a], head[b]
        if y is None:
            return True
        if x is None:
            return False
        p, q = known[a], known[b]
        if p != q:
            return p > q  # the loser shares with the winner what it shared with the last one
        p = common(x, y, p)
        first = a < b if p == len(x) == len(y) else p == len(x) or (p < len(y) and x[p] < y[p])
        known[b if first else a] = p
        return first

    winners = [0] * size + list(range(size))
    for node in range(size - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if less(a, b) else (b, a)
    win = winners[1]
    while head[win] is not None:
        yield win, known[win]
        head[win], known[win] = next(runs[win], nothing)
        node = (win + size) >> 1
        while node:
            other = losers[node]
            if not less(win, other):
                losers[node], win = win, other
            node >>= 1


def pack_for(n: int):
    def pack(b: Block, idx: np.ndarray, buckets: int, block: int) -> list[tuple]:
        """For each bucket a message with this block's sorted suffixes."""
        span = b.first[idx]
        start, anchor, end = b.start[span], b.anchor[span], b.start[span] + b.count[span] - 1 + n
        doc, to = b.ids[b.doc_of(start)], bucket_of(b.key[span], buckets)
        raw, rows = b.sym, []
        order = np.argsort(to, kind="stable")
        cuts = np.flatnonzero(np.diff(to[order])) + 1
        for group in np.split(order, cuts):
            right = [raw[anchor[i] : end[i]].tobytes() for i in group]
            by = sorted(range(len(group)), key=right.__getitem__)
            g = group[by]
            left = [raw[start[i] : anchor[i]].tobytes() for i in g]
            meta = np.stack([idx[g], doc[g], start[g], anchor[g] - start[g], b.count[span[g]]]).astype("<i8").tobytes()
            data = front_coded([right[i] for i in by]) + b"".join(left) + meta
            rows.append((2, int(to[g[0]]), block, len(g), None, None, None, None, None, data))
        return rows

    return pack


def method_for(n: int, k: int):
    width = n - k  # an anchor is at most so far into its window

    def method(table: pa.Table) -> list[tuple]:
        """Merges the bucket's runs and finds, per span, the windows that an earlier span has too."""
        runs, meta, grids = [], [], []
        for block, data in zip(table["block"].to_pylist(), table["data"].to_pylist(), strict=True):
            n_texts, at, texts = front_decoded(data)
            m = np.frombuffer(data[len(data) - 40 * n_texts :], "<i8").reshape(5, -1)
            # bytes to the left of the anchor, nearest first
            raw, ends = np.frombuffer(data, np.uint8, int(m[3].sum()), at), np.cumsum(m[3])
            place = ends[:, None] - 1 - np.arange(width)
            inside = np.arange(width) < m[3][:, None]
            grids.append(np.where(inside, raw[np.where(inside, place, 0)], 0).astype(np.uint8) if len(raw) else np.zeros((n_texts, width), np.uint8))
            meta.append(np.vstack([m, np.full((1, n_texts), block)]))
            runs.append(texts)
        sizes = [m.shape[1] for m in meta]
        base = np.cumsum([0, *sizes])
        run, lcp = np.fromiter((x for pair in merge(runs) for x in pair), np.int64, 2 * int(base[-1])).reshape(-1, 2).T
        # a run's texts come in their order
        order = np.argsort(run, kind="stable")
        merged = np.empty(len(run), np.int64)
        merged[order] = np.arange(len(run))
        idx, doc, start, head, count, block = np.concatenate(meta, axis=1)[:, merged]
        grid = np.concatenate(grids)[merged]
        mask, hashed = np.zeros(len(head), U), np.zeros(len(head), U)
        for off in range(width + 1):
            if off:
                hashed = K.mix(hashed + K.BYTE[grid[:, off - 1]])
            on = np.flatnonzero((head >= off) & (head - off < count))
            if len(on) < 2:
                continue
            same = np.cumsum(lcp < n - off)[on]
            # the same document's spans all come from one block, where start tells their order
            order = np.lexsort((start[on], doc[on], hashed[on], same))
            s, h = same[order], hashed[on][order]
            dup = np.zeros(len(on), bool)
            dup[1:] = (s[1:] == s[:-1]) & (h[1:] == h[:-1])
            hit = on[order[dup]]
            mask[hit] |= U(1) << (head[hit] - off).astype(U)
        return masks(block, idx, mask)

    return method


def cut_bytes(b: Block | None, covered: np.ndarray | None) -> pa.Table:
    if b is None:
        return OUT_SCHEMA.empty_table()
    lo, hi = b.offsets[:-1], b.offsets[1:]
    removed = K.sums(covered, b.offsets)
    edge = covered.copy()
    edge[1:] &= ~covered[:-1]
    inner = lo[lo < len(covered)]
    edge[inner] = covered[inner]
    spans = K.sums(edge, b.offsets)
    rest = b.sym[~covered]
    kept_at = np.concatenate([[0], np.cumsum(hi - lo - removed)])
    kept = pa.Array.from_buffers(pa.binary(), len(lo), [None, pa.py_buffer(kept_at.astype(np.int32).tobytes()), pa.py_buffer(rest.tobytes())])
    return pa.Table.from_arrays([b.table["doc_id"].combine_chunks(), pa.array(hi - lo), pa.array(removed), pa.array(spans), kept], schema=OUT_SCHEMA)


def remove_repeated_bytes(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text: str = "text", hot: int | None = None, blocks: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) per row of docs.

    Removes each UTF-8 byte that lies in a length-byte string which also starts earlier: in a smaller doc_id or, within
    one document, further left; strings never cross documents and are judged on the input. Null text counts as empty;
    texts shorter than length keep all bytes; a null doc_id comes before all others; rows that repeat a doc_id count in
    the order of their texts; an empty table gives an empty result; other columns are ignored. length is at least 42.
    """
    k = max(length * 2 // 5, length - 60)
    more = {"hot": hot} if hot else {}
    return remove_repeats(docs, symbols, cut_bytes, OUT, length, k, pack_for(length), method_for(length, k), id_col, text, blocks=blocks, **more)
