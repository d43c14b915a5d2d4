"""Numpy kernels over whole Arrow text columns: bytes, words, polynomial hashes, window minimizers.

Everything here is a pure function of one batch or block that a Spark task holds. Hashes are 64-bit; rolling ones are
polynomials modulo 2**64 over mixed symbols, and serve windows of some hundred symbols at most.
"""

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Elements that a hashing step holds at once; longer input is cut where it may be cut.
PIECE = 1 << 18
#: Bytes that one polynomial covers in a hash of a byte range.
PART = 64
try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # not every C library has it
    _trim = None
_powers: dict[int, np.ndarray] = {}
_kept: dict[str, object] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit (splitmix64's finalizer)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE = mix(np.arange(1, 257, dtype=U))


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2**64."""
    if base not in _powers or len(_powers[base]) <= n:
        p = np.full(max(n, PIECE + 4096) + 1, base, U)
        p[0] = 1
        p = np.cumprod(p)
        if n > 4 * PIECE:
            return p
        _powers[base] = p
    return _powers[base]


def prefix(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(len(values))[: len(values)], out=out[1:])
    return out


def ranges(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end], from prefix(values); alike for alike content wherever it stands."""
    return (sums[end] - sums[start]) * powers(len(sums), INVERSE)[start]


def kept(key: str, make):
    """What make() gives, kept in this worker from task to task until another operator's task calls release()."""
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def trim() -> None:
    """Gives freed memory back to the system; Python workers live on and would keep their peak."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def release() -> None:
    """trim(), without what another operator has kept."""
    _kept.clear()
    trim()


def sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many flags are set from at[i] to at[i + 1]; a row at a time, so no count per element is held."""
    return np.fromiter((np.count_nonzero(flags[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)), np.int64, len(at) - 1)


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the offsets of each row; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word `[^\\x20\\x09-\\x0D]+`, and the first word of each row (one entry more)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    edge = inside.copy()
    edge[1:] &= ~inside[:-1]
    at = offsets[:-1][offsets[:-1] < len(data)]
    edge[at] = inside[at]
    starts = np.flatnonzero(edge)
    edge = inside
    last = edge.copy()
    last[:-1] &= ~inside[1:]
    at = offsets[1:] - 1
    at = at[at >= 0]
    last[at] = inside[at]
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def piece_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """Mixed hash of each byte range; the ranges are in order and do not overlap. Another salt is another hash.

    Polynomials modulo 2**64 clash on long strings of a known kind, so a range is cut into parts of PART bytes, whose
    polynomials are mixed with their places before they are summed.
    """
    parts = np.maximum(1, -(-(ends - starts) // PART))
    first = np.cumsum(parts) - parts
    place = np.arange(int(parts.sum())) - np.repeat(first, parts)
    lo = np.repeat(starts, parts) + place * PART
    hi = np.minimum(lo + PART, np.repeat(ends, parts))
    out = np.zeros(len(lo), U)
    i = 0
    while i < len(lo):
        j = max(i + 1, int(np.searchsorted(hi, lo[i] + PIECE, "right")))
        at = lo[i]
        sums = prefix(BYTE[data[at : hi[j - 1]] ^ np.uint8(salt)])
        out[i:j] = ranges(sums, lo[i:j] - at, hi[i:j] - at) + (hi[i:j] - lo[i:j]).astype(U)
        i = j
    out = mix(out ^ mix(place.astype(U) + U(salt << 32)))
    return mix(np.add.reduceat(out, first)) if len(out) else out


def batches(column, size: int = 4 << 20):
    """(first row, rows) such that a batch holds about size bytes and one row at least."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    i = 0
    while i < len(lengths):
        before = ends[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(ends, before + size, "right")))
        yield i, j - i
        i = j


def window_spans(sym: np.ndarray, offsets: np.ndarray, n: int, k: int) -> dict[str, np.ndarray]:
    """Runs of consecutive n-symbol windows of one row that share their minimizer.

    A window's minimizer is its leftmost k-gram of least hash, so equal windows have it at the same place. A run has
    start (of its first window), count (of windows), anchor (place of the minimizer), key (the k-gram's hash) and
    print (hash of all symbols that the windows cover, with the anchor's place in them).
    """
    w, out = n - k + 1, {x: [] for x in ("start", "count", "anchor", "key", "print")}
    cuts = offsets[1:-1]
    low = U((1 << 20) - 1)
    for lo in range(0, len(sym), PIECE):
        m = min(lo + PIECE + n - 1, len(sym)) - lo
        if m < n:
            break
        part = sym[lo : lo + m]
        sums = prefix(BYTE[part] if part.dtype == np.uint8 else part)
        inv = powers(m, INVERSE)
        grams = mix((sums[k:] - sums[:-k]) * inv[: m - k + 1])
        best, size = (grams & ~low) | np.arange(m - k + 1, dtype=U), 1
        while size * 2 <= w:
            best = np.minimum(best[:-size], best[size:])
            size *= 2
        if w > size:
            best = np.minimum(best[: len(best) - (w - size)], best[w - size :])
        place = (best & low).astype(np.int64)
        b = cuts[np.searchsorted(cuts, lo, "right") : np.searchsorted(cuts, lo + m)] - lo
        d = np.bincount(np.maximum(b - n + 1, 0), minlength=m + 1)[: m + 1] - np.bincount(b, minlength=m + 1)[: m + 1]
        good = np.cumsum(d)[: len(place)] == 0
        fresh = good.copy()
        fresh[1:] &= ~good[:-1] | (place[1:] != place[:-1])
        first = np.flatnonzero(fresh)
        if not len(first):
            continue
        stop = np.append(first[1:], len(place))
        gaps = np.flatnonzero(~good)
        if len(gaps):
            at = np.searchsorted(gaps, first)
            stop = np.minimum(stop, np.where(at < len(gaps), gaps[np.minimum(at, len(gaps) - 1)], len(place)))
        anchor = place[first]
        whole = (sums[stop - 1 + n] - sums[first]) * inv[first]
        out["start"].append(first + lo)
        out["count"].append(stop - first)
        out["anchor"].append(anchor + lo)
        out["key"].append(grams[anchor])
        out["print"].append(mix(whole + U(BASE) * ((stop - first).astype(U) * U(4096) + (anchor - first).astype(U) + U(1))))
    kinds = {"key": U, "print": U}
    return {x: np.concatenate(v) if v else np.zeros(0, kinds.get(x, np.int64)) for x, v in out.items()}
