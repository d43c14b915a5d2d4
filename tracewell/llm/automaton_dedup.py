"""Substring dedup by suffix automata: removes long repeated runs of words.

Two uses share the automaton. Against a reference, shards of the reference of at most SHARD_WORDS words become automata that
are broadcast, round by round, and documents stream through them for matching statistics. Within a corpus the
reference is the corpus: broadcasting its shards would read all documents once for each of them, work that grows with the
square of the corpus. There a shard is dealt to a bucket and not to all: it holds the spans of one key (see passages.py), and the
only spans that can match it stream through it, first document first, and join it. All repeats are found by automata.

Words are compared by 64-bit hash, so two passages of different words count as equal with a chance of about 2**-64.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from .passages import Block, bucket_of, masks, remove_repeats

U = np.uint64
#: Words of a reference that is broadcast (an automaton has under two states for each).
REFERENCE_WORDS = 400_000
OUT = "doc_id long, n_words long, n_removed long, n_spans long, kept string"
OUT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.string())])


class SuffixAutomaton:
    """All substrings of the sequences added; grows online."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.size = [0]

    def _state(self, size: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.size.append(size)
        self.link.append(link)
        return len(self.size) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """The state for exactly those suffixes that end at q and are no longer than p's with c."""
        if self.size[q] == self.size[p] + 1:
            return q
        copy = self._state(self.size[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def add(self, sequence: list[int]) -> None:
        last = 0
        for c in sequence:
            p = last
            if c in self.next[p]:
                last = self._split(p, self.next[p][c], c)
                continue
            new = self._state(self.size[p] + 1, {}, 0)
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, self.next[p][c], c)
            last = new

    def matches(self, sequence: list[int], n: int) -> list[int]:
        """Starts of the n-symbol windows of sequence that the automaton has: where the matching statistic reaches n."""
        state, length, out = 0, 0, []
        nxt, link, size = self.next, self.link, self.size
        for end, c in enumerate(sequence):
            while state and c not in nxt[state]:
                state = link[state]
                length = size[state]
            if c in nxt[state]:
                state = nxt[state][c]
                length += 1
            else:
                length = 0
            if length >= n:
                out.append(end - n + 1)
        return out


def symbols(column):
    """A hash for each word, the first word of each row, and the words' places."""
    data, offsets = K.text_bytes(column)
    starts, ends, rows = K.words(data, offsets)
    return K.piece_hashes(data, starts, ends), rows, (data, starts, ends)


def pack_for(n: int):
    def pack(b: Block, idx: np.ndarray, buckets: int, block: int) -> list[tuple]:
        span = b.first[idx]
        doc, to = b.ids[b.doc_of(b.start[span])], bucket_of(b.key[span], buckets)
        return [
            (2, int(t), block, int(i), int(d), int(b.start[s]), 0, int(b.count[s]), int(b.key[s].view(np.int64)), b.sym[b.start[s] : b.start[s] + b.count[s] - 1 + n].tobytes())
            for i, s, d, t in zip(idx.tolist(), span, doc, to, strict=True)
        ]

    return pack


def method_for(n: int):
    def method(table: pa.Table) -> list[tuple]:
        # a document's spans all come from one block, where pos tells their order
        table = table.sort_by([("key", "ascending"), ("doc", "ascending"), ("pos", "ascending")])
        keys, data = table["key"].to_pylist(), table["data"]
        out = np.zeros(len(keys), U)
        automaton = None
        for i, key in enumerate(keys):
            if i == 0 or key != keys[i - 1]:
                automaton = SuffixAutomaton()
            words = np.frombuffer(data[i].as_py(), U).tolist()
            found = automaton.matches(words, n)
            for start in found:
                out[i] |= U(1) << U(start)
            # a span whose windows the automaton all has adds none
            if i + 1 < len(keys) and keys[i + 1] == key and len(found) < len(words) - n + 1:
                automaton.add(words)
        return masks(table["block"].to_numpy(), table["idx"].to_numpy(), out)

    return method


def kept_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, covered: np.ndarray) -> pa.Array:
    """Each row's words that are not covered, joined by one space."""
    kept = np.flatnonzero(~covered)
    out = []
    raw = data.tobytes()
    cut = np.searchsorted(kept, rows)
    s, e = starts.tolist(), ends.tolist()
    kept = kept.tolist()
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if hi > lo and hi - lo == kept[hi - 1] - kept[lo] + 1:  # nothing between them goes
            out.append(b" ".join(raw[s[kept[lo]] : e[kept[hi - 1]]].split()))  # bytes.split() knows the same six spaces
        else:
            out.append(b" ".join([raw[s[i] : e[i]] for i in kept[lo:hi]]))
    return pa.array(out, pa.binary()).cast(pa.string())


def cut_words(b: Block | None, covered: np.ndarray | None) -> pa.Table:
    if b is None:
        return OUT_SCHEMA.empty_table()
    return word_rows(b.table["doc_id"].combine_chunks(), b.extra, b.offsets, covered)


def word_rows(ids: pa.Array, places, rows: np.ndarray, covered: np.ndarray) -> pa.Table:
    removed = np.concatenate([[0], np.cumsum(covered)])
    edge = covered.copy()
    edge[1:] &= ~covered[:-1]
    at = rows[:-1][rows[:-1] < len(covered)]
    edge[at] = covered[at]
    spans = np.concatenate([[0], np.cumsum(edge)])
    lo, hi = rows[:-1], rows[1:]
    return pa.Table.from_arrays([ids, pa.array(hi - lo), pa.array(removed[hi] - removed[lo]), pa.array(spans[hi] - spans[lo]), kept_words(*places, rows, covered)], schema=OUT_SCHEMA)


def remove_repeated_words(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text: str = "text", hot: int | None = None, blocks: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, n_spans, kept string) per row of docs.

    Removes each word that lies in a run of window words which also starts earlier: in a smaller doc_id or, within one
    document, further left; runs never cross documents and are judged on the input. Words are `[^\\x20\\x09-\\x0D]+`,
    unchanged; kept joins the words left by one space. Null text counts as empty; shorter texts keep all words; a null
    doc_id comes before all others; rows that repeat a doc_id count in the order of their texts; an empty table gives an
    empty result; other columns are ignored. window is at least 5.
    """
    k = max(window * 2 // 5, window - 60)
    more = {"hot": hot} if hot else {}
    return remove_repeats(docs, symbols, cut_words, OUT, window, k, pack_for(window), method_for(window), id_col, text, blocks=blocks, **more)


def remove_reference_words(docs: DataFrame, reference: DataFrame, window: int = 20, id_col: str = "doc_id", text: str = "text", reference_text: str = "text", shards: int = 4) -> DataFrame:
    """As remove_repeated_words, for runs of words that the reference has; documents are not held against each other.

    The reference is at most REFERENCE_WORDS words, which is checked; its shards' automata are broadcast.
    """
    from pyspark.sql import functions as F

    size = reference.agg(F.sum(F.regexp_count(reference_text, F.lit(r"[^\x20\x09-\x0D]+")))).first()[0] or 0
    if size > REFERENCE_WORDS:
        raise ValueError(f"the reference has {size} words; {REFERENCE_WORDS} at most are broadcast: hold the corpus against it with remove_repeated_words")
    texts = [r[0] for r in reference.select(F.col(reference_text).cast("string")).collect()]
    automata = [SuffixAutomaton() for _ in range(shards)]
    for i, t in enumerate(texts):
        automata[i % shards].add(symbols(pa.array([t], pa.string()))[0].tolist())
    shared = docs.sparkSession.sparkContext.broadcast([(a.next, a.link, a.size) for a in automata])

    def run(parts):
        held = []
        for n, link, size in shared.value:
            a = SuffixAutomaton()
            a.next, a.link, a.size = n, link, size
            held.append(a)
        for part in parts:
            sym, rows, places = symbols(part.column("text"))
            steps = np.zeros(len(sym) + 1, np.int64)
            for lo, hi in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
                seq = sym[lo:hi].tolist()
                for a in held:
                    for s in a.matches(seq, window):
                        steps[lo + s] += 1
                        steps[lo + s + window] -= 1
            yield from word_rows(part.column("doc_id"), places, rows, np.cumsum(steps[:-1]) > 0).to_batches()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, OUT)
