"""SentencePiece encoding and decoding of merge-type (BPE) models, exactly, by backtracking.

Merging picks, again and again, the best-scored piece that two neighbours form. Its result is the one segmentation in
which each adjacent pair of tokens, merged anew on its own, comes out as that same pair. So it is found left to right:
take the longest piece at a position (from an Aho-Corasick automaton), keep it if it goes with the token before, else
try shorter ones, else step back and mark the position as failed in a bitfield, so that no position fails twice.

No piece of the models in use spans the start of a run of spaces, so texts are cut there and each distinct part is
encoded once per worker (the table of parts has a bound and is emptied when full; another operator's task drops it). Narrow: nothing is shuffled.
"""

import heapq
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

SPACE = "▁"
PARTS = 250_000
#: Longer parts are rare and not kept.
PART_CHARS = 64
#: Bytes of text that are encoded together.
SLICE_BYTES = 1 << 20
OUT = "doc_id long, ids array<int>, decoded string"
OUT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])


class Pieces:
    """The vocabulary of one model file."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.rank: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.bytes_id = [0] * 256
        self.surface: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[1:-1], 16)
                self.bytes_id[value] = i
                self.surface.append(bytes([value]))
            elif model.is_control(i):
                self.surface.append(b"")
            elif model.is_unknown(i):
                self.surface.append(" ⁇ ".encode())
            else:
                self.surface.append(piece.replace(SPACE, " ").encode())
                if not model.is_unused(i):
                    self.id[piece] = i
                    self.rank[piece] = -model.get_score(i)
        self.automaton = ahocorasick.Automaton()
        for piece in self.id:
            self.automaton.add_word(piece, (len(piece) - 1, piece))
        self.automaton.make_automaton()
        self.single = {p for p in self.id if len(p) == 1}
        #: The longest piece that is a proper prefix of a piece.
        self.shorter: dict[str, str | None] = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in self.id), None) for p in self.id}
        self.pairs: dict[tuple[str, str], bool] = {}
        inner = any(SPACE in p.lstrip(SPACE) for p in self.id)
        breaks = any("\n" in p for p in self.id)
        if inner:
            self.part = re.compile(r"(?s).+")
        elif breaks:
            self.part = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        else:  # a line break is no piece: nothing merges over it
            self.part = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
        self.parts: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """Segmentation of a short text by merging; ties go to the left."""
        at = list(text)
        while True:
            best = min(((self.rank[p], i) for i in range(len(at) - 1) if (p := at[i] + at[i + 1]) in self.rank), default=None)
            if best is None:
                return at
            i = best[1]
            at[i : i + 2] = [at[i] + at[i + 1]]

    def goes(self, a: str, b: str) -> bool:
        """Whether the pair, merged anew, stays that pair."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > PARTS:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(a + b) == [a, b]
        return known

    def run(self, text: str) -> list[str]:
        """Segmentation of a text whose characters are all pieces."""
        longest: list[str] = list(text)
        for end, (n, piece) in self.automaton.iter(text):
            longest[end - n] = piece  # ends ascend, so the last for a start is the longest
        failed = 0  # the bitfield: positions from which every segmentation fails
        out: list[str] = []
        at, size, last = 0, len(text), None
        known, shorter = self.pairs, self.shorter
        token: str | None = longest[0]
        while True:
            end = at + len(token)
            if not failed >> end & 1:
                ok = last is None or known.get((last, token))
                if ok is None:
                    ok = self.goes(last, token)
                if ok:
                    out.append(token)
                    if end == size:
                        return out
                    at, last, token = end, token, longest[end]
                    continue
            token = shorter[token]
            while token is None:
                failed |= 1 << at
                last = out.pop()
                at -= len(last)
                token = shorter[last]
                last = out[-1] if out else None

    def encode_part(self, part: str) -> bytes:
        ids: list[int] = []
        if self.single.issuperset(part):
            ids = [self.id[p] for p in self.run(part)]
            return array("i", ids).tobytes()
        lo = 0
        for i in range(len(part) + 1):
            if i == len(part) or part[i] not in self.single:
                if i > lo:
                    ids += [self.id[p] for p in self.run(part[lo:i])]
                if i < len(part):  # a character that is no piece stands alone, as its bytes
                    ids += [self.bytes_id[b] for b in part[i].encode()]
                lo = i + 1
        return array("i", ids).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as 32-bit integers; a space stands before the text, as in the model's own encoding."""
        if not text:
            return b""
        parts, known = self.part.findall(SPACE + text.replace(" ", SPACE)), self.parts
        out = [known.get(p) for p in parts]
        if None in out:
            for i, ids in enumerate(out):
                if ids is None:
                    p = parts[i]
                    ids = out[i] = known.get(p) or self.encode_part(p)
                    if len(p) <= PART_CHARS:
                        if len(known) >= PARTS:
                            known.clear()
                        known[p] = ids
        return b"".join(out)

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 of the pieces, without the space put before the text."""
        if not ids:
            return b""
        out = b"".join([self.surface[i] for i in ids])
        return out[1:] if self.surface[ids[0]][:1] == b" " else out


def reference_merge(pieces: Pieces, text: str) -> list[str]:
    """The merge procedure on a whole text by a heap, for tests of run()."""
    at = list(text)
    nxt, prv = list(range(1, len(at) + 1)), list(range(-1, len(at) - 1))
    heap: list = []

    def push(i: int) -> None:
        j = nxt[i]
        if j < len(at) and (p := at[i] + at[j]) in pieces.rank:
            heapq.heappush(heap, (pieces.rank[p], i, p))

    for i in range(len(at) - 1):
        push(i)
    while heap:
        _, i, p = heapq.heappop(heap)
        j = nxt[i] if at[i] else len(at)
        if j < len(at) and at[i] + at[j] == p:
            at[i], at[j] = p, ""
            nxt[i] = nxt[j]
            if nxt[j] < len(at):
                prv[nxt[j]] = i
            if prv[i] >= 0:
                push(prv[i])
            push(i)
    return [x for x in at if x]


def pieces_of(path: str) -> Pieces:
    return K.kept(path, lambda: Pieces(path))


def encode_decode(docs: DataFrame, model: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string) per row of docs; model: a file that every executor can read.

    ids equal those of the model's own encoding without begin or end ids; decoded is the decoding of ids. Null text
    counts as empty and gives no ids; rows that repeat an id are encoded each; an empty table gives an empty result;
    other columns are ignored.
    """

    def run(batches):
        pieces = pieces_of(model)
        for part in batches:
            K.trim()
            for at, n in K.batches(part.column("text"), SLICE_BYTES):
                ids = [pieces.encode(t or "") for t in part.column("text").slice(at, n).to_pylist()]
                flat = np.frombuffer(b"".join(ids), np.int32)
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                back = pa.array([pieces.decode(np.frombuffer(x, np.int32).tolist()).decode("utf-8", "replace") for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").slice(at, n), pa.ListArray.from_arrays(offsets, pa.array(flat)), back], schema=OUT_SCHEMA)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, OUT)
