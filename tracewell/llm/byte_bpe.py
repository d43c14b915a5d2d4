"""Byte-level BPE encoding and decoding of rank files, exactly, by a lazily determinised transducer.

Merging joins, again and again, the two neighbours whose joined bytes have the least rank. Its result is the one
sequence of tokens in which each adjacent pair, merged anew on its own, comes out as that same pair. So the merges
compile into a transducer over bytes: it walks the trie of tokens and, where one is complete and goes with the token
before, may end it there. Which of these choices hold shows a few bytes later, when the others have run out of trie.
Determinised, a state is the set of choices still open, each with the tokens it holds back; what all of them hold back
alike is emitted. States and moves are made when a text first needs them, and dropped together when there are too many.

Text is first cut as the libraries' pattern cuts it; here by classes of neighbouring code points, a batch at a time, so
nothing backtracks. Each distinct piece runs through the transducer once per worker (that table, too, has a bound). Decoding is streamed:
a state machine over UTF-8 tells, token by token, how far the bytes so far are whole characters. Narrow: nothing is shuffled.
"""

import base64
import gc
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

#: Moves of the transducer, pairs of tokens and pieces that a worker remembers.
MOVES, PAIRS, PIECES = 250_000, 250_000, 250_000
#: Longer pieces are rare and not kept.
PIECE_BYTES = 64
#: Tokens that decoding holds at once.
CHUNK = 4096
BATCH_BYTES = 1 << 20
NONE = -1
#: Fixed value: the endings that the pattern of the rank files takes off after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
LETTER, NUMBER, OTHER, BLANK = range(4)
OUT = "doc_id long, ids array<int>, decoded binary"
OUT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])


@cache
def classes() -> np.ndarray:
    """The class of each code point by the Unicode tables of the installed library, whose version Python's own need not match."""
    import tiktoken

    out = np.full(0x110000, OTHER, np.uint8)
    single = {bytes([b]): b for b in range(256)}
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (BLANK, r"\s")):
        finder = tiktoken.Encoding(f"class {kind}", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        for lo in range(0, 0x110000, 1 << 14):
            some = "".join(chr(c) for c in range(lo, lo + (1 << 14)) if not 0xD800 <= c < 0xE000)
            out[[ord(c) for c in bytes(finder.encode_ordinary(some)).decode()]] = kind
    return out


def piece_starts(points: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Flags the code points that begin a piece. rows: the first code point of each text, ascending; no piece crosses one."""
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    kind = classes()[points]
    first = np.zeros(n, bool)
    first[rows[rows < n]] = True
    last = np.append(first[1:], True)
    blank = kind == BLANK
    after_blank = np.append(False, blank[:-1]) & ~first
    start = first | np.append(True, kind[1:] != kind[:-1])
    # the last of a run of blanks goes with what follows if it is a space, and stands alone else
    start |= blank & ~last & ~np.append(blank[1:], True)
    after_space = after_blank & np.append(False, points[:-1] == 0x20)
    start &= ~(after_space & ~blank)
    # 's, 't, ... where an apostrophe begins a piece
    padded = np.concatenate([points, np.zeros(3, points.dtype)])
    for at in np.flatnonzero((points == ord("'")) & start).tolist():
        for ending in ENDINGS:
            end = at + 1 + len(ending)
            if end <= n and not first[at + 1 : end].any() and all(padded[at + 1 + i] == ord(c) for i, c in enumerate(ending)):
                start[at + 1 : end] = False
                if end < n:
                    start[end] = True
                break
    return start


class Node:
    """A node of the trie of tokens: the token that ends here and the nodes that follow."""

    __slots__ = ("token", "next")

    def __init__(self):
        self.token, self.next = NONE, {}


class Ranks:
    """The tokens of one rank file, their trie and the transducer."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.token: list[bytes] = [b""] * (max(self.rank.values()) + 1)
        self.root = Node()
        for token, rank in self.rank.items():
            self.token[rank] = token
            node = self.root
            for b in token:
                if b not in node.next:
                    node.next[b] = Node()
                node = node.next[b]
            node.token = rank
        self.split: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[bytes, bytes] = {}
        self.clear()
        #: Tokens that are whole, well-formed characters.
        self.whole = np.array([token.isascii() or token.decode("utf-8", "ignore").encode() == token for token in self.token])

    def clear(self) -> None:
        start = ((NONE, self.root, ()),)
        self.states: dict[tuple, int] = {start: 0}
        self.choices: list[tuple] = [start]
        self.ends: list[tuple] = [()]
        self.moves: dict[int, tuple[int, tuple]] = {}

    def merged(self, data: bytes, least: int = 1) -> list[bytes]:
        """Tokens of a short piece by merging, until so many are left; ties go to the left."""
        at, rank = [data[i : i + 1] for i in range(len(data))], self.rank
        while len(at) > least:
            best = min(((rank[p], i) for i in range(len(at) - 1) if (p := at[i] + at[i + 1]) in rank), default=None)
            if best is None:
                break
            i = best[1]
            at[i : i + 2] = [at[i] + at[i + 1]]
        return at

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge is the last that makes this one; None for a byte."""
        known = self.split.get(token, 0)
        if known == 0:
            data = self.token[token]
            parts = self.merged(data, 2) if len(data) > 1 else None
            known = self.split[token] = parts and tuple(self.rank[p] for p in parts)
        return known

    def goes(self, a: int, b: int) -> bool:
        """Whether token b can stand behind a (or first, if a is NONE): merged anew, they stay as they are.

        Merges go up in rank, so time is rank. Going back in time, the end of a and the start of b come apart, the later made first;
        the pair would have merged over the border if their joint rank came before either was taken up. Of equal ranks the left goes first.
        """
        pair = a << 32 | b
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[pair] = a == NONE or self.apart(a, b)
        return known

    def apart(self, a: int, b: int) -> bool:
        token, rank = self.token, self.rank
        until_a = until_b = len(token)
        while True:
            joint = rank.get(token[a] + token[b])
            if joint is not None and joint < until_a and joint <= until_b:
                return False
            of_a, of_b = self.halves(a), self.halves(b)
            if of_a and (not of_b or a > b):
                until_a, a = a, of_a[1]
            elif of_b:
                until_b, b = b, of_b[0]
            else:
                return True

    def move(self, state: int, byte: int) -> tuple[int, tuple]:
        """The state after a byte, and the tokens that are sure by then.

        What was read has one sequence of tokens, so one choice at most ends a token here; longer tokens are tried first.
        """
        out, end = [], None
        for last, node, held in self.choices[state]:
            node = node.next.get(byte)
            if node is not None:
                if node.next:
                    out.append((last, node, held))
                if end is None and node.token != NONE and self.goes(last, node.token):
                    end = (node.token, self.root, (*held, node.token))
        out.append(end)
        common = out[0][2]
        sure = len(common)
        if sure:
            for _, _, held in out:
                while held[:sure] != common[:sure]:
                    sure -= 1
        after = tuple([(last, node, held[sure:]) for last, node, held in out]) if sure else tuple(out)
        to = self.states.get(after)
        if to is None:
            to = self.states[after] = len(self.choices)
            self.choices.append(after)
            self.ends.append(after[-1][2])
        known = self.moves[state << 8 | byte] = (to, common[:sure])
        return known

    def run(self, data: bytes) -> list[int]:
        """The tokens of one piece."""
        rank = self.rank.get(data)
        if rank is not None:  # as the libraries do, should merging not lead to it
            return [rank]
        if len(self.moves) > MOVES:
            self.clear()
        state, out, moves = 0, [], self.moves
        for b in data:
            state, sure = moves.get(state << 8 | b) or self.move(state, b)
            if sure:
                out += sure
        return [*out, *self.ends[state]]

    def encode(self, column) -> tuple[list[bytes], np.ndarray]:
        """Per piece its ids as 32-bit integers, and the first piece of each row (one entry more)."""
        data, offsets = K.text_bytes(column)
        raw = data.tobytes()
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        start = piece_starts(points, np.searchsorted(lead, offsets[:-1]))
        begin = lead[start]
        cuts, known = [*begin.tolist(), len(raw)], self.pieces
        parts = [raw[a:b] for a, b in zip(cuts, cuts[1:])]  # noqa: B905
        out = [known.get(p) for p in parts]
        gc.disable()  # what is made here has no cycles, and looking for some took a quarter of the time
        for i, ids in enumerate(out):
            if ids is None:
                p = parts[i]
                ids = out[i] = known.get(p) or array("i", self.run(p)).tobytes()
                if len(p) <= PIECE_BYTES:
                    if len(known) >= PIECES:
                        known.clear()
                    known[p] = ids
        gc.enable()
        return out, np.searchsorted(begin, offsets)


#: The UTF-8 state machine: what may follow. START: a character may begin; the others: so many bytes are due, and which the next may be.
START, BAD = 0, -1
ONE, TWO, THREE, AFTER_E0, AFTER_ED, AFTER_F0, AFTER_F4 = range(1, 8)
#: Fixed values (Unicode's table of well-formed byte sequences): from state, first byte, last byte, to state.
WELL_FORMED = [
    (START, 0x00, 0x7F, START), (START, 0xC2, 0xDF, ONE), (START, 0xE0, 0xE0, AFTER_E0), (START, 0xE1, 0xEC, TWO), (START, 0xED, 0xED, AFTER_ED),
    (START, 0xEE, 0xEF, TWO), (START, 0xF0, 0xF0, AFTER_F0), (START, 0xF1, 0xF3, THREE), (START, 0xF4, 0xF4, AFTER_F4),
    (ONE, 0x80, 0xBF, START), (TWO, 0x80, 0xBF, ONE), (THREE, 0x80, 0xBF, TWO), (AFTER_E0, 0xA0, 0xBF, ONE), (AFTER_ED, 0x80, 0x9F, ONE),
    (AFTER_F0, 0x90, 0xBF, TWO), (AFTER_F4, 0x80, 0x8F, TWO),
]
STEP = {(state, b): to for state, lo, hi, to in WELL_FORMED for b in range(lo, hi + 1)}


def _run(data: bytes, state: int) -> tuple[int, int]:
    """The state after data, and the place after the last whole character; a byte that may not stand there begins anew."""
    done = 0
    for i, b in enumerate(data):
        to = STEP.get((state, b))
        if to is None:  # what was begun is ill-formed and ends before this byte, which is tried as a first one
            done, to = i, STEP.get((START, b))
            if to is None:
                done, to = i + 1, START
        state = to
        if state == START:
            done = i + 1
    return state, done


class StreamDecoder:
    """Text of ids that come in pieces: each call gives the characters that are whole by then, finish() what is left.

    Ill-formed bytes become U+FFFD, one for each part that no longer sequence could begin with, as codecs' "replace" does.
    """

    def __init__(self, ranks: Ranks):
        self.ranks, self.state, self.held = ranks, START, b""

    def feed(self, ids: list[int]) -> str:
        data = self.held + b"".join([self.ranks.token[i] for i in ids])
        self.state, self.held = START, b""
        try:
            return data.decode("utf-8")
        except UnicodeDecodeError as e:
            sound = e.start  # up to here all is well-formed; only the rest is gone through byte by byte
        self.state, done = _run(data[sound:], START)
        out, self.held = data[: sound + done], data[sound + done :]
        return out.decode("utf-8", "replace")

    def finish(self) -> str:
        out, self.held, self.state = self.held.decode("utf-8", "replace"), b"", START
        return out


_loaded: dict[str, Ranks] = {}


def ranks_of(path: str) -> Ranks:
    if path not in _loaded:
        _loaded[path] = Ranks(path)
    return _loaded[path]


def encode_decode(docs: DataFrame, ranks: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded binary) per row of docs; ranks: a rank file that every executor can read.

    ids are those of the library's encoding without special tokens; decoded is the decoding of ids, in UTF-8. Null text
    counts as empty and gives no ids; rows that repeat an id, or have none, are encoded each; texts of any length are taken whole;
    an empty table gives an empty result; other columns are ignored.
    """

    def run(batches):
        own = ranks_of(ranks)
        for part in batches:
            for at, n in K.batches(part.column("text"), BATCH_BYTES):
                pieces, first = own.encode(part.column("text").slice(at, n))
                ids = np.frombuffer(b"".join(pieces), np.int32)
                sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
                offsets = np.concatenate([[0], np.cumsum(sizes)])[first]
                texts = []
                for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    decoder = StreamDecoder(own)
                    chunks = [decoder.feed(ids[i : min(i + CHUNK, hi)].tolist()) for i in range(lo, hi, CHUNK)]
                    texts.append("".join([*chunks, decoder.finish()]).encode())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").slice(at, n), pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(ids)), pa.array(texts, pa.binary())], schema=OUT_SCHEMA
                )
        K.release()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, OUT)


def decode_ids(tokens: DataFrame, ranks: str, id_col: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, text) per row of tokens (doc_id, ids array<int>); null ids give null, ill-formed bytes U+FFFD. An id that is no token fails."""

    def run(batches):
        own = ranks_of(ranks)
        for part in batches:
            out = []
            for row in part.column("ids"):
                if not row.is_valid:
                    out.append(None)
                    continue
                values, decoder = row.as_py(), StreamDecoder(own)
                out.append("".join(decoder.feed(values[i : i + CHUNK]) for i in range(0, len(values), CHUNK)) + decoder.finish())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
