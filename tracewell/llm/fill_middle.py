"""Fill-in-middle transformation, with the two cuts found by overlapping chunks.

A token is a run of letters A-Z, a-z or any other single code point. Whether one begins at a byte depends on that byte and the one
before only, so a text is cut into chunks, each seeing one byte of the chunk before, whose boundaries are counted independently.
Prefix sums of the counts tell which chunk owns the token of a given rank, and only the chunks that own a cut are looked
at again. Narrow: nothing is shuffled, and no list of tokens is ever made.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K

CHUNK = 4096
#: Chunks that are counted in one step.
STEP = 256
BATCH_BYTES = 2 << 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
LETTER = np.zeros(256, bool)
LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
OUT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def begins(data: np.ndarray, lo: int, hi: int, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags of data[lo:hi]: a token begins, a code point begins. heads: ascending places where a text begins."""
    part = data[lo:hi]
    letter = LETTER[part]
    before = np.append(lo > 0 and LETTER[data[lo - 1]], letter[:-1])
    point = (part & 0xC0) != 0x80
    token = point & ~(letter & before)
    a, b = np.searchsorted(heads, (lo, hi))
    token[heads[a:b] - lo] = True
    return token, point


class Chunked:
    """Tokens and code points of the rows of a flat text, as prefix sums over chunks; no chunk crosses a row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        per = -(-np.diff(offsets) // CHUNK)
        self.first = np.concatenate([[0], np.cumsum(per)])  # a row's first chunk
        place = np.arange(self.first[-1]) - np.repeat(self.first[:-1], per)
        self.start = np.repeat(offsets[:-1], per) + place * CHUNK
        self.end = np.minimum(self.start + CHUNK, np.repeat(offsets[1:], per))
        self.heads = offsets[:-1][per > 0]
        counts = np.zeros((2, len(self.start) + 1), np.int64)
        for i in range(0, len(self.start), STEP):
            j = min(i + STEP, len(self.start))
            lo, hi = self.start[i], self.end[j - 1]
            for row, flags in zip(counts, begins(data, lo, hi, self.heads), strict=True):
                row[i + 1 : j + 1] = np.add.reduceat(flags, self.start[i:j] - lo, dtype=np.int64)
        self.tokens, self.points = np.cumsum(counts, axis=1)

    def sizes(self) -> np.ndarray:
        """Tokens of each row."""
        return self.tokens[self.first[1:]] - self.tokens[self.first[:-1]]

    def cut(self, row: int, rank: int) -> tuple[int, int]:
        """The byte where the row's token of this rank (from 0) begins, or the row ends; and the row's code points before it."""
        base = self.first[row]
        rank += self.tokens[base]
        if rank == self.tokens[self.first[row + 1]]:
            return int(self.offsets[row + 1]), int(self.points[self.first[row + 1]] - self.points[base])
        owner = int(np.searchsorted(self.tokens, rank, "right")) - 1
        lo = self.start[owner]
        token, point = begins(self.data, lo, self.end[owner], self.heads)
        at = np.flatnonzero(token)[rank - self.tokens[owner]]
        return int(lo + at), int(self.points[owner] - self.points[base] + np.count_nonzero(point[:at]))


def fill_in_middle(docs: DataFrame, seed: str = "1", whole: int = 90, spm: int = 20, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) per row of docs; n: tokens of the text.

    Four numbers h1 to h4 come from sha256 of "seed:doc_id". The text is cut before the tokens of ranks h1 and h2 modulo n + 1; form is
    plain if the text is empty or holds a marker, or if h3 % 100 >= whole; else spm if h4 % 100 < spm, else psm. output is
    the text, <P>prefix<S>suffix<M>middle (psm) or <S>suffix<P>prefix<M>middle (spm); prefix_chars and middle_chars count code
    points and are null if plain. Null text counts as empty, a null id as one of no digits; rows of one id are cut by the same
    numbers, each by its own text; texts of any length are taken whole; an empty table gives an empty result; other columns are ignored.
    """
    number = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.sha2(number, 256).alias("h"))
    base = base.select("doc_id", "text", *[F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)])
    marker = "|".join((PREFIX, SUFFIX, MIDDLE))
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))

    def run(batches):
        for batch in batches:
            for at, size in K.batches(batch.column("text"), BATCH_BYTES):
                part = batch.slice(at, size)
                data, offsets = K.text_bytes(part.column("text"))
                chunked, raw = Chunked(data, offsets), data.tobytes()
                n = chunked.sizes()
                h1, h2, h3, h4 = (part.column(f"h{i}").to_numpy() for i in (1, 2, 3, 4))
                marked = pc.match_substring_regex(part.column("text"), marker).to_numpy(zero_copy_only=False)
                form = np.where((n == 0) | marked | (h3 % 100 >= whole), "plain", np.where(h4 % 100 < spm, "spm", "psm"))
                low, high = np.sort([h1 % (n + 1), h2 % (n + 1)], axis=0)
                prefix, middle, out = [], [], []
                for i, (a, d) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                    if form[i] == "plain":
                        prefix.append(None)
                        middle.append(None)
                        out.append(raw[a:d])
                        continue
                    (b, before), (c, upto) = chunked.cut(i, int(low[i])), chunked.cut(i, int(high[i]))
                    prefix.append(before)
                    middle.append(upto - before)
                    out.append(b"".join((p, raw[a:b], s, raw[c:d], m, raw[b:c]) if form[i] == "psm" else (s, raw[c:d], p, raw[a:b], m, raw[b:c])))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n), pa.array(form.tolist(), pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())], schema=OUT_SCHEMA
                )

    return base.mapInArrow(run, OUT)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made from. Only an output that is not plain holds markers, one of each, so it splits at them."""
    parts = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    return F.when(F.col(form) == "plain", F.col(output)).otherwise(F.when(F.col(form) == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1])))
