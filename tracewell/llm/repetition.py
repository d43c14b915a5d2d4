"""Quality rules by repetition coverage: characters inside duplicated n-grams and lines, from rolling hashes.

One narrow pass: each document is judged from its own text, so nothing is shuffled and no document waits for another.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

U = np.uint64
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: Words of a repeated window that the base rule counts.
WINDOW = 3
#: Greatest share of characters inside duplicated n-grams, by n; in the text as a whole, counting each once.
NGRAM_SHARES = {5: 0.15, 7: 0.13, 10: 0.10}
#: Greatest share of characters in lines equal to an earlier line.
LINE_SHARE = 0.30
LEAST_WORDS = 50
#: Greatest percentage of words in repeated windows.
REPEAT_PERCENT = 50
#: Bytes of text that are measured together, which takes some forty times as much memory.
SLICE_BYTES = 1 << 20

OUT_SCHEMA = pa.schema(
    [("doc_id", pa.int64())]
    + [(x, pa.int64()) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [(x, pa.float64()) for x in (*(f"dup_{n}gram_share" for n in NGRAM_SHARES), "dup_line_share")]
    + [("base_failed", pa.bool_()), ("kept", pa.bool_())]
)
OUT = ", ".join(f"{f.name} {({'int64': 'long', 'double': 'double', 'bool': 'boolean'})[str(f.type)]}" for f in OUT_SCHEMA)


def sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of flags from at[i] to at[i + 1]."""
    c = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return c[at[1:]] - c[at[:-1]]


def seen_twice(hashed: np.ndarray) -> np.ndarray:
    """Which values occur more than once."""
    if len(hashed) < 2:
        return np.zeros(len(hashed), bool)
    s = np.sort(hashed)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return np.zeros(len(hashed), bool)
    at = np.searchsorted(twice, hashed)
    return twice[np.minimum(at, len(twice) - 1)] == hashed


def measure(ids: pa.Array, column) -> pa.RecordBatch:
    """All measures of one batch of rows."""
    data, offsets = K.text_bytes(column)
    starts, ends, rows = K.words(data, offsets)
    n_words = np.diff(rows)
    row_of = np.repeat(np.arange(len(n_words)), n_words)
    # code points: bytes that do not continue one
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = points[ends] - points[starts]
    word_chars = sums(chars, rows)
    hashed = K.piece_hashes(data, starts, ends)
    salt = K.mix(np.arange(1, len(n_words) + 1, dtype=U))[row_of] if len(row_of) else np.zeros(0, U)
    prefix = K.prefix(hashed) if len(hashed) <= 4 * K.PIECE else None

    def covered(n: int) -> np.ndarray:
        """Which words lie in an n-word window found twice or more in their text."""
        m = len(hashed) - n + 1
        if m <= 0:
            return np.zeros(len(hashed), bool)
        if prefix is not None:
            window = K.ranges(prefix, np.arange(m), np.arange(n, len(hashed) + 1))
        else:  # a very long text: no table of powers as long
            window = np.zeros(m, U)
            for i in range(n):
                window = K.mix(window + hashed[i : i + m])
        inside = row_of[n - 1 :] == row_of[:m]
        at = np.flatnonzero(inside)
        at = at[seen_twice(K.mix(window[at]) ^ salt[at])]
        steps = np.zeros(len(hashed) + 1, np.int64)
        steps[at] += 1
        steps[at + n] -= 1
        return np.cumsum(steps[:-1]) > 0

    n_repeat = sums(covered(WINDOW), rows)
    least = np.maximum(word_chars, 1)
    shares = {n: sums(chars * covered(n), rows) / least for n in NGRAM_SHARES}

    # lines: those that hold a word, in order; the first of equal ones within a row is no duplicate
    breaks = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    line_start = line_start[line_start < len(data)]
    line_row = np.searchsorted(offsets, line_start, "right") - 1
    line_end = np.minimum(np.append(line_start[1:], len(data)), offsets[line_row + 1])
    has_break = (line_end > line_start) & (data[np.maximum(line_end - 1, 0)] == 10) if len(data) else np.zeros(0, bool)
    line_end = line_end - has_break
    first_word = np.searchsorted(starts, line_start)
    words_in = np.searchsorted(starts, line_end) - first_word
    on = np.flatnonzero(words_in > 0)
    line_hash = K.piece_hashes(data, line_start[on], line_end[on]) ^ K.mix(line_row[on].astype(U) + U(1 << 40))
    order = np.argsort(line_hash, kind="stable")
    dup = np.zeros(len(on), bool)
    dup[order[1:]] = line_hash[order[1:]] == line_hash[order[:-1]]
    n_dup = np.bincount(line_row[on][dup], minlength=len(n_words))
    run = np.concatenate([[0], np.cumsum(chars)])
    line_chars = run[first_word[on] + words_in[on]] - run[first_word[on]]
    line_share = np.bincount(line_row[on][dup], weights=line_chars[dup], minlength=len(n_words)) / least

    failed = (n_words < LEAST_WORDS) | (100 * n_repeat > REPEAT_PERCENT * n_words)
    kept = ~failed & (line_share <= LINE_SHARE)
    for n, most in NGRAM_SHARES.items():
        kept &= shares[n] <= most
    columns = [ids, n_words, word_chars, sums(SYMBOLS[data], offsets), n_dup, n_repeat, *shares.values(), line_share, failed, kept]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, OUT_SCHEMA, strict=True)], schema=OUT_SCHEMA)


def measured(ids: pa.Array, column):
    """(first row, rows, their measures) of a batch, a slice at a time."""
    K.release()
    for at, n in K.batches(column, SLICE_BYTES):
        yield at, n, measure(ids.slice(at, n), column.slice(at, n))


def repetition_rules(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row of OUT_SCHEMA per row of docs; kept is the verdict.

    Words are `[^\\x20\\x09-\\x0D]+`. n_repeat_words counts words in three-word windows found twice or more in the text,
    the first included; n_dup_lines counts lines with a word that equal an earlier line of the text. base_failed: under
    50 words, or over half of them in repeated windows. kept: not base_failed, and the shares of word characters inside
    duplicated 5-, 7- and 10-grams and inside duplicate lines are within NGRAM_SHARES and LINE_SHARE. Null text counts as
    empty and fails; rows that repeat an id are judged each; an empty table gives an empty result; other columns are
    ignored. n-grams and lines are compared by 64-bit hash.
    """

    def run(parts):
        for part in parts:
            for _, _, rows in measured(part.column("doc_id"), part.column("text")):
                yield rows

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, OUT)


def kept_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that repetition_rules keeps, each judged by its own text, whatever its other columns hold."""

    def run(parts):
        for part in parts:
            for at, n, rows in measured(pa.nulls(part.num_rows, pa.int64()), part.column(text)):
                yield part.slice(at, n).filter(rows.column("kept"))

    return docs.withColumn(text, F.col(text).cast("string")).mapInArrow(run, docs.withColumn(text, F.col(text).cast("string")).schema)
