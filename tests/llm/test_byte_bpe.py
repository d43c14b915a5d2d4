import random

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
from tracewell.llm import byte_bpe, queries  # noqa: E402
from tracewell.llm.byte_bpe import StreamDecoder, decode_ids, encode_decode, ranks_of  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return ranks_of(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.rank, special_tokens={})


def texts():
    r = random.Random(3)
    alphabet = list("abcdeorst  \n\t''sStrevmlld.,!#19²½é中文\U0001f600́\x00\x0b\x1c\x85\xa0 �\U00013690Ǆ") + ["the", " of", "tion", "'ll", "'s", "  ", "'re", " '", "''"]
    out = ["", " ", "'", "'s", "''s", " 's", "\n's", "'sx", "x's's", "'l", "'re", "don't'", "a" * 5000, "1" * 3000, " " * 3000, "ab" * 2000, "中" * 500, "\n" * 50, "<|endoftext|>", "word " * 60_000]
    out += ["".join(r.choice(alphabet) for _ in range(r.randint(1, 80))) for _ in range(3000)]
    return out + ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(1, 300))) for _ in range(500)]


def test_equals_the_library(spark, library):
    rows = [*enumerate(texts()), (-1, None), (None, "no id"), (5, "again"), (5, "again")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, ids string, decoded int").repartition(3)
    got = sorted(((r.doc_id, list(r.ids), bytes(r.decoded)) for r in encode_decode(df, PATH).collect()), key=repr)
    want = [(i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows]
    assert got == sorted(want, key=repr)


def test_pieces_are_those_of_the_pattern():
    import numpy as np

    class_of = lambda p: tiktoken.Encoding(p, pat_str=p, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    letters = class_of(r"\p{L}").encode_ordinary("aǄ中1 '\x1c")
    assert bytes(letters).decode() == "aǄ中"
    # every code point, so any version of the tables shows
    everything = "".join(chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000)
    points = np.array([ord(c) for c in everything], np.uint32)
    kinds = byte_bpe.classes()[points]
    for kind, p in ((byte_bpe.LETTER, r"\p{L}"), (byte_bpe.NUMBER, r"\p{N}"), (byte_bpe.BLANK, r"\s")):
        found = "".join(bytes(class_of(p).encode_ordinary(everything[i : i + 10_000])).decode() for i in range(0, len(everything), 10_000))
        assert found == "".join(c for c, k in zip(everything, kinds, strict=True) if k == kind)


def test_pairs_go_as_merging_says(ranks):
    r = random.Random(1)
    for _ in range(20_000):
        a, b = r.randrange(len(ranks.token)), r.randrange(len(ranks.token)) if r.random() < 0.5 else r.randrange(600)
        both = [ranks.token[a], ranks.token[b]]
        assert ranks.goes(a, b) == (ranks.merged(b"".join(both)) == both)


def test_small_tables_are_dropped_and_made_again(ranks, library, monkeypatch):
    for name, size in (("MOVES", 50), ("PAIRS", 20), ("PIECES", 30)):
        monkeypatch.setattr(byte_bpe, name, size)
    for t in texts()[-200:]:
        assert ranks.run(t.encode()) == library.encode_ordinary(t)


def test_streaming_decoder(ranks):
    r = random.Random(4)
    for _ in range(2000):
        ids = [r.randrange(256) if r.random() < 0.4 else r.randrange(len(ranks.token)) for _ in range(r.randint(0, 40))]
        decoder, out, i = StreamDecoder(ranks), [], 0
        while i < len(ids):
            j = i + r.randint(1, 4)
            out.append(decoder.feed(ids[i:j]))
            i = j
        assert "".join(out) + decoder.finish() == b"".join(ranks.token[i] for i in ids).decode("utf-8", "replace")
    decoder = StreamDecoder(ranks)
    smile = [ranks.rank[bytes([b])] for b in "\U0001f600".encode()]
    assert [decoder.feed([i]) for i in smile] == ["", "", "", "\U0001f600"]


def test_decode_ids(spark, ranks, library):
    rows = [(1, library.encode_ordinary("some text, 中文")), (2, None), (3, []), (4, [ranks.rank[b"\xf0"]])]
    got = {r.doc_id: r.text for r in decode_ids(spark.createDataFrame(rows, "doc_id long, ids array<int>"), PATH).collect()}
    assert got == {1: "some text, 中文", 2: None, 3: "", 4: "�"}


def test_empty(spark):
    assert encode_decode(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_query(spark, library):
    import hashlib

    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.op12_byte_bpe(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode_ordinary(d.text or "")
        row = got[d.doc_id]
        assert row.asDict() == {
            "doc_id": d.doc_id, "n_tokens": len(ids), "ids_sha256": hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
            "decoded_sha256": hashlib.sha256((d.text or "").encode()).hexdigest(),
        }


def test_well_formed_text_is_not_decoded_byte_by_byte(monkeypatch):
    """Tokens that are parts of characters do not send what is around them through the state machine."""
    ranks = byte_bpe.ranks_of(PATH)
    text = "plain words \u0e01\U0001f9ff\u0f40 and more " * 50
    ids = ranks.encode(pa.array([text]))[0]
    ids = np.frombuffer(b"".join(ids), np.int32).tolist()
    steps, run = [], byte_bpe._run
    monkeypatch.setattr(byte_bpe, "_run", lambda data, state: steps.append(len(data)) or run(data, state))
    for size in (len(ids), 7, 1):
        steps.clear()
        decoder = byte_bpe.StreamDecoder(ranks)
        assert "".join(decoder.feed(ids[i : i + size]) for i in range(0, len(ids), size)) + decoder.finish() == text
        assert max(steps, default=0) <= 4
