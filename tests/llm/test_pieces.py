import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
import sentencepiece  # noqa: E402

from tracewell.llm.pieces import encode_decode, pieces_of, reference_merge  # noqa: E402

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def texts():
    r = random.Random(7)
    alphabet = list("abcdeorstiannht   \n\t▁éß中文\U0001f600́\x00\x0b.,#1234") + ["the", " of", "tion", "  ", "   "]
    out = ["", " ", "  ", "\n", "▁", "a", " a", "a ", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "1" * 40, " " * 50, "ab" * 300, "中" * 30, "x" * 5000, "the of and to" * 200]
    out += ["".join(r.choice(alphabet) for _ in range(r.randint(1, 120))) for _ in range(1500)]
    out += ["".join(r.choice("thetionandofr") for _ in range(r.randint(1, 400))) for _ in range(300)]
    return out


def test_equals_the_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = list(enumerate(texts())) + [(-1, None)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string").repartition(3)
    got = {r.doc_id: (list(r.ids), r.decoded) for r in encode_decode(df, MODEL).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        ids = sp.encode(t or "")
        assert got[i] == (ids, sp.decode(ids)), repr(t)


def test_backtracking_equals_merging():
    p = pieces_of(MODEL)
    r = random.Random(9)
    for _ in range(2000):
        t = "".join(r.choice(["th", "e", "tion", "an", "d", "ing", "▁", "er", "st", "re", "1", "."]) for _ in range(r.randint(1, 25)))
        assert p.run(t) == reference_merge(p, t)


def test_empty(spark):
    assert encode_decode(spark.createDataFrame([], "doc_id long, text string"), MODEL).collect() == []


def test_tables_stay_for_their_operator_only():
    from tracewell.llm import kernels

    own = pieces_of(MODEL)
    own.encode("the of and")
    kernels.trim()
    assert pieces_of(MODEL) is own and own.parts
    kernels.release()  # as another operator's task does
    assert pieces_of(MODEL) is not own
