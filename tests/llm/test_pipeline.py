import hashlib
import re

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
import sentencepiece  # noqa: E402

import corpus_pipeline  # noqa: E402
from tests.llm import test_jaccard_join, test_line_dedup, test_repetition  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def brute(rows):
    """The stages but mixing and encoding, which is not by choice of words, on rows of documents."""
    rows = [r for r in rows if test_repetition.brute(r[0], r[1])[-1]]
    by = {(d, t): rest for d, t, *rest in rows}
    out = []
    lines = test_line_dedup.brute([(r[0], r[1]) for r in rows], 2, 20)
    before = {r[0]: r for r in rows}
    for d, t, _, gone in lines:
        if gone == 0 or (t and re.search(r"[^\x20\x09-\x0d]", t)):
            r = before[d]
            out.append((d, t, r[2], r[3], r[4] if gone == 0 else len(t)))
    assert by is not None
    groups = test_jaccard_join.brute([(r[0], r[1]) for r in out], 5, 8, 10)
    keep = {d for d, _, c in groups if d == c}
    return [r for r in out if r[0] in keep]


def corpus():
    import random

    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdeéfgh") for _ in range(r.randint(2, 8)))
    line = lambda: " ".join(word() for _ in range(r.randint(8, 20)))
    shared = [line() for _ in range(4)]
    rows = []
    for i in range(60):
        text = "\n".join([*(line() for _ in range(r.randint(5, 8))), *r.sample(shared, 2)])
        rows.append([i, text, "en", r.choice("abc"), len(text)])
    for i in range(60, 80):  # near copies: words exchanged in every line
        lines = rows[i - 60][1].split("\n")[:-2]
        lines = [" ".join([word(), *x.split()[1:]]) for x in lines]
        rows.append([i, "\n".join(lines), "en", r.choice("abc"), 1])
    rows += [[80, rows[3][1], "en", "a", 1], [81, "x y z " * 60, "en", "b", 1], [82, "few words", "en", "b", 1], [83, None, "en", None, None], [84, "", "en", "c", 0]]
    return [tuple(x) for x in rows]


def test_stages(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, "")
        assert docs.columns == COLUMNS
    got = sorted(tuple(r) for r in docs.collect())
    want = sorted(brute(rows))
    assert [g[0] for g in got] == [w[0] for w in want] and got == want
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, "")
    assert mixed.columns == COLUMNS
    words = sum(len(r.text.split()) for r in mixed.collect())
    assert abs(words - 1.5 * sum(len(g[1].split()) for g in got)) <= 0.02 * words + 20
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    digest = lambda x: hashlib.sha256(repr(x).encode()).hexdigest()
    encoded = [(r.doc_id, digest((list(r.ids), r.decoded))) for r in corpus_pipeline.STAGES[4][1](spark, mixed, "").collect()]
    assert sorted(encoded) == sorted((r.doc_id, digest((sp.encode(r.text), r.text))) for r in mixed.collect())


def test_run(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0 and out.columns == ["doc_id", "ids", "decoded"]


def test_repeated_and_null_ids(spark):
    import random

    r = random.Random(9)
    words = lambda: ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(80)]
    near = lambda w: " ".join([*w[:-1], "other"])
    a, b, c, d, e, f, g = (words() for _ in range(7))
    rows = [
        (1, " ".join(a), "kept: an equal id fails"), (1, "few words", "fails"), (None, " ".join(b), "kept: a null id fails"), (None, "x y z " * 60, "fails"),
        (2, " ".join(c), "kept"), (3, near(c), "near copy"), (3, " ".join(d), "kept: an equal id is a near copy"),
        (4, " ".join(e), "kept of equal rows"), (4, " ".join(e), "kept of equal rows"),
        (None, " ".join(f), "kept of null ids"), (None, near(f), "kept of null ids"), (5, " ".join(g), "kept before null"), (None, near(g), "near copy"),
    ]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    good = corpus_pipeline.quality_rules(spark, docs, "")
    assert sorted(x.source for x in good.collect()) == sorted(s for _, _, s in rows if s != "fails")
    out = corpus_pipeline.near_duplicates(spark, good, "")
    assert out.columns == COLUMNS
    assert sorted(x.source for x in out.collect()) == sorted({s for _, _, s in rows if s.startswith("kept")})


def test_rows_without_words_stay(spark):
    docs = spark.createDataFrame([(1, None, "en", "a", 0), (1, None, "en", "a", 0), (None, "", "en", "a", 0), (None, "", "en", "a", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.near_duplicates(spark, docs, "").count() == 4


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.collect() == []
