import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tracewell.llm import fill_middle, kernels, queries
from tracewell.llm.fill_middle import Chunked, fill_in_middle, restored

SCHEMA = "doc_id long, text string, form int, n string, h1 double"
OUT = ("n", "form", "prefix_chars", "middle_chars", "output")


def plainly(doc_id, text):
    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(tokens)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if h4 % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def texts():
    r = random.Random(8)
    out = [None, "", "a", "1", "é", "\U0001f600", "<P>", "x <M> y", "<", "<P", "P><S", "a" * 200_000, "ab 12é\n" * 60_000, "word " * 3000]
    return out + ["".join(r.choice(["abc", "de", " ", "1", "é", "中", "\U0001f600", "<", ">", "\n", "\x00", "P", "<S", ">M"]) for _ in range(r.randint(0, 60))) for _ in range(600)]


@pytest.mark.parametrize("chunk", [1, 7, 4096])
def test_cuts_at_any_chunk(chunk, monkeypatch):
    monkeypatch.setattr(fill_middle, "CHUNK", chunk)
    monkeypatch.setattr(fill_middle, "STEP", 3)
    some = [t for t in texts() if t is None or len(t) < 500]
    data, offsets = kernels.text_bytes(pa.array(some, pa.string()))
    chunked = Chunked(data, offsets)
    sizes = chunked.sizes()
    for i, text in enumerate(some):
        tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text or "")
        assert sizes[i] == len(tokens)
        for rank in {0, len(tokens) // 2, len(tokens)}:
            before = "".join(tokens[:rank])
            assert chunked.cut(i, rank) == (int(offsets[i]) + len(before.encode()), len(before))


def test_equals_plain_code_and_restores(spark):
    rows = [*enumerate(texts()), (None, "no id at all"), (7, "again"), (7, "again"), (7, "other")]
    df = spark.createDataFrame([(i, t, 1, "x", 0.5) for i, t in rows], SCHEMA).repartition(3)
    out = fill_in_middle(df).withColumn("back", restored()).collect()
    key = lambda x: repr(x)
    assert sorted([(r.doc_id, *[r[c] for c in OUT]) for r in out], key=key) == sorted([(i, *plainly(i, t)) for i, t in rows], key=key)
    assert sorted([(r.doc_id, r.back) for r in out], key=key) == sorted([(i, t or "") for i, t in rows], key=key)
    assert {r.form for r in out} == {"plain", "psm", "spm"}


def test_parameters(spark):
    df = spark.createDataFrame([(i, "some words here") for i in range(40)], "doc_id long, text string")
    assert {r.form for r in fill_in_middle(df, whole=0).collect()} == {"plain"}
    assert {r.form for r in fill_in_middle(df, whole=100, spm=100).collect()} == {"spm"}
    assert {r.output for r in fill_in_middle(df, seed="2").collect()} != {r.output for r in fill_in_middle(df).collect()}


def test_empty(spark):
    assert fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_no_row_lost_to_slices(spark):
    df = spark.createDataFrame([(i, "é" * 300_000) for i in range(12)], "doc_id long, text string").coalesce(1)
    assert np.sum([r.n for r in fill_in_middle(df).select("n").collect()]) == 12 * 300_000


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(queries.ORACLE_SQL["op13_fill_middle"])
    got = queries.op13_fill_middle(spark, sf)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
