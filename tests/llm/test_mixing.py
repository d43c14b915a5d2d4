import random
import re

from pyspark.sql import functions as F

from tracewell.llm.mixing import mix, mixed_documents, permuted

WORD = re.compile(r"[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, target string"


def shared(sizes, weights):
    """Sharing by weight, and excess anew, as stated."""
    target, full = dict.fromkeys(sizes, 0.0), set()
    left = 1.5 * sum(sizes.values())
    while left > 1e-9 and len(full) < len(sizes):
        open_ = [s for s in sizes if s not in full]
        w = sum(weights[s] for s in open_)
        for s in open_:
            target[s] += left * weights[s] / w
        left = 0.0
        for s in open_:
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                full.add(s)
    return target


def rows(seed=1, n=400):
    r = random.Random(seed)
    out = []
    for i in range(n):
        s = r.choice(["a", "a", "a", "a", "b", "Z", "é", None, "tiny"]) if i else "tiny"
        size = r.choice([0, 1, 3, 50, 200]) if s != "tiny" else r.choice([1, 2])
        out.append((i, "  ".join(f"w{k}\n" for k in range(size)), "en", s, 0, 1, "x"))
    out += [(n, None, "en", "a", 0, 1, "x"), (7, out[7][1], "en", "a", 0, 1, "x"), (None, "q q q", "en", "b", 0, 1, "x"), (n + 1, "big " * 30000, "en", "b", 0, 1, "x")]
    return out


def test_targets_and_counts(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    got = mix(df.repartition(5)).collect()
    assert len(got) == len(data)
    sizes, source = {}, {}
    for d, t, _, s, *_ in data:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
        source.setdefault(d, s)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = shared(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    taken = dict.fromkeys(sizes, 0)
    for g in got:
        s = "a" if g.doc_id == 7 and source[7] != "a" and abs(g.target - want["a"]) < 1e-6 else source[g.doc_id]
        assert g.source_size == sizes[s] and abs(g.target - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= g.taken <= 2 * g.size
        taken[s] += g.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.01 * want[s] + 2, s
    again = mix(df.repartition(2)).collect()
    assert sorted((g.doc_id or -1, g.size, g.taken) for g in got) == sorted((g.doc_id or -1, g.size, g.taken) for g in again)


def test_targets_equal_sharing_anew(spark):
    from tracewell.llm.mixing import targets

    r = random.Random(11)
    for n in (1, 2, 3, 4, 7, 20):
        sizes = {chr(97 + i): r.choice([0, 1, 10, 1000, 1000, 5000, 30000]) for i in range(n)}
        df = spark.createDataFrame([(s, v) for s, v in sizes.items()], "source string, size long")
        got = {x.source: x.target for x in targets(df, 1.5, (5.0, 2.0, 1.0), 2.0).collect()}
        want = shared(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))})
        assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in sizes), sizes


def test_permutation(spark):
    df = spark.range(1000).withColumn("n", F.lit(1000).cast("long"))
    got = [r.y for r in permuted(df, "id", "n", [F.lit(3)], "y").orderBy("id").collect()]
    assert sorted(got) == list(range(1000)) and got != list(range(1000))
    one = spark.range(1).withColumn("n", F.lit(1).cast("long"))
    assert [r.y for r in permuted(one, "id", "n", [F.lit(3)], "y").collect()] == [0]


def test_documents_hold_the_words_taken(spark):
    data = [x for x in rows(2, 120) if x[0] is not None]
    df = spark.createDataFrame(data, SCHEMA).dropDuplicates(["doc_id"])
    plan = {g.doc_id: g for g in mix(df, key=F.xxhash64("doc_id", "source", "text", F.lit(0)), pieces=True).collect()}
    text = {r.doc_id: r.text for r in df.collect()}
    out = mixed_documents(df)
    assert out.columns == df.columns
    words = {}
    for r in out.collect():
        assert r.n_chars == len(r.text)
        w = WORD.findall(r.text)
        words[r.doc_id] = words.get(r.doc_id, 0) + len(w)
        it = iter(WORD.findall(text[r.doc_id]))
        assert all(x in it for x in w)  # in order
    assert words == {d: g.taken for d, g in plan.items() if g.taken}
    for g in plan.values():
        assert g.taken == sum(p["n"] for p in g.pieces)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert mix(df).collect() == [] and mixed_documents(df).collect() == []
    assert [tuple(r)[1:] for r in mix(spark.createDataFrame([(1, None, "", "s", 0, 0, "")], SCHEMA)).collect()] == [(1, 0, 0, 0.0, 0)]
