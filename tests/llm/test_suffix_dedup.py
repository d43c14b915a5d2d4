import random

import pytest

from tracewell.llm.suffix_dedup import front_coded, front_decoded, lcps, merge, remove_repeated_bytes


def brute(rows, n):
    rows = sorted(((d, (t or "").encode()) for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    seen, out = set(), []
    for d, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            w = t[i : i + n]
            if w in seen:
                gone[i : i + n] = b"\1" * n
            seen.add(w)
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(t), sum(gone), spans, bytes(c for c, g in zip(t, gone) if not g)))
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 7))) for _ in range(60)]
    shared = [" ".join(r.choice(words) for _ in range(r.randint(8, 60))) for _ in range(6)]
    rows = []
    for i in range(n):
        t = " ".join(r.choice([r.choice(shared), " ".join(r.choice(words) for _ in range(r.randint(1, 60)))]) for _ in range(r.randint(0, 5)))
        rows.append((i, t))
    rows += [(n, None), (n + 1, ""), (n + 2, "a" * 500), (n + 3, "ab" * 300), (n + 4, rows[3][1]), (n + 4, rows[3][1]), (None, rows[5][1]), (n + 5, "a" * 99), (n + 6, "x" * 100)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,hot,blocks", [(1, None, None), (2, 1, 5), (3, 3, 2)])
def test_equals_brute_force(spark, seed, hot, blocks):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, block int").repartition(3)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeated_bytes(df, hot=hot, blocks=blocks).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(brute(rows, 100), key=key)


def test_empty(spark):
    assert remove_repeated_bytes(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_loser_tree_gives_order_and_prefixes():
    r = random.Random(5)
    runs = []
    for _ in range(7):
        t = sorted("".join(r.choice("ab") for _ in range(r.randint(0, 12))).encode() for _ in range(r.randint(1, 40)))
        n, end, back = front_decoded(front_coded(t) + b"rest")
        assert n == len(t) and (front_coded(t) + b"rest")[end:] == b"rest"
        assert [x for x, _ in back] == t
        runs.append(t)
    out = list(merge([front_decoded(front_coded(t))[2] for t in runs]))
    left = [iter(t) for t in runs]
    texts = [next(left[k]) for k, _ in out]
    assert texts == sorted(x for t in runs for x in t)
    assert [s for _, s in out][1:] == lcps(texts).tolist()[1:]


def test_very_long_text(spark):
    r = random.Random(8)
    long = "".join(r.choice("abcdefghij ") for _ in range(300_000))
    rows = [(1, long), (2, long[100_000:200_000]), (3, "x" + long[5000:5200] + "y" * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.n_removed, x.n_spans) for x in remove_repeated_bytes(df).collect()}
    assert got == {1: (0, 0), 2: (100_000, 1), 3: (200, 1)}
