import random
import re

import pytest

from tracewell.llm.automaton_dedup import SuffixAutomaton, remove_reference_words, remove_repeated_words

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def brute(rows, n):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    seen, out = set(), []
    for d, t in rows:
        w = WORD.findall(t)
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if (x := tuple(w[i : i + n])) in seen:
                gone[i : i + n] = [True] * n
            seen.add(x)
        spans = sum(1 for i in range(len(w)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(w), sum(gone), spans, " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def corpus(seed, n=80):
    r = random.Random(seed)
    words = ["a", "b", "é", "dd", "e.", "F"]
    shared = [[r.choice(words) for _ in range(r.randint(8, 60))] for _ in range(6)]
    rows = []
    for i in range(n):
        t = []
        for _ in range(r.randint(0, 5)):
            t += r.choice(shared) if r.random() < 0.5 else [r.choice(words) for _ in range(r.randint(1, 40))]
        rows.append((i, "".join(x + r.choice([" ", "\n", "  ", "\t\x0b"]) for x in t)))
    rows += [(n, None), (n + 1, ""), (n + 2, "a " * 300), (n + 3, "a b " * 100), (n + 4, rows[3][1]), (n + 4, rows[3][1]), (None, rows[5][1]), (n + 5, "x y z " * 30)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,hot,blocks", [(1, None, None), (2, 1, 5), (3, 3, 2)])
def test_equals_brute_force(spark, seed, hot, blocks):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, key string").repartition(3)
    got = [tuple(r) for r in remove_repeated_words(df, hot=hot, blocks=blocks).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(brute(rows, 20), key=key)


def test_empty(spark):
    assert remove_repeated_words(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_automaton_finds_exactly_the_windows_it_has():
    r = random.Random(3)
    for _ in range(50):
        texts = [[r.randint(0, 2) for _ in range(r.randint(0, 30))] for _ in range(4)]
        a = SuffixAutomaton()
        for t in texts:
            a.add(t)
        has = {tuple(t[i : i + 4]) for t in texts for i in range(len(t) - 3)}
        q = [r.randint(0, 2) for _ in range(60)]
        assert a.matches(q, 4) == [i for i in range(57) if tuple(q[i : i + 4]) in has]


def test_reference(spark):
    ref = spark.createDataFrame([("one two three four five six",)], "text string")
    docs = spark.createDataFrame([(1, "zero one two three four five nine"), (2, None), (3, "one two three")], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.kept) for r in remove_reference_words(docs, ref, window=4, shards=2).collect()}
    assert got == {1: (5, "zero nine"), 2: (0, ""), 3: (0, "one two three")}
