import random
import re
from collections import Counter

from tracewell.llm.repetition import LINE_SHARE, NGRAM_SHARES, measured, repetition_rules

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def covered(w, n):
    g = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = [False] * len(w)
    for i in range(len(w) - n + 1):
        if g[tuple(w[i : i + n])] > 1:
            out[i : i + n] = [True] * n
    return out


def brute(d, t):
    t = t or ""
    w = WORD.findall(t)
    chars = sum(map(len, w))
    seen, dup, dup_chars = set(), 0, 0
    for line in t.split("\n"):
        x = WORD.findall(line)
        if x:
            if line in seen:
                dup += 1
                dup_chars += sum(map(len, x))
            seen.add(line)
    rep = sum(covered(w, 3))
    shares = [sum(len(x) for x, c in zip(w, covered(w, n)) if c) / max(chars, 1) for n in NGRAM_SHARES]
    failed = len(w) < 50 or 100 * rep > 50 * len(w)
    kept = not failed and all(s <= m for s, m in zip(shares, NGRAM_SHARES.values())) and dup_chars / max(chars, 1) <= LINE_SHARE
    return (d, len(w), chars, sum(c in "#*$%&|<>" for c in t), dup, rep, *(round(s, 9) for s in shares), round(dup_chars / max(chars, 1), 9), failed, kept)


def test_equals_brute_force(spark):
    r = random.Random(4)
    words = ["".join(r.choice("abé#$<ß") for _ in range(r.randint(1, 5))) for _ in range(40)]
    rows = [(0, None), (1, ""), (2, " \n\n\x0b "), (3, "a b c " * 40), (4, "x\ny\nx\n x\nx"), (None, "q " * 10), (5, "\n" + "w " * 60), (5, "\n" + "w " * 60)]
    for i in range(6, 150):
        lines = [" ".join(r.choice(words) for _ in range(r.randint(0, 12))) for _ in range(r.randint(1, 15))]
        rows.append((i, r.choice(["\n", "\n\n", " \n"]).join(r.choice(lines) for _ in range(r.randint(1, 25)))))
    rows.append((200, " ".join(f"w{i}" for i in range(300))))
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, kept int").repartition(3)
    got = [tuple(round(x, 9) if isinstance(x, float) else x for x in row) for row in repetition_rules(df).collect()]
    assert sorted(got, key=str) == sorted((brute(d, t) for d, t in rows), key=str)
    assert any(g[-1] for g in got)


def test_empty(spark):
    assert repetition_rules(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_memory_follows_a_slice_and_not_the_batch():
    import tracemalloc

    import pyarrow as pa

    r = random.Random(2)
    text = " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(4000))
    column = pa.array([text] * 400)
    list(measured(pa.array(range(40)), column.slice(0, 40)))  # tables of powers stay
    tracemalloc.start()
    rows = sum(n for _, n, _ in measured(pa.array(range(400)), column))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 400 and peak < 80 << 20
