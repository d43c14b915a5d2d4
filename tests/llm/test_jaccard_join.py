import random
import re

import pytest

from tracewell.llm.jaccard_join import Classes, near_documents

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def shingles(t, n):
    w = WORD.findall(lower(t))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n, num, den):
    sets = [shingles(t, n) for _, t in rows]
    comp = [d for d, _ in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    change = True
    while change:
        change = False
        for i, j in links:
            low = min(comp[i], comp[j])
            change |= comp[i] != low or comp[j] != low
            comp[i] = comp[j] = low
    return sorted((d, len(s), c) for (d, _), s, c in zip(rows, sets, comp))


def corpus(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(200)] + ["The", "É", "x."]
    rows = []
    bases = [[r.choice(words) for _ in range(r.choice([2, 5, 9, 12, 25, 60, 150]))] for _ in range(25)]
    for i in range(260):
        t = list(r.choice(bases)) if r.random() < 0.85 else [r.choice(words) for _ in range(r.randint(0, 80))]
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            if t:
                t[r.randrange(len(t))] = r.choice(words)
        if r.random() < 0.3 and t:
            t.insert(r.randrange(len(t)), "new")
        rows.append((i, r.choice([" ", "\n", "  "]).join(x.upper() if r.random() < 0.05 else x for x in t)))
    rows += [(300, None), (301, ""), (302, " \n"), (303, "a"), (304, "A"), (305, "a b"), (306, rows[0][1]), (306, rows[0][1]), (307, "z " * 5000), (308, "z " * 4000)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,n,num,den,region", [(1, 3, 90, 100, 1200), (2, 5, 8, 10, 1200), (3, 3, 8, 10, 6), (4, 3, 90, 100, 5)])
def test_equals_brute_force(spark, seed, n, num, den, region):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, region int, n int").repartition(3)
    got = sorted(tuple(r) for r in near_documents(df, n, num, den, region=region).collect())
    assert got == brute(rows, n, num, den)


def test_similar_sets_share_a_signature():
    import numpy as np

    r = np.random.default_rng(1)
    for num, den in ((9, 10), (8, 10)):
        c = Classes(num, den)
        for _ in range(3000):
            size = int(r.integers(1, 120))
            x = np.unique(r.integers(0, 2**63, size, dtype=np.uint64))
            drop, add = int(r.integers(0, size // 8 + 2)), int(r.integers(0, size // 8 + 2))
            y = np.unique(np.concatenate([x[drop:], r.integers(0, 2**63, add, dtype=np.uint64)]))
            both = len(np.intersect1d(x, y))
            if len(y) and not np.array_equal(x, y) and den * both >= num * (len(x) + len(y) - both):
                assert len(np.intersect1d(c.of(x), c.of(y)))


def test_bitmaps_never_part_similar_sets():
    import numpy as np

    r = np.random.default_rng(2)
    c = Classes(8, 10)
    fold = lambda b, w: b if len(b) * 8 == w else fold(b[: len(b) // 2] | b[len(b) // 2 :], w)
    for _ in range(2000):
        size = int(r.integers(1, 700))
        x = np.unique(r.integers(0, 2**63, size, dtype=np.uint64))
        y = np.unique(np.concatenate([x[int(r.integers(0, size // 8 + 2)) :], r.integers(0, 2**63, int(r.integers(0, size // 8 + 2)), dtype=np.uint64)]))
        both = len(np.intersect1d(x, y))
        if len(y) and 10 * both >= 8 * (len(x) + len(y) - both):
            levels = {c.level(len(x)), c.level(len(y))}
            assert max(levels) - min(levels) <= 1
            w = c.width(max(levels))
            a, b = (fold(np.frombuffer(c.bits(s), np.uint8), w) for s in (x, y))
            assert np.unpackbits(a ^ b).sum() <= (len(x) + len(y)) * 2 // 18


def test_cells_of_large_regions(spark, monkeypatch):
    """With small leaves and regions every step is entered: bitmaps in blocks, cells by shuffles, dense cells, blocks."""
    from tracewell.llm import jaccard_join as j

    rounds = []
    monkeypatch.setattr(j, "BLOCK", 16)
    monkeypatch.setattr(j, "divide", lambda *a, f=j.divide: rounds.append(1) or f(*a))
    rows = corpus(7)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in near_documents(df, 3, 8, 10, region=4).collect())
    assert got == brute(rows, 3, 8, 10) and rounds


def test_cells_in_a_task():
    import numpy as np

    from tracewell.llm.jaccard_join import links_within, voronoi_links

    r = np.random.default_rng(5)
    for seed in range(20):
        bases = [np.unique(r.integers(0, 2**63, 80, dtype=np.uint64)) for _ in range(1 + seed % 7)]
        sets = [np.unique(np.concatenate([r.permutation(bases[r.integers(len(bases))])[: 80 - r.integers(0, 20)], r.integers(0, 2**63, r.integers(0, 20), dtype=np.uint64)])) for _ in range(120)]
        i, j = voronoi_links(sets, 8, 10)
        want = {(a, b) for a, b in zip(*np.nonzero(links_within(sets, 8, 10))) if a < b}
        assert {(min(a, b), max(a, b)) for a, b in zip(i, j)} == want


def test_null_and_repeated_ids(spark):
    words = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcdef"]
    near = lambda k, *new: " ".join([*words[k].split()[: 60 - len(new)], *new])
    rows = [
        (None, words[0]), (7, near(0, "x")), (None, near(0, "y")),  # null ids link with another
        (None, words[1]), (None, near(1, "x")), (None, words[2]), (None, ""),  # they reach no doc_id
        (5, words[3]), (5, words[4]), (3, near(3, "x")), (9, near(4, "x")), (None, words[5]), (8, words[5]),  # two sets of one id are no link
    ]
    want = [7, 7, 7, None, None, None, None, 3, 5, 3, 5, 8, 8]
    for region in (1200, 2):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = [tuple(r) for r in near_documents(df, 3, 90, 100, region=region).collect()]
        assert sorted(got, key=str) == sorted(((d, len(shingles(t, 3)), c) for (d, t), c in zip(rows, want)), key=str)


def test_empty(spark):
    assert near_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
