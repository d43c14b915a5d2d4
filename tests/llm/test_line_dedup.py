import random
import re

import pytest

from tracewell.llm.line_dedup import candidates, dedupe_lines, keys, within


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def near(x, y, most, least):
    short = min(len(x), len(y))
    allowed = min(most, short // least)
    return short >= least and abs(len(x) - len(y)) <= allowed and re.findall("[0-9]", x) == re.findall("[0-9]", y) and distance(x, y) <= allowed


def brute(rows, most, least):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    word = lambda x: re.search(r"[^\x20\x09-\x0d]", x)
    first = {}
    for k, (_, t) in enumerate(rows):
        for j, line in enumerate((t or "").split("\n")):
            if word(line):
                first.setdefault(line, (k, j))
    lines = list(first)
    gone = {x for i, x in enumerate(lines) if any(near(x, y, most, least) for y in lines[:i])}
    out = []
    for k, (d, t) in enumerate(rows):
        if t is None:
            out.append((d, None, 0, 0))
            continue
        all_ = t.split("\n")
        kept = [x for j, x in enumerate(all_) if not word(x) or (first[x] == (k, j) and x not in gone)]
        out.append((d, "\n".join(kept), len(all_), len(all_) - len(kept)))
    return out


def corpus(seed):
    r = random.Random(seed)
    base = ["".join(r.choice("abcé dß5") for _ in range(r.randint(15, 70))) for _ in range(25)]
    rows = []
    for i in range(90):
        lines = []
        for _ in range(r.randint(0, 6)):
            x = list(r.choice(base)) if r.random() < 0.7 else list("".join(r.choice("abcé dß") for _ in range(r.randint(1, 50))))
            for _ in range(r.choice([0, 0, 1, 2, 3, 4])):
                k, at = r.choice("ird"), r.randrange(len(x) + 1)
                if k == "i":
                    x.insert(at, r.choice("xyzab"))
                elif x and at < len(x):
                    x[at : at + 1] = [] if k == "d" else [r.choice("xyz")]
            lines.append("".join(x))
        rows.append((i, "\n".join(lines)))
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, rows[4][1]), (204, rows[5][1]), (204, rows[5][1]), (None, rows[6][1]), (205, "a" * 3000), (206, "a" * 3001 + "\n" + "a" * 3004)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,most,blocks", [(1, 2, None), (2, 1, 3), (3, 3, 5)])
def test_equals_brute_force(spark, seed, most, blocks):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, 1, "q") for d, t in rows], "doc_id long, text string, block int, idx string").repartition(3)
    out = dedupe_lines(df, most=most, blocks=blocks)
    assert out.columns == ["doc_id", "text", "block", "idx", "n_lines", "n_removed_lines"]
    got = [(r.doc_id, r.text, r.n_lines, r.n_removed_lines) for r in out.collect()]
    assert sorted(got, key=str) == sorted(brute(rows, most, 20), key=str)


def test_edit_band_and_keys():
    r = random.Random(8)
    import numpy as np

    for most in (1, 2, 3):
        a = ["".join(r.choice("ab") for _ in range(r.randint(0, 14))) for _ in range(1500)]
        b = ["".join(r.choice("ab") for _ in range(r.randint(0, 14))) for _ in range(1500)]
        assert within(a, b, most).tolist() == [distance(x, y) <= most for x, y in zip(a, b)]
        lines = sorted({"".join(r.choice("abc") for _ in range(r.randint(6, 9))) for _ in range(250)})
        key, line, probe, profile = keys([x.encode() for x in lines], most)
        place = line.astype(np.float32)
        pairs, short = candidates(key, line, probe, profile[line], most, place)
        got = {tuple(p) for p in pairs.T.tolist()}
        want = {(j, i) for j in range(len(lines)) for i in range(j) if distance(lines[i], lines[j]) <= most}
        assert want <= got and not len(short)
        assert np.all([i > j for i, j in got])
        some, short = candidates(key, line, probe, profile[line], most, place, few=2)
        assert max(np.bincount(some[0])) == 2 and set(short) == {i for i in set(pairs[0]) if (pairs[0] == i).sum() > 2}
        rest, _ = candidates(key, line, probe, profile[line], most, place, only=np.array(short[:5]))
        assert {tuple(p) for p in rest.T.tolist()} == {p for p in got if p[0] in short[:5]}


def test_numbered_lines_stay(spark):
    rows = [(i, f"Copyright notice number {i:06d} of all the rights that are reserved here") for i in range(400)]
    rows += [(1000, rows[5][1].replace("all", "al1")), (1001, rows[6][1].replace("all", "oll")), (1002, "short"), (1003, "short"), (1004, "Table 101 of results"), (1005, "Table 102 of results")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.n_removed_lines for r in dedupe_lines(df).collect()}
    assert {d for d, n in got.items() if n} == {1001, 1003}


def test_large_group_of_near_lines(spark):
    r = random.Random(4)
    base = [r.choice("abcdefgh ") for _ in range(60)]
    rows = []
    for i in range(500):
        x = list(base)
        for _ in range(r.choice([1, 1, 2, 3])):
            x[r.randrange(60)] = r.choice("xyz")
        rows.append((i, "".join(x)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((x.doc_id, x.text, x.n_lines, x.n_removed_lines) for x in dedupe_lines(df, blocks=4).collect())
    assert got == sorted(brute(rows, 2, 20))


def test_clashing_and_long_lines(spark):
    a, b = "ab", "ba"
    for _ in range(11):  # the two texts on which a polynomial modulo a power of two clashes
        a, b = a + b, b + a
    long = "".join(random.Random(3).choice("abcdef ") for _ in range(200_000))
    rows = [(1, a), (2, b), (3, long), (4, long[:90_000] + "X" + long[90_000:]), (5, long[:-5] + "vwxyz"), (6, long[1:] + "\n" + a)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = sorted((r.doc_id, r.n_removed_lines) for r in dedupe_lines(df, blocks=2).collect())
    assert got == [(1, 0), (2, 0), (3, 0), (4, 1), (5, 0), (6, 2)]


def test_empty(spark):
    assert dedupe_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_no_key_is_sent_twice():
    r = random.Random(5)
    lines = ["".join(r.choice("abcdefghijklmnop ") for _ in range(20 + i)) for i in range(60)]
    key, line, probe, _ = keys([x.encode() for x in lines], 2, 20)
    sent = list(zip(key.tolist(), line.tolist(), strict=True))
    assert len(set(sent)) == len(sent) and 0 < probe.sum() < len(sent)


def test_all_entries_are_read_once(spark):
    rows = [(i, x) for i, x in enumerate(["a line of the corpus that another is near to", "a line of the corpus that another is near tu", "nothing like it, and long enough to be asked"])]
    out = dedupe_lines(spark.createDataFrame(rows, "doc_id long, text string"), blocks=2)
    assert {r.doc_id for r in out.collect() if r.n_removed_lines} == {1}
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    # the entries that blocks send pass through one step, whose exchange all others read
    assert plan.count("share(") == 1 and plan.count("meet(") >= 1
