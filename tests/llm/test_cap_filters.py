import numpy as np

from tracewell.llm.cap_filters import near_vectors
from tracewell.llm.components import components


def brute(rows, threshold=0.98):
    n = len(rows)
    unit = []
    for _, v, lab in rows:
        ok = v and lab is not None and None not in v and np.isfinite(v).all() and np.any(v)
        unit.append(np.array(v, float) / np.linalg.norm(v) if ok else None)
    links = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in range(n)]
    comp = {i: rows[i][0] for i in range(n)}
    change = True
    while change:
        change = False
        for i in range(n):
            low = min([comp[i], *(comp[j] for j in links[i])])
            change |= low < comp[i]
            comp[i] = low
    return [(rows[i][0], len(links[i]), comp[i], comp[i] == rows[i][0]) for i in range(n)]


def test_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((25, 64))
    rows = []
    for i in range(900):
        b = base[rng.integers(25)] if rng.random() < 0.7 else rng.standard_normal(64)
        rows.append([i, (b + rng.standard_normal(64) * rng.choice([0, 0.02, 0.1, 0.15])).astype(np.float32).tolist(), int(rng.integers(3))])
    for i in range(60):
        rows[i * 7][1] = rows[5][1]
    rows += [[900, None, 1], [901, [0.0] * 64, 1], [902, [float("nan")] * 64, 1], [903, [None] * 64, 1], [904, rows[5][1], None], [905, [], 1], [906, [1.0, 2.0], 1], [907, [2.0, 4.0], 1], [908, [1e30] * 64, 2], [909, [1e-30] * 64, 2], [910, [float("inf")] * 64, 2]]
    df = spark.createDataFrame([(i, v, lab, "x") for i, v, lab in rows], "vec_id long, embedding array<float>, label int, rep string").repartition(4)
    got = sorted(tuple(r) for r in near_vectors(df).collect())
    want = brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows])
    assert got == sorted(want)


def test_empty(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (500, 499)]
    got = {r.node: r.component for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {499: 499, 500: 499}
