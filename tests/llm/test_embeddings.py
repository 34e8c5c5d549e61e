import math
import random

import numpy as np

from tickgraph.llm import embeddings


def brute(rows, threshold=0.93):
    def usable(v, label):
        return label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def unit(v):
        x = np.array(v, np.float64) / max(map(abs, v))
        return x / np.linalg.norm(x)

    units = [unit(v) if usable(v, l) else None for _, v, l in rows]
    n, group = [0] * len(rows), [r[0] for r in rows]
    for i in range(len(rows)):
        for j in range(i):
            if units[i] is not None and units[j] is not None and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and float(units[i] @ units[j]) >= threshold:
                n[i] += 1
                n[j] += 1
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    return sorted((r[0], k, g, r[0] == g) for r, k, g in zip(rows, n, group, strict=True))


def rows_of(seed=0):
    rng = random.Random(seed)
    gauss = lambda: [rng.gauss(0, 1) for _ in range(16)]
    out = []
    for label in (0, 1, None):
        for _ in range(14):
            base = gauss()
            for _ in range(rng.randint(1, 6)):
                noise = rng.choice([0, 0.05, 0.2, 0.3])
                out.append(([float(np.float32(x + noise * rng.gauss(0, 1))) for x in base], label))
    one = gauss()
    out += [(one, 1)] * 30 + [([2 * x for x in one], 1), ([0.0] * 16, 1), (None, 0), ([1.0] * 15 + [float("nan")], 0), ([float("inf")] + [1.0] * 15, 1), ([None] + [1.0] * 15, 1)]
    rng.shuffle(out)
    return [(k, v, label) for k, (v, label) in enumerate(out)]


def test_equals_brute_force(spark):
    rows = rows_of()
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, rep string").repartition(3)
    got = sorted(tuple(r) for r in embeddings.near_duplicates(df, block=16).collect())
    assert got == brute([(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()])


def test_empty_and_unusable(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert embeddings.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    got = embeddings.near_duplicates(spark.createDataFrame([(1, None, 2)], schema)).collect()
    assert [tuple(r) for r in got] == [(1, 0, 1, True)]


def test_interval_join_skips_nothing():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 8))
    x[200:] = x[:200] + 0.1 * rng.normal(size=(200, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x[np.lexsort(np.floor(x[:, :3] / 0.37).T[::-1])]
    want = {(i, j) for i, j in zip(*np.nonzero(x @ x.T >= 0.93), strict=True) if i < j}
    eps = math.sqrt(0.14)
    i, j = embeddings.join_blocks(x, x, 0.93, eps, leaf=8, same=True)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and len(i) == len(want)
    i, j = embeddings.join_blocks(x[:150], x[150:], 0.93, eps, leaf=8)
    assert set(zip(i.tolist(), (j + 150).tolist(), strict=True)) == {(a, b) for a, b in want if a < 150 <= b}


def test_lengths_huge_values_and_repeated_ids(spark):
    rows = [(1, [1.0, 0.0, 0.0], 0), (2, [1.0, 0.05, 0.0], 0), (3, [0.0, 1e200], 0), (4, [0.0, 1.0], 0), (5, [1e-200, 0.0], 0), (6, [3.0, 0.0], 0), (7, [3.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(tuple(r) for r in embeddings.near_duplicates(df).collect()) == brute(rows)
    twice = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [1.0, 0.0], 0)], "vec_id long, embedding array<double>, label int")
    got = sorted((tuple(r) for r in embeddings.near_duplicates(twice).collect()), key=str)
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (None, 1, 1, True)]


def test_many_intervals(spark):
    rng = random.Random(4)
    rows = []
    for k in range(150):
        base = [rng.gauss(0, 1) for _ in range(8)]
        rows += [(2 * k, base, 0), (2 * k + 1, [x + 0.1 * rng.gauss(0, 1) for x in base], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    assert sorted(tuple(r) for r in embeddings.near_duplicates(df, block=2).collect()) == brute(rows)
