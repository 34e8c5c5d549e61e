import random
import re

import numpy as np
import pytest

from tickgraph.llm import minhash


def brute(texts, part=75, whole=100):
    sets = []
    for t in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if inter and whole * inter >= part * (len(sets[i]) + len(sets[j]) - inter):
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    return [(i, len(s), g, g == i) for i, (s, g) in enumerate(zip(sets, group, strict=True))]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)]
    out = [None, "", "  \n", "One two", "one  TWO", "one two three", "É a b c d", "é a b c d"]
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 30, 120, 400]))]
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(int(len(copy) * rng.choice([0, 0.01, 0.02, 0.05]))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(" ".join(copy))
    out.append(" ".join(rng.choice(vocabulary) for _ in range(30000)))
    return out


def test_equals_brute_force(spark, texts):
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in enumerate(texts)], "doc_id long, text string, n_shingles int, key string").repartition(3)
    got = sorted(tuple(r) for r in minhash.near_duplicates(docs).collect())
    assert got == brute(texts)
    kept = minhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [d for d, _, _, k in got if k]


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(4, "a b c d e f"), (4, "a b c d e f"), (2, "a b c d e f"), (None, "q r s t u")], "doc_id long, text string")
    got = sorted((tuple(r) for r in minhash.near_duplicates(docs).collect()), key=repr)
    assert got == [(2, 2, 2, True), (4, 2, 2, False), (4, 2, 2, False), (None, 1, None, True)]
    assert minhash.near_duplicates(docs.limit(0)).collect() == []
    assert minhash.without_near_duplicates(docs).count() == 2


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    errors = []
    for n in (3, 20, 200):
        for _ in range(60):
            shared, own = rng.integers(0, 2**52, n).astype(np.uint64), rng.integers(0, 2**52, 2 * n).astype(np.uint64)
            a, b = np.unique(np.concatenate([shared, own[:n]])), np.unique(np.concatenate([shared, own[n:]]))
            s = minhash.super_minhash(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 128)
            assert s.max() < 0xFFFFFFFF
            errors.append(np.mean(s[0] == s[1]) - 1 / 3)
    assert abs(np.mean(errors)) < 0.01
    assert np.mean(np.square(errors)) < (1 / 3) * (2 / 3) / 128


def test_each_element_draws_a_permutation():
    s = minhash.super_minhash(np.array([77], np.uint64), np.array([0, 1]), 16)
    assert sorted((s[0] >> 24).tolist()) == list(range(16))
