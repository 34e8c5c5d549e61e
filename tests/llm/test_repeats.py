import hashlib
import random
from collections import defaultdict

import numpy as np

from tickgraph.llm import repeats, runindex


def brute(texts, length):
    places = defaultdict(set)
    blobs = [(t or "").encode() for t in texts]
    for d, b in enumerate(blobs):
        for i in range(len(b) - length + 1):
            places[b[i : i + length]].add((d, i))
    out = []
    for d, b in enumerate(blobs):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if len(places[b[i : i + length]]) > 1:
                gone[i : i + length] = True
        runs = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    rng = random.Random(7)
    say = lambda n: "".join(rng.choice("abcdefgh é\n") for _ in range(n))
    passage, long = say(260), say(1500)
    out = [None, "", "short", say(199), say(200), "x" * 900, "ab" * 300, long, long, long[:700] + "!" + long[700:], say(400) + passage + say(50)]
    out += [say(rng.randint(0, 300)) + passage[rng.randint(0, 30) :] + say(rng.randint(0, 300)) for _ in range(25)]
    out += [say(20) + long[k : k + rng.randint(150, 420)] + say(30) for k in range(0, 1000, 90)]
    out += [passage + passage, say(300) + "y" + say(100), say(9000)]
    return out


def run(spark, texts, **options):
    docs = spark.createDataFrame([(i, t, "t", 3) for i, t in enumerate(texts)], "doc_id long, text string, t string, pos int").repartition(3)
    rows = repeats.repeated_passages(docs, 200, **options).collect()
    for r in rows:
        assert sum(e - s for s, e in zip(r["starts"], r["ends"], strict=True)) == r["n_removed"]
    return sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows)


def test_equals_brute_force(spark):
    texts = corpus()
    assert run(spark, texts) == brute(texts, 200)


def test_crowded_anchors_and_small_indexes(spark):
    texts = corpus()
    assert run(spark, texts, most_in_anchor=3, most_bytes=2000) == brute(texts, 200)


def test_empty_table(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string").limit(0)
    assert repeats.repeated_passages(docs).collect() == []


def test_run_index_matches_brute_force():
    rng = np.random.default_rng(2)
    for trial in range(60):
        base = rng.integers(97, 99 + trial % 3, 120).astype(np.uint8).tobytes()
        segments = [base[i : i + int(rng.integers(1, 60))] for i in rng.integers(0, 100, 8)]
        for depth in (3, 9, 20):
            index = runindex.RunIndex(segments, depth)
            seen = defaultdict(int)
            for s in segments:
                for i in range(len(s) - depth + 1):
                    seen[s[i : i + depth]] += 1
            want = np.zeros(index.size, bool)
            for s, at in zip(segments, index.starts, strict=True):
                for i in range(len(s) - depth + 1):
                    want[at + i] = seen[s[i : i + depth]] > 1
            assert (index.matches() == want).all()
            assert len(index.run_starts) <= index.size
