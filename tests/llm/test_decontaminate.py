import random
import re

from tickgraph.llm import decontaminate

LONG = " ".join(f"w{k}" for k in range(30))
ITEMS = [(1, LONG), (2, "alpha beta gamma"), (11, "solo"), (3, "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12"), (4, None), (5, " .. "), (6, "Ünï çode WORDS 42"), (None, "solo")]


def words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, size=10):
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), []
        for i, text in items:
            iw = words(text)
            n = min(size, len(iw))
            if i is None or not n:
                continue
            grams = {tuple(iw[k : k + n]) for k in range(len(iw) - n + 1)}
            at = [k for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in grams]
            if at:
                found.append(i)
                hit |= {p for k in at for p in range(k, k + n)}
        out.append((d, len(w), len(hit), len(found), decontaminate.sha256_of(found), bool(hit)))
    return sorted(out)


def fixture():
    rng = random.Random(1)
    w = LONG.split()
    docs = [(0, None), (1, ""), (2, "Alpha, BETA; gamma!"), (3, "alpha beta x gamma"), (4, "solo SOLO"), (5, "ÜNÏ Ünï çode words 42"), (6, LONG), (7, "a " * 30000 + LONG)]
    for k in range(8, 40):
        a, n = rng.randrange(25), rng.randint(1, 30)
        docs.append((k, f"x{k} " + "-".join(w[a : a + n]) + " end solo" * (k % 3) + " alpha"))
    return docs


def test_equals_brute_force(spark):
    docs = fixture()
    df = spark.createDataFrame([(*d, 1, "h") for d in docs], "doc_id long, text string, n_hit int, row string").repartition(3)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = brute(docs, ITEMS)
    for most in (32 << 20, 60):
        hits = decontaminate.find_windows(df, bench, most_broadcast=most)
        assert sorted(tuple(r) for r in decontaminate.digest(hits).collect()) == want
    kept = decontaminate.without_contaminated(df, bench)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [d for d, *_, bad in want if not bad]


def test_repeated_rows_in_several_parts(spark):
    df = spark.createDataFrame([(1, LONG), (1, LONG), (None, LONG), (None, LONG), (1, "alpha")], "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    one, many = (decontaminate.digest(decontaminate.find_windows(df, bench, most_broadcast=m)).collect() for m in (32 << 20, 60))
    assert len(many) == 5 and sorted(map(tuple, many), key=str) == sorted(map(tuple, one), key=str)


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "alpha beta")], "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.find_windows(df.limit(0), bench).collect() == []
    row = decontaminate.digest(decontaminate.find_windows(df, bench.limit(0))).first()
    assert tuple(row) == (1, 2, 0, 0, decontaminate.sha256_of([]), False)
