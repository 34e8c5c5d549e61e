import hashlib
import math
import random
import re

from pyspark.sql import functions as F

from tickgraph.llm import lines, queries


def sets_of(text):
    """The token set of each line: its words, or of fewer than five words their sequence as one token."""
    for line in text.split("\n"):
        w = re.findall(r"[^\x20\x09-\x0D]+", line.lower())
        yield line, ({tuple(w)} if 0 < len(w) < 5 else set(w))


def brute(texts):
    """(place, lines, removed lines, digest of what is left) of each text, in order."""
    seen, out = [], []
    for d, text in enumerate(texts):
        kept, gone = [], 0
        for line, s in sets_of(text or ""):
            match = any(100 * len(s & o) >= 75 * len(s | o) for o in seen)
            if s:
                seen.append(s)
            gone += match
            if not match:
                kept.append(line)
        n = 0 if text is None else len(text.split("\n"))
        out.append((d, n, gone, hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def texts_of():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)] + ["the", "of", "fluff", "\u00dcBER"] * 5
    base = [[rng.choice(words) for _ in range(rng.choice([1, 3, 5, 8, 20, 60, 150]))] for _ in range(25)]
    out = [None, "", "\n\n", "a b c d", "a b c d", "Same line of five words\r", "SAME line  of five words", "x " * 5000, " ".join(f"y{k}" for k in range(3000))]
    out += ["of fluff", "o lu", "of\ffluff", "one\ftwo\x0bthree\tfour five", "one two three four five"]
    for _ in range(60):
        rows = []
        for _ in range(rng.randint(1, 6)):
            row = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 5, 12])):
                row[rng.randrange(len(row))] = rng.choice(words)
            rows.append(" ".join(row))
        out.append("\n".join(rows))
    return [*out, out[8], out[8] + " tail"]


def test_equals_brute_force(spark):
    texts = texts_of()
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(texts)], "doc_id long, text string, prefix string, c int").repartition(3)
    assert sorted(tuple(r) for r in lines.digest(docs).collect()) == brute(texts)
    kept = lines.without_repeated_lines(docs)
    assert kept.columns == docs.columns and kept.count() == len(texts)
    got = {r["doc_id"]: r["h"] for r in kept.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")).collect()}
    assert got == {d: h for d, _, _, h in brute(texts)}


def test_query_over_a_group_of_near_copies(spark, tmp_path):
    rng = random.Random(2)
    base = [f"word{k}" for k in range(40)]
    texts = []
    for k in range(60):
        row = list(base)
        for _ in range(rng.randint(1, 8)):
            row[rng.randrange(40)] = f"own{k}x{rng.randrange(9)}"
        texts.append(" ".join(row))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in queries.op4_line_dedup(spark, str(tmp_path)).collect())
    assert got == brute(texts) and 20 < sum(r[2] for r in got) < 60


def test_repeated_and_null_ids(spark):
    line = "a line of six common words"
    rows = [(1, line), (1, line), (None, line), (1, line + " more"), (None, "quite another line it is here"), (2, "quite another line it is here")]
    got = lines.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    # null ids come first; equal rows are one document; another text of the same id is a document of its own
    want = [(None, line), (None, "quite another line it is here"), (1, ""), (1, ""), (1, ""), (2, "")]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a b c d e f\na b c d e f")], "doc_id long, text string")
    plan = lines.without_repeated_lines(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lines.without_repeated_lines(docs).collect() == []


def test_short_rows_of_postings(spark):
    rng = random.Random(3)
    big = [(2**31 - 1, 2**31 - 1), (2**31 - 1, 5), (1, 1)]
    sizes = big + [(n, rng.randint(1, n)) for n in [rng.randint(1, 40) for _ in range(40)]]
    rows = [(c, rng.random() < 0.3, n, rng.getrandbits(3), rng.getrandbits(3), [7] * min(3, left)) for c, (n, left) in enumerate(sizes)]
    classes = spark.createDataFrame(rows, "c long, done boolean, n int, g0 long, g1 long, prefix array<int>")
    posted = lines._postings(classes)
    assert posted.columns == ["token", "c", "u", "g0", "g1"]
    met = posted.alias("a").join(posted.alias("b"), lines._near(75, 100)).select("a.c", F.col("b.c").alias("c2")).distinct()

    def near(a, b):
        apart = (a[3] ^ b[3]).bit_count() + (a[4] ^ b[4]).bit_count()
        fits = any(175 * min(a[2] - i, b[2] - j) >= 75 * (a[2] + b[2]) for i in range(len(a[5])) for j in range(len(b[5])))
        return b[0] < a[0] and not a[1] and 100 * min(a[2], b[2]) >= 75 * max(a[2], b[2]) and 175 * apart <= 25 * (a[2] + b[2]) and fits

    want = {(a[0], b[0]) for a in rows for b in rows if near(a, b)}
    assert {tuple(r) for r in met.collect()} == want and len(want) > 20


def test_candidates_by_size(spark):
    rng = random.Random(8)
    sets = [rng.sample(range(40), rng.choice([1, 2, 5, 7, 12, 20, 21, 26])) for _ in range(40)]
    sets += [sorted({*rng.sample(s, max(1, len(s) - rng.choice([0, 1, 2, 3]))), rng.randrange(40)}) for s in sets for _ in range(3)]
    rng.shuffle(sets)
    rows = []
    for c, s in enumerate(sets):
        s, g = sorted(set(s)), [0, 0]
        for k in s:
            g[k % 2] ^= 1 << k
        rows.append((c, rng.random() < 0.3, len(s), *g, s[: len(s) - math.ceil(len(s) * 0.75) + 1]))
    classes = spark.createDataFrame(rows, "c long, done boolean, n int, g0 long, g1 long, prefix array<int>")
    got = {tuple(r) for k in range(2) for r in lines._candidates(classes, 75, 100, k, 2).collect()}
    posted = lines._postings(classes)
    # the same pairs as those of all postings with all, which read more of them
    met = posted.alias("a").join(posted.alias("b"), lines._near(75, 100)).select("a.c", F.col("b.c").alias("c2")).distinct()
    assert got == {tuple(r) for r in met.collect()}
    match = {(a, b) for a, x in enumerate(sets) for b, y in enumerate(sets[:a]) if not rows[a][1] and 100 * len({*x} & {*y}) >= 75 * len({*x} | {*y})}
    assert match <= got and len(match) > 20
    assert posted.where(lines._short(75, 100)).count() < 0.75 * posted.count()


def test_only_rows_that_may_be_flagged_are_shuffled(spark):
    rows = spark.createDataFrame([(k if k else None, k % 3, f"x{k}") for k in range(3000)] * 2, "a long, b long, v string")
    ids = rows.where("a is null or a % 100 = 0").select(F.col("a"), F.col("b"), F.lit(True).alias("f")).distinct()
    got = sorted((tuple(r) for r in lines._flagged(rows, ids, ["a", "b"], ["f"]).collect()), key=str)
    want = [(k if k else None, k % 3, f"x{k}", True if k % 100 == 0 else None) for k in range(3000)] * 2
    assert got == sorted(want, key=str)
    marked = lines._marked(rows, ids, ids.count(), ["a", "b"])
    assert marked.count() == 6000 and 60 <= marked.where("_may").count() < 3000
