import random
import zlib

import numpy as np
import pyarrow as pa

from tickgraph.llm import bytescan, quality, toxicity

RNG = random.Random(9)
CLEAN = [f"{a}{b}{c}" for a in ("ta", "re", "mo", "li") for b in ("n", "sto", "ri", "") for c in ("a", "el", "um", "o", "is")]


def sentence(n):
    return " ".join(RNG.choice(CLEAN) for _ in range(n)).capitalize() + "."


def table(spark, make, label, count=240):
    rows, labels = [(10**6, None, 1), (10**6 + 1, "", 2)], []
    for k in range(count):
        y = int(k % 4 == 0)
        rows.append((k, make(y), k))
        labels.append((k, y))
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int").repartition(3)
    return docs, spark.createDataFrame([*labels, labels[0], (None, 1), (7, None)], f"doc_id long, {label} int"), dict(labels)


def check(rows, truth, modulus, held, threshold):
    assert len(rows) == len(truth) + 2
    right = 0
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == held)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold)
        right += r["held_out"] and truth.get(r["doc_id"]) == r["predicted"]
    of = sum(r["held_out"] and r["doc_id"] in truth for r in rows)
    assert right >= 0.9 * of


def test_quality_on_held_out_rows(spark):
    def make(y):
        text = "\n".join(sentence(RNG.randint(5, 15)) for _ in range(4))
        return text if y else RNG.choice([text.upper().replace(" ", "!! "), text.replace(" ", " | "), (text.split()[0] + " ") * 30])

    docs, labels, truth = table(spark, make, "quality")
    check(quality.classify(docs, labels).collect(), truth, 5, 0, 0.3)
    assert quality.classify(docs.limit(0), labels).collect() == []
    assert {r["score"] for r in quality.classify(docs.limit(5), labels.limit(0)).collect()} == {0.5}


def test_toxicity_on_held_out_rows(spark):
    bad = ["skragg", "blorptard", "vunkhead"]

    def make(y):
        w = sentence(RNG.randint(8, 20)).split(" ")
        if y:
            w.insert(RNG.randrange(len(w)), RNG.choice(bad))
        return " ".join(w)

    docs, labels, truth = table(spark, make, "toxic")
    check(toxicity.classify(docs, labels).collect(), truth, 3, 1, 0.7)
    tried = spark.createDataFrame([(1, "you are a blorptrad ok"), (2, 'he said "you vunkhead" once'), (3, "you vunkhead"), (4, sentence(9))], "doc_id long, text string")
    from pyspark.sql import functions as F

    model = toxicity.fit(docs, labels, F.col("doc_id").isNotNull())
    got = {r["row"]["doc_id"]: r["score"] for r in toxicity.score(tried, model).collect()}
    assert got[3] >= 0.7 > got[4] and got[2] < got[3] and got[1] > got[4]
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert toxicity.classify(docs.limit(0), labels).collect() == []


def distance(word: str, term: str) -> int:
    """Edit distance in which a swap of neighbours is one error."""
    d = {(i, j): i + j if not i * j else 0 for i in range(len(word) + 1) for j in range(len(term) + 1)}
    for i in range(1, len(word) + 1):
        for j in range(1, len(term) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (word[i - 1] != term[j - 1]))
            if i > 1 and j > 1 and word[i - 1] == term[j - 2] and word[i - 2] == term[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(word), len(term)]


def test_automaton_equals_edit_distance():
    terms = [("loser", False), ("idiot", False), ("pathetic", False), ("scum", False), ("worthless", False), ("lowei", True), ("vequ", True)]
    automaton = toxicity.Automaton(terms)

    def nearest(word):
        best = None
        for k, (t, stem) in enumerate(automaton.terms):
            most = 2 if len(t) >= 8 else 1 if len(t) >= 5 else 0
            d = min(distance(word[:i], t) for i in range(len(word) + 1)) if stem else distance(word, t)
            if d <= most and (best is None or (d, k) < best):
                best = d, k
        return 0 if best is None else 1 + 3 * best[1] + best[0]

    rng = random.Random(1)
    tried = []
    for _ in range(700):
        w = list(rng.choice(terms)[0])
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(w))
            w[i : i + 1] = rng.choice([[], [w[i], rng.choice("abcé*")], [rng.choice("lostvq")], w[i : i + 2][::-1]]) or [rng.choice("xy")]
        tried.append("".join(w) + rng.choice(["", "", "ung"]))
    codes = np.array([ord(c) for w in tried for c in w], np.uint32)
    ends = np.cumsum([len(w) for w in tried])
    got = automaton.run(codes, ends - np.array([len(w) for w in tried]), ends)
    assert got.tolist() == [nearest(w) for w in tried]


def test_words_and_quotation():
    data, offsets = bytescan.texts_of(pa.array(["w0rd st*p x** É1é", None, "a\n", '"b" c']))
    codes, starts, ends, before, quotes, _ = toxicity.words_in(data, offsets)
    assert ["".join(map(chr, codes[a:b])) for a, b in zip(starts, ends, strict=True)] == ["w0rd", "st*p", "x", "é1é", "a", "b", "c"]
    assert before.tolist() == [0, 4, 4, 5, 7] and len(quotes) == 2


def test_automaton_knows_letters_of_all_scripts():
    alphabet = "".join(chr(0x4E00 + k) for k in range(90))
    terms = [(alphabet[k : k + 9], False) for k in range(0, 81, 9)]
    words = [terms[0][0], terms[8][0][:-1] + "x", terms[4][0][:3] + terms[4][0][5:], alphabet[85:90] * 2]
    automaton = toxicity.Automaton(terms)
    data, offsets = bytescan.texts_of(pa.chunked_array([pa.array(words)]))
    codes, starts, ends, *_ = toxicity.words_in(data, offsets)
    got = automaton.run(codes, starts, ends)
    names = sorted(terms)
    wanted = [1 + 3 * names.index(terms[0]), 1 + 3 * names.index(terms[8]) + 1, 1 + 3 * names.index(terms[4]) + 2, 0]
    assert got.tolist() == wanted


def test_reporting_words_as_by_comparison():
    text = "he says that Word words wordy say said calls call him a term, quote QUOTES phrases"
    data, offsets = bytescan.texts_of(pa.chunked_array([pa.array([text])]))
    codes, starts, ends, *_ = toxicity.words_in(data, offsets)
    wanted = [w in toxicity.REPORTING for w in ["".join(map(chr, codes[a:b])) for a, b in zip(starts, ends, strict=True)]]
    assert toxicity.reports(codes, starts, ends).tolist() == wanted and sum(wanted) == 9
