import random

import numpy as np
from pyspark.sql import functions as F

from tickgraph.llm import toxicity


def spans(words):
    ends = np.cumsum([len(w) for w in words])
    return np.array([ord(c) for w in words for c in w], np.uint32), ends - np.array([len(w) for w in words]), ends


def test_every_long_term_of_a_large_lexicon_has_two_errors(spark):
    rng = random.Random(8)
    bad = sorted({"".join(rng.choice("abcdefghiklmnoprstuv") for _ in range(10)) for _ in range(200)})
    rows = [(i, " ".join(["the", *bad[i % 10 :: 10]]), 1) for i in range(60)] + [(i, f"the plain text number {i}", 0) for i in range(60, 260)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    automaton = toxicity.fit(docs, labels, F.col("doc_id").isNotNull()).automaton
    assert [t for t, _ in automaton.terms] == bad
    tried = [w[:3] + "x" + w[4:7] + "y" + w[8:] for w in bad]
    assert automaton.run(*spans(tried)).tolist() == [1 + 3 * k + 2 for k in range(len(bad))]


def test_restart_changes_nothing(monkeypatch):
    automaton = toxicity.Automaton([("pathetic", False), ("lowei", True)])
    words = ["pathetic", "paxhexic", "loweiung", "plain"]
    once = automaton.run(*spans(words)).tolist()
    monkeypatch.setattr(toxicity, "HELD", 0)
    assert automaton.run(*spans(words)).tolist() == once == [4, 6, 1, 0]
