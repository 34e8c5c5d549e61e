from tickgraph.llm import licences


def test_bare_notice(spark):
    texts = ["All rights reserved.", "text\n  ALL RIGHTS RESERVED", "The rights were reserved for him."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["line_no"]): r["family"] for r in licences.find_licences(docs).collect()}
    assert got == {(0, 0): "proprietary", (1, 1): "proprietary", (2, 0): "unknown"}
