from tickgraph.llm import licences

TEXTS = [
    None, "", "plain words only\nand more", "Intro\nReleased under the MIT License.\nmore text", "Licensed under CC BY-NC 4.0.",
    "This work is licensed under the GNU General Public License, version 3.", "  licensed under the APACHE license, version 2.0.",
    "Her dog license was lost on Monday.", "The public came to see it.", "Licensed under the Apache License, Version 2.0.\nLicensed under CC BY 4.0.",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "x " * 20000 + "\nReleased under the MIT License.",
]
WANT = {(3, 1): "mit", (4, 0): "cc-by-nc", (5, 0): "gpl", (6, 0): "apache-2.0", (7, 0): "unknown", (8, 0): "unknown", (9, 0): "apache-2.0", (9, 1): "cc-by", (10, 0): "mit", (11, 1): "mit"}


def test_families_and_unknown(spark):
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, words string, top int")
    rows = licences.find_licences(docs).collect()
    assert {(r["doc_id"], r["line_no"]): r["family"] for r in rows} == WANT
    assert all(r["confirmed"] == (r["family"] != "unknown") and 0 <= r["probability"] <= 1 for r in rows)


def test_features_match_the_plain_definition(spark):
    assert licences.words_of("The MIT License, v2.0!") == ["the", "mit", "license", "v2.0"]
    assert "the mit" in licences.ngrams_of(["the", "mit"]) and "the" not in licences.ngrams_of(["the", "mit"])


def test_plan_is_native_and_empty_tables_work(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    found = licences.find_licences(docs)
    assert found.collect() == []
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
