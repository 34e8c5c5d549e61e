import random

from tickgraph.llm import language

WORDS = {"en": "the of and to in is that for it with".split(), "de": "der die und das nicht ist ein auf für mit".split(), "fr": "le la les et des une dans que pour est".split()}


def test_equals_brute_force(spark):
    rng = random.Random(2)
    say = lambda lang, n: " ".join(rng.choice(WORDS[lang]) for _ in range(n))
    docs = spark.createDataFrame([(i, say(lang, 30), lang) for i, lang in enumerate(["en", "de", "fr"] * 8)] + [(99, None, "en"), (98, "x", None)], "doc_id long, text string, lang string")
    pages = [(k, f"https://{rng.choice(['a', 'b'])}.site{k % 3}.{rng.choice(['de', 'com', 'fr'])}/{rng.choice(['en', 'x'])}/1", f'<html lang="{rng.choice(["en", "de", "zz"])}"><script>var der=1</script><p>{say(rng.choice(list(WORDS)), rng.randint(0, 12))}</p></html>') for k in range(60)]
    pages += [(100, None, None), (101, "", ""), (102, "notaurl", "<p>der die und das ist nicht ein auf")]
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, host string, text int")
    want = language.brute_identify(pages, language.fit(docs))
    rows = language.identify(df, docs).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert abs(r["probability"] - want[r["page_id"]][1]) < 2e-6
        assert r["lang"] == want[r["page_id"]][0]
    assert language.identify(df.limit(0), docs).collect() == []
    assert {r["lang"] for r in language.identify(df, docs.limit(0)).collect()} == {None}


def test_parts_of_pages():
    assert language.address_of("http://me@www.Shop.co.uk:80/de/x?q#f") == ("www.shop.co.uk", "shop.co.uk", "en")
    assert language.address_of("https://a.example.com/fr/1") == ("a.example.com", "example.com", "fr")
    assert language.page_text("a<script>x</script >b<!-- c --><p q='1'>d").split() == ["a", "b", "d"]
    assert language.declared_language("<HTML class=x LANG='DE-at'>") == "de"
