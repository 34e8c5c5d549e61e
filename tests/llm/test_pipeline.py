import hashlib
import random

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline

from .test_decontaminate import brute as leaks
from .test_lines import brute as line_brute
from .test_minhash import brute as near

LICENCE = "Released under the MIT License today."


def fixture(spark, folder):
    rng = random.Random(6)
    w = [f"{a}{b}" for a in ("ta", "re", "mo", "li", "su") for b in ("na", "sto", "ri", "bel", "dum", "o")]
    say = lambda n: " ".join(rng.choice(w) for _ in range(n))
    bench = [(k, say(14)) for k in range(3)]
    rows = []
    for k in range(120):
        text = "\n".join(say(rng.randint(6, 40)) for _ in range(3))
        if k % 10 == 3:
            text += "\n" + LICENCE
        if k % 15 == 4:
            text += " " + bench[k % 3][1]
        if k % 12 == 5:
            text = say(5) + " skraggface " + text
        rows.append((k, text, "en", f"src{k % 3}", len(text)))
    base = rows[0][1].replace("\n", " ")
    rows += [(200, base, "en", "s", len(base)), (201, base + " tail", "en", "s", len(base) + 5), (202, None, "en", None, None), (203, "", "en", "s", 0)]
    labels = [(k, 1, int(k % 12 == 5)) for k in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, bench


def test_stages_equal_brute_force(spark, tmp_path):
    rows, bench = fixture(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "minhash near-dedup", "benchmark decontamination", "best-fit packing"]
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        before, columns = docs, docs.columns
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "best-fit packing":
            assert docs.columns == columns
        held[name] = (sorted(before.collect(), key=lambda r: r["doc_id"]), sorted(docs.collect(), key=lambda r: r["doc_id"]))
    ids = lambda rs: [r["doc_id"] for r in rs]
    was, now = held["toxicity"]
    assert ids(now) == [d for d, t, *_ in sorted(rows) if "skraggface" not in (t or "")]
    was, now = held["line dedup"]
    want = line_brute([r["text"] for r in was])
    assert [hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in now] == [h for *_, h in want]
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in now)
    was, now = held["minhash near-dedup"]
    assert ids(now) == [was[i]["doc_id"] for i, _, _, kept in near([r["text"] for r in was]) if kept]
    was, now = held["benchmark decontamination"]
    assert ids(now) == [d for d, *_, bad in leaks([(r["doc_id"], r["text"]) for r in was], bench) if not bad]
    was, now = held["best-fit packing"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = {r["doc_id"]: len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in was}
    got = {}
    for r in now:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == sizes


def test_run_and_empty_documents(spark, tmp_path):
    fixture(spark, tmp_path)
    empty = tmp_path / "empty"
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{t}.parquet").where(F.lit(t != "documents")).write.parquet(f"{empty}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(empty)).collect() == []
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
