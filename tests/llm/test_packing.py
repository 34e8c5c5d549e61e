import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tickgraph.llm import packing

TEXTS = ["", None, "one two  three\n\nfour don't 'll", "x" * 3000, "wörd " * 3000, "日本語 text 's", "a <|endoftext|> b", "same text", "same text", "  \t\n", "v 1 2 3." * 900]


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, i, "x") for i, t in enumerate(texts)], "doc_id long, text string, piece int, row string")


@pytest.mark.parametrize("capacity", [64, 2048])
def test_pieces_ids_and_places(spark, capacity):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = packing.pack(docs_of(spark, TEXTS), path, capacity).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["row"]["doc_id"], []).append(r)
    assert set(by_doc) == set(range(len(TEXTS)))
    for d, own in by_doc.items():
        ids = [*tokenizer.encode(TEXTS[d] or "", add_special_tokens=False).ids, 0]
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert [(r["start"], r["length"]) for r in own] == packing.cut(len(ids), capacity)
        assert len(ids) > capacity or len(own) == 1
        for r in own:
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert r["ids_crc32"] == zlib.crc32(part.tobytes())
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    assert len(sequences) <= -(-sum(r["length"] for r in rows) // capacity) + 3


def test_empty_table(spark):
    assert packing.pack(docs_of(spark, ["a"]).limit(0)).collect() == []


def test_sum_of_squares_takes_the_smallest_sum():
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 12, 300)
    which, _ = packing.sum_of_squares(lengths, 12)
    gaps = {}
    for size, b in zip(lengths.tolist(), which.tolist(), strict=True):
        def total(after):
            counts = {}
            for g in after.values():
                if g:
                    counts[g] = counts.get(g, 0) + 1
            return sum(v * v for v in counts.values())
        sums = [total(gaps | {x: g - size}) for x, g in gaps.items() if g >= size] + [total(gaps | {-1: 12 - size})]
        gaps[b] = gaps.get(b, 12) - size
        assert gaps[b] >= 0 and total(gaps) == min(sums)


def test_pretokens_match_the_library(spark):
    import pyarrow as pa

    from tickgraph.llm import bytescan, tokens

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    rng = np.random.default_rng(1)
    letters = list("ab'strevlmd 12 \n\t.!é Жß½  ")
    texts = ["".join(rng.choice(letters, rng.integers(0, 30))) for _ in range(2000)]
    texts += ["a" + chr(c) + chr(c) + "b" for c in range(0x500) if not 0xD800 <= c < 0xE000]
    ids, counts = tokens.Encoder(path).encode(*bytescan.texts_of(pa.array(texts)))
    ends = np.cumsum(counts)
    for t, e, n in zip(texts, ends, counts, strict=True):
        assert ids[e - n : e].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)
