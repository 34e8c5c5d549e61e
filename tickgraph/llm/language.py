"""Language ID of pages by evidence fusion: text likelihoods, declared markup language, address suffix and host priors."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as B
from ..sources.scratch import Scratch

BUCKETS = 1 << 14
#: Languages that country suffixes of addresses speak for.
COUNTRIES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl"}
_DROPPED = re.compile(r"(?is)<(script|style|nav|footer)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
_LANG = re.compile(r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b")
_URL = re.compile(r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::\d+)?([^?#]*)")


def page_text(html: str) -> str:
    """What a page shows: tags, comments, scripts, styles, navigation and footers left out."""
    return _DROPPED.sub(" ", html)


def declared_language(html: str) -> str:
    m = _LANG.search(html)
    return m[1].lower() if m else ""


def address_of(url: str) -> tuple[str, str, str]:
    """(host, domain, language that the suffix or the first path part names, or '')."""
    m = _URL.match(url)
    if not m:
        return "", "", ""
    host = m[1].lower().strip(".")
    parts = host.split(".")
    first = m[2].strip("/").split("/")[0].lower()
    named = COUNTRIES.get(parts[-1], "") or (first if re.fullmatch(r"[a-z]{2}", first) else "")
    return host, ".".join(parts[-3:]) if len(parts) > 2 and len(parts[-2]) <= 3 else ".".join(parts[-2:]), named


def gram_counts(text: str) -> np.ndarray:
    """Counts of character trigrams (bytes, lower case, each word between blanks) in BUCKETS hash buckets."""
    data = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode(), np.uint8).astype(np.uint64)
    if len(data) < 3:
        return np.zeros(BUCKETS, np.int64)
    key = data[:-2] << B.U64(16) | data[1:-1] << B.U64(8) | data[2:]
    return np.bincount((B.splitmix(key) % B.U64(BUCKETS)).astype(np.int64), minlength=BUCKETS)


class TextModel:
    """Trigram log-probabilities of each language, from summed counts with add-half smoothing."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = sorted(counts)
        table = np.stack([counts[k] + 0.5 for k in self.languages]) if counts else np.zeros((0, BUCKETS))
        self.log = np.log(table / table.sum(axis=1, keepdims=True)) if counts else table

    def likelihoods(self, text: str, power: float = 0.5) -> np.ndarray:
        """Log-likelihoods less their maximum, as of n ** power independent trigrams: neighbours repeat evidence."""
        n = gram_counts(text)
        total = n.sum()
        if not total:
            return np.zeros(len(self.languages))
        scores = self.log @ n / total * total**power
        return scores - scores.max()


def fit(docs: DataFrame, most: int = 4000) -> TextModel:
    """From at most `most` documents with a language, chosen by a hash of their id; counts are summed on executors."""
    rows = docs.where("lang is not null and text is not null and doc_id is not null").select("doc_id", "lang")
    chosen = F.broadcast(rows.orderBy(F.xxhash64("doc_id"), "doc_id", "lang").limit(most).select("doc_id").distinct())

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                sums[lang] = sums.get(lang, 0) + gram_counts(text)
        for lang, n in sums.items():
            k = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(k), pa.array(n[k])], ["lang", "k", "n"])

    labelled = docs.where("lang is not null and text is not null").select("doc_id", "lang", "text").join(chosen, "doc_id")
    found = labelled.mapInArrow(run, "lang string, k long, n long").groupBy("lang", "k").agg(F.sum("n").alias("n"))
    counts: dict[str, np.ndarray] = {}
    for lang, k, n in found.collect():
        counts.setdefault(lang, np.zeros(BUCKETS))[k] = n
    return TextModel(counts)


def evidence(pages: DataFrame, model: TextModel) -> DataFrame:
    """(page_id, host, domain, declared, named, text[]): text holds a log-likelihood for each language."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            rows = []
            for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
                html = html or ""
                rows.append((*address_of(url or ""), declared_language(html), shared.value.likelihoods(page_text(html)).tolist()))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            arrays = [batch.column("page_id"), *[pa.array(c, pa.string()) for c in cols[:4]], pa.array(cols[4], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["page_id", "host", "domain", "named", "declared", "text"])

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return source.mapInArrow(run, "page_id long, host string, domain string, named string, declared string, text array<double>")


def _normal(column: str) -> str:
    return f"transform({column}, x -> x / aggregate({column}, 0D, (s, v) -> s + v))"


def _sums(df: DataFrame, keys: list[str], column: str, size: int, name: str) -> DataFrame:
    """The vector sum of `column` by keys, combined before the shuffle."""
    parts = [F.sum(F.get(F.col(column), F.lit(k))).alias(f"_{k}") for k in range(size)]
    return df.groupBy(*keys).agg(*parts).select(*keys, F.array(*[F.col(f"_{k}") for k in range(size)]).alias(name))


def identify(pages: DataFrame, docs: DataFrame, strength: float = 5.0, most: int = 4000) -> DataFrame:
    """(page_id, lang, probability, text_lang, declared, host) of each page.

    The posterior is the product of: the text's likelihood (trigrams, see TextModel); how often pages of a language
    declare it, and have an address that names it, both learned over all pages from the text's own posterior; and the
    prior of the host, which is the mean posterior of its pages (this one left out) drawn towards its domain's, and that
    towards all pages', each with the weight of `strength` pages. All of these are grouped sums, combined before the
    shuffle, so a host with a third of all pages is no hot group.

    Null or empty html or url is no evidence; such a page has the prior. Ties go to the first language by name. Without
    labelled documents the language is null. Repeated rows are judged alike; an empty table gives no rows.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "language")
    model = fit(docs, most)
    names = model.languages
    if not names:
        return pages.select(F.col("page_id").cast("long").alias("page_id"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"), F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("declared"), F.lit(None).cast("string").alias("host"))
    size = len(names)
    found = evidence(pages, model).withColumn("soft", F.transform("text", lambda x: F.exp(x)))
    found = scratch.write(found.withColumn("soft", F.expr(_normal("soft"))))
    every = _sums(found.withColumn("_", F.lit(1)), ["_"], "soft", size, "s").first()
    total = np.array(every["s"]) if every else np.zeros(size)
    prior = (total + 1) / (total.sum() + size)

    def reliability(column: str) -> np.ndarray:
        """log P(what the column says | language); rows: nothing, another language, each language."""
        said = F.when(F.col(column) == "", F.lit(-2)).otherwise(F.coalesce(F.array_position(F.array(*[F.lit(n) for n in names]), F.col(column)), F.lit(0)).cast("int") - 1)
        table = np.ones((size + 2, size)) * 0.5
        for k, s in _sums(found.withColumn("said", said), ["said"], "soft", size, "s").collect():
            table[k + 2] += np.array(s)
        return np.log(table / table.sum(axis=0))

    def term(column: str) -> list:
        table = reliability(column)
        out = []
        for k in range(size):
            c = F.when(F.col(column) == "", F.lit(float(table[0, k])))
            for j, n in enumerate(names):
                c = c.when(F.col(column) == n, F.lit(float(table[j + 2, k])))
            out.append(c.otherwise(F.lit(float(table[1, k]))))
        return out

    domains = scratch.write(_sums(found, ["domain"], "soft", size, "by_domain"))
    hosts = scratch.write(_sums(found, ["domain", "host"], "soft", size, "by_host"))
    joined = scratch.write(found.join(hosts, ["domain", "host"])).join(domains, "domain")
    said, suffix = term("declared"), term("named")
    posts = []
    n_domain = F.aggregate("by_domain", F.lit(0.0), lambda s, x: s + x) - 1
    n_host = F.aggregate("by_host", F.lit(0.0), lambda s, x: s + x) - 1
    for k in range(size):
        own = F.get("soft", F.lit(k))
        domain = (F.greatest(F.get("by_domain", F.lit(k)) - own, F.lit(0.0)) + strength * float(prior[k])) / (F.greatest(n_domain, F.lit(0.0)) + strength)
        host = (F.greatest(F.get("by_host", F.lit(k)) - own, F.lit(0.0)) + strength * domain) / (F.greatest(n_host, F.lit(0.0)) + strength)
        posts.append(F.get("text", F.lit(k)) + said[k] + suffix[k] + F.ln(host))
    scored = joined.withColumn("post", F.array(*posts)).withColumn("top", F.array_max("post"))
    mass = F.aggregate("post", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))
    listed = F.array(*[F.lit(n) for n in names])
    best = F.get(listed, F.array_position(F.col("post"), F.col("top")).cast("int") - 1)
    text_best = F.get(listed, F.array_position(F.col("text"), F.array_max("text")).cast("int") - 1)
    return scored.select("page_id", best.alias("lang"), F.round(1 / mass, 6).alias("probability"), text_best.alias("text_lang"), "declared", "host")


def brute_identify(pages: list[tuple], model: TextModel, strength: float = 5.0) -> dict[int, tuple[str, float]]:
    """The same on plain rows (page_id, url, html); for tests."""
    names, size = model.languages, len(model.languages)
    rows = []
    for i, url, html in pages:
        host, domain, named = address_of(url or "")
        text = model.likelihoods(page_text(html or ""))
        soft = np.exp(text) / np.exp(text).sum()
        rows.append((i, host, domain, named, declared_language(html or ""), text, soft))
    total = sum((r[6] for r in rows), np.zeros(size))
    prior = (total + 1) / (total.sum() + size)

    def table(at: int) -> dict[str, np.ndarray]:
        t = np.ones((size + 2, size)) * 0.5
        for r in rows:
            t[0 if r[at] == "" else names.index(r[at]) + 2 if r[at] in names else 1] += r[6]
        t = np.log(t / t.sum(axis=0))
        return {"": t[0]} | {n: t[k + 2] for k, n in enumerate(names)} | {None: t[1]}

    named_t, declared_t = table(3), table(4)
    out = {}
    for i, host, domain, named, declared, text, soft in rows:
        d = [r for r in rows if r[2] == domain]
        h = [r for r in d if r[1] == host]
        dom = (np.maximum(sum(r[6] for r in d) - soft, 0) + strength * prior) / (len(d) - 1 + strength)
        hos = (np.maximum(sum(r[6] for r in h) - soft, 0) + strength * dom) / (len(h) - 1 + strength)
        post = text + declared_t.get(declared, declared_t[None]) + named_t.get(named, named_t[None]) + np.log(hos)
        p = np.exp(post - post.max())
        out[i] = (names[int(np.argmax(post))], float(1 / p.sum()))
    return out


