"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import decontaminate, embeddings, language, licences, lines, minhash, packing, quality, repeats, toxicity


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_benchmark_decontamination(spark, sf_dir):
    hits = decontaminate.find_windows(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(hits)


OP6_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bi AS (SELECT item_id, w, least(len(w), 10) AS n FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS k
        FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bi)),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS k
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
hit AS (SELECT g.doc_id, g.i, g.n, win.item_id FROM grams g JOIN win USING (n, k)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(words.n_hit, 0)::BIGINT AS n_hit, coalesce(its.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(its.names, '')) AS items_sha256, coalesce(words.n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN words USING (doc_id) LEFT JOIN its USING (doc_id)
"""

def op1_embedding_near_dedup(spark, sf_dir):
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op2_minhash_near_dedup(spark, sf_dir):
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark, sf_dir):
    packed = packing.pack(_table(spark, sf_dir, "documents"))
    return packed.select(F.col("row.doc_id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_suffix_array_dedup(spark, sf_dir):
    found = repeats.repeated_passages(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_quality_classifier(spark, sf_dir):
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_toxicity(spark, sf_dir):
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_line_dedup(spark, sf_dir):
    return lines.digest(_table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents),
x AS (SELECT doc_id, k, list_filter(regexp_split_to_array(lower(line), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS v FROM l),
big AS (SELECT doc_id, k, w, len(w) AS n FROM (
  SELECT doc_id, k, CASE WHEN len(v) >= 5 THEN list_sort(list_distinct(v)) ELSE [' ' || array_to_string(v, ' ')] END AS w FROM x WHERE len(v) > 0)),
cls AS (SELECT w, n, min((doc_id, k)) AS f, row_number() OVER () AS c FROM big GROUP BY w, n),
tok AS (SELECT c, n, f, unnest(w) AS t FROM cls),
df AS (SELECT t, count(*) AS d FROM tok GROUP BY t),
pre AS (SELECT * FROM (SELECT c, n, f, tok.t, row_number() OVER (PARTITION BY c ORDER BY d, tok.t) AS r FROM tok JOIN df USING (t)) WHERE r <= n - ceil(n * 0.75) + 1),
pairs AS (SELECT DISTINCT a.c AS a, b.c AS b FROM pre a JOIN pre b ON a.t = b.t AND b.f < a.f AND 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n)),
later AS (SELECT DISTINCT p.a AS c FROM pairs p JOIN cls x ON x.c = p.a JOIN cls y ON y.c = p.b
          WHERE 7 * len(list_intersect(x.w, y.w)) >= 3 * (x.n + y.n)),
gone AS (SELECT big.doc_id, big.k FROM big JOIN cls USING (w, n) LEFT JOIN later USING (c) WHERE later.c IS NOT NULL OR (big.doc_id, big.k) <> cls.f),
found AS (SELECT l.doc_id, count(*) AS n_lines, count(gone.k) AS n_removed, sha256(coalesce(string_agg(CASE WHEN gone.k IS NULL THEN line END, chr(10) ORDER BY l.k), '')) AS kept_sha256
          FROM l LEFT JOIN gone USING (doc_id, k) GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(f.n_lines, 0)::BIGINT AS n_lines, coalesce(f.n_removed, 0)::BIGINT AS n_removed, coalesce(f.kept_sha256, sha256('')) AS kept_sha256
FROM documents d LEFT JOIN found f USING (doc_id)
"""

def op5_licence_scan(spark, sf_dir):
    return licences.find_licences(_table(spark, sf_dir, "documents"))


def op9_language_id(spark, sf_dir):
    return language.identify(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS id, vec_id AS m FROM embeddings UNION SELECT p.b, r.m FROM r JOIN p ON p.a = r.id),
c AS (SELECT id, min(m) AS component_id FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.id = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""

OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, k FROM (
  SELECT doc_id, array_to_string(w[i : i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id AS id, doc_id AS m FROM documents UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.id),
c AS (SELECT id, min(m) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

QUERIES = {
    "op4_line_dedup": op4_line_dedup,
    "op5_licence_scan": op5_licence_scan,
    "op9_language_id": op9_language_id,
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_toxicity": op8_toxicity,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
}
SQL = {"op1_embedding_near_dedup": OP1_SQL, "op2_minhash_near_dedup": OP2_SQL, "op4_line_dedup": OP4_SQL, "op6_benchmark_decontamination": OP6_SQL}
