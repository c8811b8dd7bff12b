"""The registered query of each operator, over its whole table, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillworks.llm import (
    arc, covertree, crf, exact_dedup, factorisation, importance, lshforest, mixing, packing, phrases, sanitise, variants, wavelet,
)
from tillworks.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return register


@query("op7_exact_dedup", """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT *, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size FROM t
  WINDOW w AS (PARTITION BY text_sha256))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""")
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decisions(table(spark, sf_dir, "documents"), digests=True)


@query("op6_mix_sources", r"""
WITH d AS (SELECT doc_id, source, md5('mix:' || doc_id) AS k,
  CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM s),
b AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight,
  coalesce(sum(3 * source_size) OVER o, 0) AS cap_before, coalesce(sum(weight) OVER o, 0) AS weight_before
  FROM w WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, weight * (total - cap_before) > 3 * source_size * (all_weight - weight_before) AS capped FROM b),
t AS (SELECT source, source_size, CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE)
  ELSE CAST(weight * (total - coalesce(sum(3 * source_size) FILTER (capped) OVER (), 0)) AS DOUBLE)
    / CAST(sum(weight) FILTER (NOT capped) OVER () AS DOUBLE) END AS target FROM c),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM t),
p AS (SELECT d.doc_id, d.size, e.*, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) - epochs * source_size
  ELSE 0 END AS rest, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - start)) AS BIGINT) AS taken
FROM p""")
def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_words(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


@query("op8_arc_to_warc", """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages),
g AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS o
  FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN o = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN o = page_id THEN NULL ELSE o END AS refers_to FROM g""")
def op8_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arc.round_trip(table(spark, sf_dir, "pages")).select(
        arc.key_of("record_id").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        arc.key_of("refers_to_id").cast("bigint").alias("refers_to"))


@query("op10_best_fit_packing")
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"))


VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@query("op5_wavelet_tokens")
def op5_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.encode_and_read(table(spark, sf_dir, "documents"), VOCABULARY).select(
        "doc_id", "start", "n_tokens", "ids_crc32")


@query("op9_crf_toxicity")
def op9_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = crf.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", F.col("predicted").cast("int").alias("predicted"),
                        F.expr("concat_ws(',', transform(spans, s -> concat(s.start, ':', s.end)))").alias("spans"))


@query("op3_factorisation_quality")
def op3_factorisation_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = factorisation.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", F.col("predicted").cast("int").alias("predicted"))


@query("op1_sanitise_pii")
def op1_sanitise_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise.report(table(spark, sf_dir, "documents"))


@query("op2_cover_tree_dedup")
def op2_cover_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op4_lsh_forest_join")
def op4_lsh_forest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lshforest.near_duplicates(table(spark, sf_dir, "documents"))


#: CRC-32 of the UTF-8 bytes of column f, half a byte at a time; the list is the fixed table of its 16 half bytes.
CRC32 = """xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(f), '..'), lambda x: CAST('0x' || x AS BIGINT)),
  lambda c, b: xor(xor(xor(c, b) >> 4, h[(xor(c, b) & 15) + 1]) >> 4, h[(xor(xor(c, b) >> 4, h[(xor(c, b) & 15) + 1]) & 15) + 1]),
  4294967295))"""
HALF_BYTES = """[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948,
  3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]"""
WORD_LIST = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


@query("op11_importance_resampling", f"""
WITH d AS (SELECT doc_id, {WORD_LIST} AS w FROM documents),
b AS (SELECT {WORD_LIST} AS w FROM benchmark),
df AS (SELECT doc_id, unnest(list_concat(w, list_transform(list_zip(w[:len(w) - 1], w[2:]), lambda p: p[1] || ' ' || p[2]))) AS f
  FROM d WHERE len(w) > 0),
bf AS (SELECT unnest(list_concat(w, list_transform(list_zip(w[:len(w) - 1], w[2:]), lambda p: p[1] || ' ' || p[2]))) AS f
  FROM b WHERE len(w) > 0),
dn AS (SELECT doc_id, f, count(*) AS n FROM df GROUP BY ALL),
names AS (SELECT f, {CRC32} % 10000 AS bucket FROM (SELECT f FROM df UNION SELECT f FROM bf) CROSS JOIN (SELECT {HALF_BYTES} AS h)),
s AS (SELECT bucket, sum(n) AS s FROM dn JOIN names USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bf JOIN names USING (f) GROUP BY bucket),
gains AS (SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM s) + 10000) AS DOUBLE)
  / CAST((coalesce(s, 0) + 1) * ((SELECT coalesce(sum(t), 0) FROM t) + 10000) AS DOUBLE))) AS BIGINT) AS gain
  FROM s FULL JOIN t USING (bucket)),
weights AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(sum(n * gain) / sum(n)) AS BIGINT) AS weight
  FROM dn JOIN names USING (f) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) AS n_words,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('7:' || doc_id)[:8] AS BIGINT) + 0.5::DOUBLE)
  / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN weights USING (doc_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place,
  count(*) FILTER (n_words >= 20) OVER () AS able FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= able * 25 // 100 THEN place END AS rank FROM ranked""")
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = importance.importance(docs, table(spark, sf_dir, "benchmark"))
    return found.select("row.doc_id", "n_features", "weight", "score", "rank")


@query("op12_spelling_variants", f"""
WITH runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) AS run FROM documents),
told AS (SELECT run, n, {CRC32} AS c FROM (SELECT run, doc_id || ':' || run AS f, count(*) AS n FROM runs GROUP BY ALL)
  CROSS JOIN (SELECT {HALF_BYTES} AS h)),
cut AS (SELECT CASE WHEN c % 31 = 0 THEN run[:c % length(run)] || run[c % length(run) + 2:] ELSE run END AS word, n FROM told),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
less AS (SELECT word, n, i, word[:i] || word[i + 2:] AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (SELECT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT l.word, w.word, w.n FROM less l JOIN words w ON l.rest = w.word
  UNION SELECT w.word, l.word, l.n FROM less l JOIN words w ON l.rest = w.word),
near AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, encode(other))) AS form, max(other_n) AS form_n FROM pairs GROUP BY word),
forms AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * n THEN form END AS form,
  CASE WHEN form_n >= 10 * n THEN form_n END AS form_n FROM words w LEFT JOIN near USING (word)),
paths AS (WITH RECURSIVE p AS (SELECT word, word AS at FROM forms UNION ALL
  SELECT p.word, f.form FROM p JOIN forms f ON p.at = f.word WHERE f.form IS NOT NULL) SELECT * FROM p),
ends AS (SELECT p.word, p.at AS root FROM paths p JOIN forms f ON p.at = f.word WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)""")
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"))


@query("op13_phrase_decontamination", f"""
WITH d AS (SELECT doc_id, {WORD_LIST} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORD_LIST} AS w FROM benchmark),
phrases AS (SELECT DISTINCT item, unnest(list_transform(range(greatest(1, len(w) - 9)), lambda i: array_to_string(w[i + 1:i + 10], ' ')))
  AS phrase, least(len(w), 10) AS size FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM phrases),
starts AS (SELECT doc_id, w, size, unnest(range(len(w) - size + 1)) AS i FROM d JOIN sizes ON len(w) >= size),
found AS (SELECT doc_id, i, size, array_to_string(w[i + 1:i + size], ' ') AS phrase FROM starts),
hits AS (SELECT doc_id, i, size, item FROM found JOIN phrases USING (phrase, size)),
covered AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS pos FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hits GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)""")
def op13_phrase_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = phrases.contamination(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.coalesce(F.aggregate("runs", F.lit(0).cast("bigint"), lambda a, r: a + r["end"] - r["start"]), F.lit(0))
    names = F.coalesce(F.array_join("items", ","), F.lit(""))
    return found.select("row.doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast(
        "bigint").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
