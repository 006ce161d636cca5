"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.llm import (
    brown_lm,
    license_scan,
    line_dedup,
    mixing,
    near_dedup,
    packing,
    quality_classifier,
    quality_rules,
    spelling,
    suffix_dedup,
    token_counts,
    topk,
    whitening,
)
from tallyflow.llm.native_sql import license_sql, mixing_sql
from tallyflow.llm.scratch import Scratch

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@_query("op1_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    pieces = packing.decompose(_documents(spark, sf_dir), tokenizer)
    return packing.number_sequences(packing.with_digest(pieces))


@_query("op3_token_counts")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


@_query("op5_quality_rules")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score_quality(_documents(spark, sf_dir))


@_query("op6_quality_classifier")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality_classifier.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", quality_classifier.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


_LINES_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
w AS (
  SELECT doc_id, i, line, row_number() OVER (ORDER BY doc_id, i) AS place,
         regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS ws
  FROM l),
f AS (SELECT ws, min(place) AS place FROM w WHERE len(ws) > 0 GROUP BY ws),
v AS (
  SELECT place, cut, CASE WHEN cut < 0 THEN ws ELSE list_concat(ws[1:cut], ws[cut + 2:]) END AS v
  FROM (SELECT place, ws, unnest(range(-1, len(ws))) AS cut FROM f WHERE len(ws) >= 8)),
near AS (
  SELECT DISTINCT a.place
  FROM v a JOIN v b ON a.v = b.v AND b.place < a.place AND (a.cut = b.cut OR a.cut < 0 OR b.cut < 0)),
gone AS (
  SELECT w.place FROM w JOIN f ON w.ws = f.ws
  WHERE w.place <> f.place OR f.place IN (SELECT place FROM near))
SELECT w.doc_id, count(*) AS n_lines, count(gone.place) AS n_removed,
       sha256(coalesce(string_agg(w.line, chr(10) ORDER BY w.i) FILTER (WHERE gone.place IS NULL), '')) AS text_sha256
FROM w LEFT JOIN gone ON w.place = gone.place
GROUP BY w.doc_id"""


@_query("op10_line_dedup", _LINES_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.dedup_lines(_documents(spark, sf_dir))
    return cut.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


@_query("op4_minhash_near_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(_documents(spark, sf_dir))


@_query("op7_suffix_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return suffix_dedup.with_digest(suffix_dedup.remove_repeats(docs))


@_query("op2_license_scan", license_sql())
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_documents(spark, sf_dir)).withColumn("notices", F.array_join("notices", ","))


@_query("op9_source_mixing", mixing_sql())
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = Scratch(spark).keep(mixing.measured(_documents(spark, sf_dir)).drop("text"), "measured")
    mixed = mixing.draw_sample(measured)
    return mixed.select("doc_id", "topic", "tokens", F.round("probability", 6).alias("probability"), "sampled")


_TOP_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5"""


@_query("op8_exact_topk", _TOP_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


@_query("op11_lm_scoring")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    model = brown_lm.train(docs, F.coalesce(~held_out, F.lit(True)))
    return brown_lm.score_texts(docs, F.coalesce(held_out, F.lit(False)).alias("held_out"), model)


_SPELLING_SQL = r"""
WITH RECURSIVE t AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS t),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]{7,}')),
                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
hashed AS (
  SELECT run, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id || ':' || run, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 | (unicode(c) >> 6), 128 | (unicode(c) & 63)] END))),
    lambda c, b: xor(c >> 8, t.t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM runs, t),
w AS (
  SELECT word, count(*) AS n
  FROM (SELECT CASE WHEN h % 31 = 0 THEN substring(run, 1, CAST(h % length(run) AS INT)) || substring(run, CAST(h % length(run) AS INT) + 2)
                    ELSE run END AS word FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
v AS (
  SELECT word, n, cut, CASE WHEN cut < 1 THEN word ELSE substring(word, 1, cut - 1) || substring(word, cut + 1) END AS v
  FROM (SELECT word, n, unnest(range(0, length(word) + 1)) AS cut FROM w)),
near AS (
  SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n
  FROM v a JOIN v b ON a.v = b.v AND a.word <> b.word AND (a.cut = b.cut OR a.cut = 0 OR b.cut = 0)),
best AS (
  SELECT word, n, other, other_n, count(*) OVER (PARTITION BY word) AS n_near,
         row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS rank
  FROM near),
f AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * w.n THEN other END AS form,
         CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n
  FROM w LEFT JOIN (SELECT * FROM best WHERE rank = 1) b ON w.word = b.word),
r AS (
  SELECT word, form, word AS root, form AS further FROM f
  UNION ALL
  SELECT r.word, r.form, f.word, f.form FROM r JOIN f ON r.further = f.word)
SELECT f.word, f.form, r.root, CAST(f.n AS BIGINT) AS n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n
FROM f JOIN r ON f.word = r.word WHERE r.further IS NULL"""


@_query("op12_spelling_variants", _SPELLING_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_documents(spark, sf_dir))


@_query("op13_embedding_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
