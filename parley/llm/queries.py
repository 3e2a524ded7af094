"""The registered queries of this subpackage and their check SQL."""

from __future__ import annotations

import string

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import (
    bpe, byte_fst, html_main, lm_score, merkle, order_minhash, packing, pii, quality_rules, spelling, spotsigs, toxicity, url_filter,
)
from parley.llm.merkle_sql import manifest_sql
from parley.session import spread

VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return packing.pack_documents(docs, public_tokenizers.path(VOCABULARY))


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    judged = quality_rules.judged(docs, carry=["doc_id"])
    return judged.select("row.doc_id", *quality_rules.MEASURES[:5], "base_failed", "kept")


def op5_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = spread(_table(spark, folder, "documents").select("doc_id", "text"))
    return bpe.digests(docs, public_tokenizers.path(VOCABULARY))


def op6_lm(spark: SparkSession, folder: str) -> DataFrame:
    return lm_score.scored(_table(spark, folder, "documents").select("doc_id", "text"))


def op7_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    classes, _ = order_minhash.classified(docs)
    return classes.select("row.doc_id", "class_id", "class_size", "keeper")


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, folder, "labels"))
    judged = toxicity.scored(spread(docs), model, carry=["doc_id"])
    return judged.select(
        "row.doc_id",
        toxicity.held_out(F.col("row.doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op3_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    found = pii.found(docs, carry=["doc_id"])
    counts = [
        F.size(F.array_compact(F.transform("base", pii.one_if(number)))).cast("long").alias(f"n_{kind}")
        for number, kind in enumerate(pii.KINDS[:4])
    ]
    return found.select(
        "row.doc_id",
        *counts,
        F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"),
        pii.listed(F.col("spans")).alias("spans"),
    )


def op4_urls(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages").select("page_id", "url")
    return url_filter.judged(pages).select("row.page_id", "host", "path", "rule", "verdict")


def op9_spotsigs(spark: SparkSession, folder: str) -> DataFrame:
    return spotsigs.compared_with_next(_table(spark, folder, "documents").select("doc_id", "text"))


def op10_html(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages").select("page_id", "url", "html")
    texts = html_main.extracted(pages, carry=["page_id", "url"])
    return texts.select(
        "row.page_id",
        "row.url",
        F.col("main_text").alias("text"),
        F.length("main_text").cast("long").alias("n_chars"),
    )


def op11_merkle(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    seen = F.when(chosen, lower).otherwise(F.col("text"))
    return merkle.manifest(docs, seen={"text": seen}).withColumnRenamed("id", "doc_id")


def op12_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = spread(_table(spark, folder, "documents").select("doc_id", "text"))
    path = public_tokenizers.path(RANKS)
    return byte_fst.digests(docs, path, public_tokenizers.PATTERN)


def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return spelling.grouped(spelling.vocabulary(spread(docs), drop_one_in=31))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_quality": op2_quality,
    "op3_pii": op3_pii,
    "op4_urls": op4_urls,
    "op5_bpe": op5_bpe,
    "op6_lm": op6_lm,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_toxicity": op8_toxicity,
    "op9_spotsigs": op9_spotsigs,
    "op10_html": op10_html,
    "op11_merkle": op11_merkle,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_spelling": op13_spelling,
}

ORACLE: dict[str, str] = {
    "op2_quality": r"""
WITH docs AS (
  SELECT row_number() OVER () AS k, doc_id, lang, source, coalesce(text, '') AS t FROM documents
), split AS (
  SELECT k, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM docs
), words AS (
  SELECT k, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM split
), windows AS (
  SELECT k, i, word || ' ' || lead(word, 1) OVER p || ' ' || lead(word, 2) OVER p AS g
  FROM words WINDOW p AS (PARTITION BY k ORDER BY i)
), twice AS (
  SELECT k, i FROM windows WHERE g IS NOT NULL QUALIFY count(*) OVER (PARTITION BY k, g) > 1
), reps AS (
  SELECT k, count(DISTINCT i + d) AS n FROM twice CROSS JOIN (VALUES (0), (1), (2)) AS o(d) GROUP BY k
), measured AS (
  SELECT docs.k, doc_id, lang, source, len(ws) AS n_words,
         coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(reps.n, 0) AS n_repeat_words, len(ls) AS n_lines
  FROM docs JOIN split USING (k) LEFT JOIN reps USING (k)
), based AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured
), vals AS (
  SELECT k, lang, source, base_failed, r.rule AS rule, r.v AS v, r.spread AS spread, r.both_ends AS both_ends
  FROM (SELECT *, unnest([
    {'rule': 1, 'v': 1000 * n_symbols // nullif(n_words, 0), 'spread': 30, 'both_ends': false},
    {'rule': 2, 'v': 1000 * n_dup_lines // nullif(n_lines, 0), 'spread': 60, 'both_ends': false},
    {'rule': 3, 'v': 1000 * n_repeat_words // nullif(n_words, 0), 'spread': 80, 'both_ends': false},
    {'rule': 4, 'v': 100 * word_chars // nullif(n_words, 0), 'spread': 40, 'both_ends': true}]) AS r FROM based)
), buckets AS (
  SELECT lang, source, rule, spread, both_ends,
         (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) AS bucket, count(*) AS n
  FROM vals WHERE NOT base_failed AND v IS NOT NULL GROUP BY ALL
), merged AS (
  SELECT 0 AS lvl, lang, source, rule, bucket, sum(n) AS n FROM buckets GROUP BY ALL
  UNION ALL SELECT 1, lang, NULL, rule, bucket, sum(n) FROM buckets GROUP BY ALL
  UNION ALL SELECT 2, NULL, NULL, rule, bucket, sum(n) FROM buckets GROUP BY ALL
), ranked AS (
  SELECT *, sum(n) OVER (PARTITION BY lvl, lang, source, rule) AS total,
         sum(n) OVER (PARTITION BY lvl, lang, source, rule ORDER BY bucket) AS seen FROM merged
), quart AS (
  SELECT lvl, lang, source, rule, total, min(bucket) FILTER (seen * 4 >= total) AS lo,
         min(bucket) FILTER (seen * 4 >= 3 * total) AS hi FROM ranked GROUP BY ALL
), chosen AS (
  SELECT a.lang, a.source, a.rule,
         CASE WHEN a.total >= 100 THEN a.lo WHEN b.total >= 100 THEN b.lo ELSE c.lo END AS lo,
         CASE WHEN a.total >= 100 THEN a.hi WHEN b.total >= 100 THEN b.hi ELSE c.hi END AS hi
  FROM quart a JOIN quart b ON b.lvl = 1 AND a.rule = b.rule AND a.lang IS NOT DISTINCT FROM b.lang
  JOIN quart c ON c.lvl = 2 AND a.rule = c.rule WHERE a.lvl = 0
), broken AS (
  SELECT DISTINCT k FROM vals JOIN chosen c ON vals.rule = c.rule
   AND vals.lang IS NOT DISTINCT FROM c.lang AND vals.source IS NOT DISTINCT FROM c.source
  WHERE v > hi + 6 * greatest(hi - lo, spread) OR both_ends AND v < lo - 6 * greatest(hi - lo, spread)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND k NOT IN (SELECT k FROM broken) AS kept
FROM based
""",
    "op11_merkle": manifest_sql(),
}
