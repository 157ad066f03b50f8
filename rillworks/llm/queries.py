"""Registered queries of this subpackage: each applies one operator to its whole table and derives the asked columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillworks.llm import blob_ledger, hosts, languages, leaks, merkle, near_copies, packing, pages, quality, repeats, scoring, shared, spellings, sql, tokenfiles


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_joined(text: Column) -> Column:
    """The words of a text joined by one space; NULL: empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " "))


def op1_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_copies.classes(_table(spark, sf_dir, "documents"))
    return rows.select(F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = languages.fit(docs, shared.training("doc_id", 5))
    rows = languages.predict(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", shared.held_out("doc_id", 5).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repeats.without_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(words_joined(F.col("text")), 256).alias("kept_sha256"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"), shared.training("doc_id", 5))
    rows = quality.score(docs, model)
    score = F.col("quality_score")
    return rows.select("doc_id", shared.held_out("doc_id", 5).alias("held_out"), score.alias("score"), (score >= 0.3).cast("int").alias("predicted"))


def op2_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = leaks.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return rows.select(F.col("key").alias("doc_id"), "item_id", "coverage")


def op3_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = packing.pieces(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), "before_space", with_ids=False)
    return packing.placed(parts).withColumnRenamed("key", "doc_id")


def op6_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hosts.judged(_table(spark, sf_dir, "documents"))
    return rows.select(F.col("key").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_tokenfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.new_path(spark)
    tokenfiles.write(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), "white_space", 2)
    return tokenfiles.read(spark, path, with_ids=False).select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op8_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    learn = shared.training("doc_id", 10)
    subwords = scoring.Subwords(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    cut_rows = scoring.cut_texts(docs, learn, subwords)
    rows = scoring.scores(docs, learn, subwords, scoring.fit(docs, learn, subwords, cut_rows=cut_rows), cut_rows=cut_rows)
    return rows.select(F.col("key").alias("doc_id"), shared.held_out("key", 10).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = blob_ledger.findings(docs, blob_ledger.scan(docs, shared.new_path(spark)))
    base = [r.kind for r in blob_ledger.BASE]
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return rows.select("doc_id", *[F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in base],
                       F.sha2(blob_ledger.shown(of(*base)), 256).alias("base_sha256"), blob_ledger.shown(F.col("spans")).alias("spans"))


def op12_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spellings.variants(_table(spark, sf_dir, "documents"), slip=97)
    return rows.select("word", "form", "root", "n", "n_near", "form_n")


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = merkle.leaf(*[F.col(c) + 1 if c == "n_chars" else F.col(c) for c in columns])
    rows = docs.select("doc_id", "lang", merkle.leaf(*[F.col(c) for c in columns]).alias("leaf"), F.when(tampered, changed).alias("claim"))
    return merkle.proofs(rows, "lang", "doc_id", "leaf", "claim")


QUERIES = {f.__name__: f for f in (op1_near_copies, op2_leaks, op3_pages, op4_packing, op5_language, op6_hosts, op7_tokenfiles, op8_scoring, op9_repeats, op10_quality,
                                      op11_secrets, op12_spellings, op13_manifest)}

_SPLIT = r"string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+')"

ORACLE: dict[str, str] = {
    "op6_hosts": f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, list_filter({_SPLIT}, lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
  runs AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
  twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, run) AS n FROM runs) WHERE n > 1),
  covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, i + unnest(range(8)) AS p FROM twice) GROUP BY doc_id),
  m AS (SELECT d.doc_id, source, CAST(len(w) AS bigint) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS bigint) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS bigint) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS bigint) AS n_dup_lines, CAST(coalesce(n, 0) AS bigint) AS n_repeat_words FROM d LEFT JOIN covered USING (doc_id)),
  r AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
  f AS (SELECT *, base_failed OR 5 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_words OR word_chars > 15 * n_words AS failed FROM r),
  h AS (SELECT source, count(*) AS n, sum(failed::int) AS bad FROM f WHERE source IS NOT NULL GROUP BY source),
  a AS (SELECT sum(bad) / sum(n) AS mean FROM h),
  v AS (SELECT mean, avg(pow(bad / n - mean, 2) - mean * (1 - mean) / n) AS spread FROM h, a GROUP BY mean),
  p AS (SELECT mean, CASE WHEN spread > 0 THEN least(1000.0, greatest(1.0, mean * (1 - mean) / spread - 1)) ELSE 1000.0 END AS weight FROM v),
  q AS (SELECT source, (bad + weight * mean) / (n + weight) AS rate FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(rate, 0) <= 0.5 AS kept FROM f LEFT JOIN q USING (source)""",
}
ORACLE |= sql.ORACLE
