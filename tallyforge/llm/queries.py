"""The dealt operators as queries over the tables, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import alignment, language_model, media, mixing, near_dup, packing, periodic, quality, secrets, sharding, simhash, toxicity, warc
from tallyforge.llm.shared import materialise, shared_dir, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op3_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_digests(packing.pack(table(spark, sf_dir, "documents")))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op5_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op6_media_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(table(spark, sf_dir, "documents"))


def op7_gated_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(table(spark, sf_dir, "documents"))


def op8_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.find_groups(table(spark, sf_dir, "documents"), shingle=2)


def op9_warc_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = materialise(warc.write_files(warc.plan_records(table(spark, sf_dir, "pages")), f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"), "warc-files")
    number = lambda c: F.substring_index(c, ":", -1).try_cast("long")
    checked = F.when(F.col("problem").isNull(), number(F.col("record_id"))).otherwise(F.raise_error(F.concat_ws(" ", F.col("record_id"), F.col("problem"))).cast("long"))
    return warc.read_files(files).select(checked.alias("page_id"), "payload_bytes", "payload_digest", "record_type", number(F.col("refers_to")).alias("refers_to"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_anchor_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.find_groups(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digests(periodic.collapse_runs(table(spark, sf_dir, "documents"), plant=True))


def op13_segment_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_source_mixing": op2_source_mixing,
    "op3_retrieval_packing": op3_retrieval_packing,
    "op4_secret_scan": op4_secret_scan,
    "op5_hash_tree_sharding": op5_hash_tree_sharding,
    "op6_media_sniffing": op6_media_sniffing,
    "op7_gated_language_model": op7_gated_language_model,
    "op8_circulant_minhash": op8_circulant_minhash,
    "op9_warc_reader": op9_warc_reader,
    "op10_toxicity": op10_toxicity,
    "op11_anchor_simhash": op11_anchor_simhash,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_segment_alignment": op13_segment_alignment,
}

ORACLES = {
    "op2_source_mixing": """
WITH RECURSIVE counts AS (SELECT source, COUNT(*) AS n FROM documents GROUP BY source),
rates AS (SELECT source, POW(n, 0.5) * (SELECT SUM(n) FROM counts) / ((SELECT SUM(POW(n, 0.5)) FROM counts) * n) AS rate FROM counts),
parted AS (SELECT source, rate / GREATEST(1, CEIL(rate / 32.0)) AS rate, CAST(GREATEST(1, CEIL(rate / 32.0)) AS BIGINT) AS parts FROM rates),
steps AS (
  SELECT source, rate, parts, 0 AS k, -rate AS log_p, EXP(-rate) AS total FROM parted
  UNION ALL
  SELECT source, rate, parts, k + 1, log_p + LN(rate / (k + 1)), total + EXP(log_p + LN(rate / (k + 1))) FROM steps
  WHERE k < CEIL(rate + 12 * SQRT(rate) + 30)),
cdf AS (SELECT source, parts, LIST(total) AS totals FROM steps GROUP BY source, parts),
asked AS (SELECT d.*, c.totals, UNNEST(RANGE(c.parts)) AS part, 'mix-1|' || COALESCE(CAST(d.doc_id AS VARCHAR), '') AS word FROM documents d JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source),
drawn AS (
  SELECT doc_id, text, lang, source, n_chars, SUM(LEN(LIST_FILTER(totals, lambda x: x <= CAST(('0x' || SUBSTR(MD5(CASE WHEN part = 0 THEN word ELSE word || '|' || part END), 1, 13)) AS BIGINT) / 4503599627370496.0))) AS n
  FROM asked GROUP BY ALL),
copies AS (SELECT *, UNNEST(RANGE(CAST(n AS BIGINT))) AS nth FROM drawn WHERE n > 0)
SELECT doc_id, text, lang, source, n_chars, CAST(nth AS INTEGER) AS copy,
       MD5('mix-1|order|' || COALESCE(CAST(doc_id AS VARCHAR), '') || '|' || CAST(nth AS VARCHAR)) AS shuffle_key
FROM copies""",
}
