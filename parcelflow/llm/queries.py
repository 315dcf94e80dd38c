"""The registered queries of the operators and, where SQL can express them, their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, conversations, decontaminate, flac, language, near_dup, pii, quality, runs, suffix_dedup, token_counts, token_files, url_filter
from .storage import table

#: Fixed rules that the url query judges by.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents", spread=True), public_tokenizers.path("piece_bpe_32k.model"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents", spread=True), table(spark, sf_dir, "benchmark"))


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents", spread=True))


def op4_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.text_media_features(table(spark, sf_dir, "documents", spread=True))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages", spread=True), URL_RULES)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_index(table(spark, sf_dir, "documents", spread=True), public_tokenizers.path("word_bpe_49k.json"), end=1)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents", spread=True), table(spark, sf_dir, "labels"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents", spread=True))


def op9_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents", spread=True))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents", spread=True), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digests(runs.repeat_tails(table(spark, sf_dir, "documents", spread=True)))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents", spread=True))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    return conversations.report(conversations.damaged(given), given)


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_decontaminate, op3_near_dup, op4_flac_media, op5_url_filter, op6_token_files, op7_quality, op8_suffix_dedup, op9_pii_spans, op10_byte_bpe, op11_periodic_runs, op12_language_id, op13_conversation_repair)}

ORACLE_SQL = {
    "op5_url_filter": """
WITH cut AS (
  SELECT row_number() OVER () AS n, page_id, regexp_extract(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END, '^[^?#]*') AS rest FROM pages
), parts AS (
  SELECT n, page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path FROM cut
), rules(verdict, rule_host, rule_path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fits AS (
  SELECT n, page_id, host, path, max_by(rule_host || rule_path, length(rule_host || rule_path) * 1000 + length(rule_host)) AS rule,
         max_by(verdict, length(rule_host || rule_path) * 1000 + length(rule_host)) AS found
  FROM parts
  LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY ALL
)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(found, 'allow') AS verdict FROM fits
""",
}
