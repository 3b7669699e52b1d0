"""Queries of the operators on training text, and SQL that gives the same rows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from burnish.functions.scratch import stage
from burnish.llm import align, bpe, decontaminate, exact_dedup, katz, language, pages, pseudonyms, repeats, simhash, toxicity, urls, whitening
from checks.registry import Query, table

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

QUERIES["op8_exact_dedup"] = lambda spark, sf: exact_dedup.exact_duplicates(table(spark, sf, "documents"))
ORACLES["op8_exact_dedup"] = r"""
  WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents)
  SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
         row_number() OVER w = 1 AS kept, sha256(body) AS text_sha256
  FROM d WINDOW w AS (PARTITION BY body ORDER BY n DESC, doc_id)"""

QUERIES["op4_simhash_near_dedup"] = lambda spark, sf: simhash.near_duplicates(table(spark, sf, "documents"))


def _bpe_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    coded = bpe.round_trip(table(spark, sf, "documents"), vocabulary)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES["op6_bpe_encode_decode"] = _bpe_round_trip


def _fold(folds: int, held_out: int) -> Column:
    """Whether a row is held out, by its doc_id alone; null without a doc_id."""
    return F.crc32(F.col("doc_id").cast("string")) % folds == held_out


def _language(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents")
    profiles = stage(language.learn_profiles(documents.where(~_fold(3, 1))), "profiles")
    return language.identify(documents, profiles).withColumn("held_out", F.coalesce(_fold(3, 1), F.lit(False)))


QUERIES["op9_language_id"] = _language


def _toxicity(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents")
    return toxicity.learn_and_score(documents, table(spark, sf, "labels").where(~_fold(5, 0))).withColumn("held_out", F.coalesce(_fold(5, 0), F.lit(False)))


QUERIES["op5_toxicity"] = _toxicity


#: The rules that the query's contract names.
URL_RULES = [
    urls.Rule("allow", "org/"),
    urls.Rule("block", "example.org/es/"),
    urls.Rule("block", "example.org/en/1"),
    urls.Rule("allow", "com/fr/"),
    urls.Rule("block", "com/de/"),
]
QUERIES["op3_url_filter"] = lambda spark, sf: urls.filter_urls(table(spark, sf, "pages"), URL_RULES)

QUERIES["op10_html_extraction"] = lambda spark, sf: pages.extract(table(spark, sf, "pages"))
QUERIES["op7_decontamination"] = lambda spark, sf: decontaminate.leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))

QUERIES["op1_repeated_strings"] = lambda spark, sf: repeats.remove_repeats(table(spark, sf, "documents")).select(
    "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
)

#: Stands for a key that would come from a secret store.
PSEUDONYM_KEY = b"a key for the registered query"
QUERIES["op2_pii_pseudonyms"] = lambda spark, sf: pseudonyms.pseudonymise(table(spark, sf, "documents"), PSEUDONYM_KEY)


def _katz(spark: SparkSession, sf: str) -> DataFrame:
    scores, _ = katz.katz_scores(table(spark, sf, "documents"), ~_fold(5, 1), order=2)
    return scores.withColumn("held_out", F.coalesce(_fold(5, 1), F.lit(False)))


QUERIES["op11_katz_scores"] = _katz

QUERIES["op12_tokenizer_alignment"] = lambda spark, sf: align.alignment_report(
    table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
)

QUERIES["op13_embedding_whitening"] = lambda spark, sf: whitening.whiten(table(spark, sf, "embeddings"))
