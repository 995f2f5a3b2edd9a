"""The operators over the whole tables, one query each, in the forms that their contracts fix."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerpulse.llm import (
    conversations,
    decontaminate,
    html_extract,
    order_minhash,
    packing,
    quality,
    ranked_search,
    secret_scan,
    simhash,
    suffix_dedup,
    surrogates,
    token_files,
    wordpiece,
)

#: The key of the surrogates; a deployment passes its own to the operator.
SURROGATE_KEY = "ledgerpulse-demonstration-key"
#: The id that the token files set after each document.
END_ID = 2

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable[[SparkSession, str], DataFrame]):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


@query
def op1_surrogates(spark, directory):
    replaced = surrogates.replace_personal_data(table(spark, directory, "documents"), SURROGATE_KEY)
    return replaced.select("doc_id", "text", "surrogates", F.size("surrogates").alias("n_replaced"))


@query
def op2_token_counts(spark, directory):
    pieces = wordpiece.pieces_of(public_tokenizers.path("piece_bpe_32k.model"))
    return wordpiece.count_tokens(table(spark, directory, "documents"), pieces).select("doc_id", "n_words", "n_tokens", "n_unknown")


@query
def op3_best_fit_packing(spark, directory):
    return packing.pack_documents(table(spark, directory, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op4_order_minhash(spark, directory):
    return order_minhash.edited_fingerprints(table(spark, directory, "documents"))


@query
def op5_quality(spark, directory):
    return quality.score_documents(table(spark, directory, "documents"), table(spark, directory, "labels"))


@query
def op6_suffix_dedup(spark, directory):
    return suffix_dedup.removal_report(table(spark, directory, "documents"))


@query
def op7_decontamination(spark, directory):
    found = decontaminate.contamination(table(spark, directory, "documents"), table(spark, directory, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query
def op8_secret_scan(spark, directory):
    # the tables hold no labelled findings; they are derived from the documents, and a fifth of these is held out
    held_out = quality.fold_of(F.col("doc_id")) == 0
    found = secret_scan.scan(table(spark, directory, "documents"), training=~held_out)
    return found.select(
        "doc_id", held_out.alias("held_out"), "place", "nth", F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"), "probability", "secret"
    )


@query
def op9_html_extraction(spark, directory):
    pages = html_extract.extract_main_text(table(spark, directory, "pages"))
    return pages.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


@query
def op10_simhash(spark, directory):
    return simhash.simhash_components(table(spark, directory, "documents"))


@query
def op13_ranked_search(spark, directory):
    return ranked_search.rank_documents(table(spark, directory, "documents"), table(spark, directory, "benchmark"))


@query
def op12_token_files(spark, directory):
    tokens = token_files.token_table(table(spark, directory, "documents"), public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    return tokens.select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op11_conversation_repair(spark, directory):
    return conversations.repair_conversations(conversations.damage(table(spark, directory, "conversations")))
