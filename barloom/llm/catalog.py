"""Queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import chosen_path, decontaminate, html_text, language_id, license_scan, line_crf, phrase_index, prefix_trie, quality_rules, repeated_windows, sentencepiece_codec, tool_calls, warc
from barloom.llm.common import crc_of
from barloom.llm import sql as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op5_quality_rules", S.QUALITY_RULES)
def op5(spark, sf):
    found = quality_rules.rule_table(table(spark, sf, "documents"))
    q = lambda m: F.col(f"_q_{m}").alias(m)
    return found.select("doc_id", q("n_words"), q("word_chars"), q("n_symbols"), q("n_dup_lines"), q("n_repeat_words"),
                        q("base_failed"), q("kept"), F.round("_q_host_rate", 9).alias("host_rate"))


@query("op9_warc_archive", S.WARC)
def op9(spark, sf):
    back = warc.round_trip(table(spark, sf, "pages"))
    return back.select(F.col("record_id").try_cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                       F.col("refers_to").cast("long").alias("refers_to"), "verified")


@query("op3_decontaminate", S.DECONTAMINATE)
def op3(spark, sf):
    found = decontaminate.report(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def quality_model(spark: SparkSession, sf: str):
    """Fitted on the labelled documents whose remainder is not 0."""
    docs, labels = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels").select("doc_id", "quality")
    return line_crf.train(docs.where(crc_of("doc_id") % 5 != 0).join(labels, "doc_id"))


@query("op2_quality_classifier")
def op2(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return line_crf.scored(docs, quality_model(spark, sf)).select(
        "doc_id", F.coalesce(crc_of("doc_id") % 5 == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op6_language_id")
def op6(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs.where(crc_of("doc_id") % 4 != 2))
    return language_id.predicted(docs.drop("lang"), model).select(
        "doc_id", F.coalesce(crc_of("doc_id") % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query("op8_html_extraction")
def op8(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    found = html_text.extracted(pages, path="path_")
    return found.select("page_id", "url", F.col("text_").alias("text"), F.length("text_").cast("long").alias("n_chars"), F.col("path_").alias("path"))


@query("op10_sentencepiece")
def op10(spark, sf):
    vocabulary = sentencepiece_codec.Vocabulary.load()
    found = sentencepiece_codec.checked(table(spark, sf, "documents").select("doc_id", "text"), vocabulary)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "round_trip")


@query("op7_chosen_path_join", S.NEAR_DUPLICATES)
def op7(spark, sf):
    return chosen_path.near_duplicates(table(spark, sf, "documents"))


@query("op1_license_scan", S.LICENCES)
def op1(spark, sf):
    return license_scan.scan(license_scan.corpus_files(table(spark, sf, "documents")), keep=("doc_id",))


@query("op4_tool_calls", S.TOOL_CALLS)
def op4(spark, sf):
    found = tool_calls.formatted(*tool_calls.conversation_calls(table(spark, sf, "conversations")))
    return found.withColumn("errors", F.array_join("errors", ","))


@query("op13_substring_dedup", S.REPEATED_WINDOWS)
def op13(spark, sf):
    found = repeated_windows.without_repeats(table(spark, sf, "documents").select("doc_id", "text"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, span: n + span["stop"] - span["start"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op11_phrase_collocations", S.COLLOCATIONS)
def op11(spark, sf):
    found = phrase_index.collocations(table(spark, sf, "documents"))
    return found.select(F.col("group").alias("lang"), "rank", "phrase", "a", "l", "r", "n", "score")


@query("op12_prefix_trie", S.PREFIX_TRIE)
def op12(spark, sf):
    return prefix_trie.trie(table(spark, sf, "conversations"))
