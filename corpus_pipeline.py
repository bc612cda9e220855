"""Corpus cleaning: quality rules, quality classifier, near duplicates, decontamination, tokens.

STAGES are (name, function) pairs; each function takes (spark, docs, sf_dir) and
returns the rows that go on, with the columns of documents; the last stage adds
its own. A stage's result is written and read again before the next one, so a
lost executor never makes more than one stage run again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import chosen_path, decontaminate, line_crf, quality_rules, sentencepiece_codec
from barloom.llm.catalog import quality_model
from barloom.sources.scratch import cut

#: The classifier's threshold; documents below it go.
MIN_QUALITY = 0.3


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the host-level rules keep."""
    return quality_rules.filter_documents(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier scores as good; fitted on the labelled rows of the corpus."""
    scored = line_crf.scored(docs, quality_model(spark, sf_dir), score="_quality")
    return scored.where(F.col("_quality") >= MIN_QUALITY).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return chosen_path.deduplicated(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with a benchmark item."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their piece ids."""
    out = sentencepiece_codec.encoded(docs, sentencepiece_codec.Vocabulary.load(), ids="piece_ids")
    return out.withColumn("n_pieces", F.size("piece_ids").cast("long"))


STAGES = [
    ("quality rules", rules),
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("SentencePiece encoding", encoded),
]
#: The classifier and the piece encoder have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), "pipeline-" + name.lower().replace(" ", "-"))
    return docs
