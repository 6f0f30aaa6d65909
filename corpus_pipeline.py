"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again before the next; all but the last return the
columns of ``documents``.

Python workers live from stage to stage, so what a stage leaves in them counts
in all later ones.  Stages pass texts to Python in batches of 4 MB, and the
session keeps that setting: a stage's last step runs when its caller writes it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklume.llm.decontamination import decontaminated
from tracklume.llm.jaccard_join import jaccard_components
from tracklume.llm.packing_query import pack_documents
from tracklume.llm.scratch import BATCH, SMALL, Scratch
from tracklume.llm.substring_dedup import remove_repeats
from tracklume.llm.toxicity import learn, scores
from tracklume.llm.toxicity_query import held_out

#: Near copies: words of a shingle, and the similarity from which on two documents link.
SHINGLE, PERCENT = 5, 80


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _in_small_batches(stage: Stage) -> Stage:
    """``stage`` and the steps of it that run later, with texts passed to Python in batches of about SMALL bytes."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(BATCH, str(SMALL))
        return stage(spark, docs, sf_dir)

    return run


def _aside(docs: DataFrame, *names: str) -> DataFrame:
    """``docs`` with its own columns of these names, which a stage's operator would replace, under other ones."""
    return docs.withColumnsRenamed({x: f"_own_{x}" for x in names if x in docs.columns})


def _back(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, those put aside among them."""
    return found.select(*(F.col(f"_own_{x}").alias(x) if f"_own_{x}" in found.columns else F.col(x) for x in docs.columns))


@_in_small_batches
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar, learned from the labels that aren't held out, does not find toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    grammar = learn(docs, labels, "doc_id", "toxic", ~held_out())
    return _back(scores(_aside(docs, "score"), grammar, keep_text=True).where("score < 0.5"), docs)


@_in_small_batches
def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each component of near copies; rows of one doc_id stay or go together, null ones stay."""
    found = jaccard_components(docs, SHINGLE, PERCENT)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)


@_in_small_batches
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the words of 13-word windows that an earlier one has; untouched texts stay as they are."""
    cut = F.col("n_removed") > 0
    found = remove_repeats(_aside(docs, "n_words", "n_removed", "kept_text", "_a", "_b"))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(cut, F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return _back(found.withColumn("text", F.when(cut, F.col("kept_text")).otherwise(F.col("text"))), docs)


@_in_small_batches
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


@_in_small_batches
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with the sequences that hold them."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("jaccard_join", jaccard_join),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL has no tokenizer, no grammar and no latent space: tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.write(docs, f"{i}-{name}")
    return docs
