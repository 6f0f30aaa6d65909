"""Short chunks, clashing column names and empty tables, through whole operators."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracklume.llm import text as T
from tracklume.llm.jaccard_join import jaccard_components
from tracklume.llm.sharding import byte_shards
from tracklume.llm.substring_dedup import least_phrases, remove_repeats

DOCS = "doc_id long, text string"


@pytest.mark.parametrize("n", range(7))
def test_grams_of_few_words(n):
    w = T.words(pa.array([" ".join("abcdefg"[:n])]))
    assert len(T.grams(w.hashes, 5)) == n and [len(x) for x in least_phrases(w, 13, 5)] == [n, n]
    wide = T.words(pa.array([" ".join("abcdefgh")]))
    assert (T.grams(w.hashes, 5)[: max(0, n - 4)] == T.grams(wide.hashes, 5)[: max(0, n - 4)]).all()


@pytest.mark.parametrize("n", range(6))
def test_tables_of_few_words(spark, n):
    words = " ".join("abcdef"[:n])
    docs = spark.createDataFrame([(1, words)], DOCS)
    assert [tuple(r) for r in remove_repeats(docs).collect()] == [(1, words, n, 0, words)]
    assert [tuple(r) for r in jaccard_components(docs, 4, 85).select("doc_id", "n_shingles", "component_id").collect()] == [(1, 0 if not n else max(1, n - 3), 1)]


def test_short_last_batch(spark):
    """10,000 rows fill an Arrow batch; the row after them stands alone in the next."""
    docs = spark.range(10_001).coalesce(1).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 10_000, F.concat(F.lit("some words of document "), "id")).otherwise("x y").alias("text"))
    assert remove_repeats(docs).agg(F.count("*"), F.sum("n_removed")).first()[:] == (10_001, 0)
    assert jaccard_components(docs, 4, 85).where("doc_id = component_id").count() == 10_001


def test_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(20))
    names = ["a", "b", "x", "_a", "own_0", "_total", "_first", "_part", "_tie", "_within", "size"]
    docs = spark.createDataFrame([(i, text, *([i] * len(names))) for i in range(3)], ", ".join([DOCS, *(f"{x} long" for x in names)]))
    found = remove_repeats(docs).orderBy("doc_id")
    assert found.columns == [*docs.columns, "n_words", "n_removed", "kept_text"]
    assert [(r["a"], r["x"], r["_part"], r["n_removed"]) for r in found.collect()] == [(0, 0, 0, 0), (1, 1, 1, 20), (2, 2, 2, 20)]
    placed = byte_shards(docs, "doc_id", F.lit(5), 2)
    assert placed.columns == [*docs.columns, "shard", "slot"]
    assert {(r["doc_id"], r["_total"], r["_part"], r["_within"], r["size"]) for r in placed.collect()} == {(i, i, i, i, 5) for i in range(3)}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    assert remove_repeats(docs).count() == jaccard_components(docs, 4, 85).count() == byte_shards(docs, "doc_id", F.lit(5), 2).count() == 0
