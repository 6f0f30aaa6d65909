"""What the stages of the pipeline hold in executors beside their own arrays."""

import os

import numpy as np
import psutil
import pyarrow as pa

import corpus_pipeline as P
from tracklume.llm import decontamination as D
from tracklume.llm import jaccard_join as J
from tracklume.llm import text as T
from tracklume.llm.scratch import BATCH

DOCS = "doc_id long, text string"


def rss():
    return psutil.Process(os.getpid()).memory_info().rss >> 20


def test_free_memory_is_given_back():
    """Arrays that lie between others, as tasks leave them, are free but for the system."""
    before = rss()
    held = [np.ones(100 << 7) for _ in range(3000)]
    held = held[::100]
    assert rss() - before > 150
    assert len(list(T.chunks(iter([pa.record_batch({"text": ["a b"]})])))) == 1
    assert rss() - before < 100


def test_no_second_kind_of_workers(spark, monkeypatch):
    """Rows that the driver makes don't pass through Python RDDs, for which each executor starts workers of their own."""
    docs = spark.createDataFrame([(i, f"one two three four five six {i // 2} seven eight nine ten" * 3) for i in range(40)], DOCS)
    bench = spark.createDataFrame([(1, "one two three four five six 7 seven eight nine ten")], "item_id long, text string")
    made = []
    parallelize = type(spark.sparkContext).parallelize
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", lambda *x, **y: made.append(x) or parallelize(*x, **y))
    assert J.jaccard_components(docs, 5, 80, 2).count() == 40
    assert D.contaminated(docs, bench).count() >= 2
    assert not made


def test_stages_pass_small_batches(spark):
    """Also what a stage leaves to its caller's write: of 24 texts of 0.8 MB a batch holds at most 6."""
    spark.conf.unset(BATCH)
    docs = spark.createDataFrame([(i, f"word{i} " * (1 << 17)) for i in range(24)], DOCS).coalesce(1)
    out = P.STAGES[0][1](spark, docs, "/root/testdata/sf0.001")
    sizes = out.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([x.num_rows], pa.int64())], names=["n"]) for x in batches), "n long")
    assert max(r.n for r in sizes.collect()) <= 6
