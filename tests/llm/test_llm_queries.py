"""Queries of the training-data operators against their SQL, and the rest against the tables they read."""

import hashlib
import html
import re
import sys
import zlib
from pathlib import Path

import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import connect, same  # noqa: E402

from tracklume.llm import registry  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id")["text"]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(name, spark, db):
    same(registry.queries()[name], registry.oracle_sql()[name], spark, SF, db)


def test_toxicity(spark):
    sf = SF.replace("0.001", "0.1")
    found = registry.queries()["op2_toxicity"](spark, sf).toPandas()
    held = found.doc_id.map(lambda x: zlib.crc32(str(x).encode()) % 5 == 0)
    assert (found.held_out == held).all() and found.score.between(0, 1).all()
    assert ((found.score >= 0.5).astype(int) == found.predicted).all()
    labelled = found.merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id").query("held_out")
    assert (labelled.predicted[labelled.toxic == 1]).mean() > 0.9
    assert (labelled.predicted[labelled.toxic == 0]).mean() < 0.03


def test_decontamination(spark):
    sf = SF.replace("0.001", "0.01")
    found = registry.queries()["op3_decontamination"](spark, sf).toPandas()
    texts = pd.read_parquet(f"{sf}/documents.parquet").set_index("doc_id")["text"].map(lambda x: " ".join(x.split()))
    items = pd.read_parquet(f"{sf}/benchmark.parquet").set_index("item_id")["text"].map(lambda x: " ".join(x.split()))
    truth = {(d, i) for d, t in texts.items() for i, x in items.items() if x in t}
    got = set(zip(found.doc_id, found.item_id, strict=True))
    assert len(truth) > 10 and len(truth & got) >= 0.9 * len(truth)
    assert len(got - truth) <= 0.1 * len(truth)


def test_sharding(spark, docs):
    found = registry.queries()["op4_sharding"](spark, SF).toPandas()
    assert sorted(found.doc_id) == sorted(docs.index) and set(found.law) == {"bytes"} and found.grown_shard.isna().all()
    sizes = docs.map(lambda x: len(x.encode()) + 16)
    assert (found.set_index("doc_id")["size"] == sizes).all()
    assert (found.text_crc32 == found.doc_id.map(lambda d: zlib.crc32(docs[d].encode()))).all()
    by = found.groupby("shard")
    assert (by.slot.max() + 1 == by.size()).all() and (by.slot.min() == 0).all()
    target = sizes.sum() / 40
    assert ((by["size"].sum() - target).abs() <= 2 * sizes.max()).all()
    placed = found.sort_values("doc_id")
    assert placed["shard"].is_monotonic_increasing


def test_packing(spark, docs):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = registry.queries()["op6_packing"](spark, SF).toPandas()
    assert set(found.doc_id) == set(docs.index) and found.length.max() <= 2048
    for doc, rows in found.groupby("doc_id"):
        ids = np.array([*whole.encode(docs[doc], add_special_tokens=False).ids, 0], "<u4")
        rows = rows.sort_values("piece")
        assert rows.piece.tolist() == list(range(len(rows))) and rows.length.sum() == len(ids)
        assert (len(rows) == 1) == (len(ids) <= 2048) and (rows.length.iloc[1:] == 2048).all()
        for r in rows.itertuples():
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for _, rows in found.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert rows.offset.tolist() == [0, *rows.length.cumsum().tolist()[:-1]] and rows.length.sum() <= 2048
    assert found.sequence_id.nunique() <= 1.02 * -(-found.length.sum() // 2048) + 2


def plain_article(page):
    """The article of a page of these tables by patterns alone: its element, without what is marked as something else."""
    found = re.search(r"<article>(.*?)</article>", page or "", re.S)
    body = re.sub(r"<!--.*?-->|<(script|style|aside|form|nav)\b.*?</\1>|<div class=\"?ad\"?>.*?</div>", "", found[1] if found else "", flags=re.S)
    body = re.sub(r"</?(?:p|h\d|div|ul|ol|li|table|tr|td|section|pre|blockquote)\b[^>]*>", "\0", re.sub(r"<br/?>", " ", body))
    blocks = [re.sub(r"\s+", " ", html.unescape(x)).strip() for x in re.sub(r"<[^>]*>", "", body).split("\0")]
    return "\n\n".join(x for x in blocks if x)


def test_html(spark):
    sf = SF.replace("0.001", "0.1")
    pages = pd.read_parquet(f"{sf}/pages.parquet").set_index("page_id")
    found = registry.queries()["op8_html_text"](spark, sf).toPandas().set_index("page_id")
    assert len(found) == len(pages) and (found.url == pages.url.reindex(found.index)).all()
    assert found.text.to_dict() == pages.html.map(plain_article).to_dict()


def test_html_and_media(spark, docs):
    pages = registry.queries()["op8_html_text"](spark, SF).toPandas()
    assert len(pages) == 50 and (pages.n_chars == pages.text.str.len()).all() and (pages.n_chars > 0).all()
    found = registry.queries()["op9_media"](spark, SF).toPandas().set_index("doc_id")
    for doc, text in docs.items():
        data = text.encode()
        padded = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        row = found.loc[doc]
        assert (row.n_bytes, row.payload_bytes, row.payload_sha256, row.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert row.media_bytes > row.payload_bytes and len(row.feature) == 16


def test_pipeline(spark):
    """The stages' decisions on a small table with one case of each."""
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "jaccard_join", "substring_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas(), docs.schema)
        assert 0.5 * before < docs.count() <= before
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert set(pieces.doc_id) == {r.doc_id for r in docs.select("doc_id").collect()}


def test_stages_keep_columns(spark):
    """Columns named like the operators' results, and documents without n_chars."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet").drop("n_chars").selectExpr("*", "doc_id + 1 as score", "doc_id + 2 as n_words", "'mine' as kept_text")
    for name in ("toxicity", "substring_dedup"):
        found = stages[name](spark, docs, SF)
        assert found.columns == docs.columns
        rows = found.select("doc_id", "score", "n_words", "kept_text").collect()
        assert len(rows) > 100 and all(r[1:] == (r[0] + 1, r[0] + 2, "mine") for r in rows)
