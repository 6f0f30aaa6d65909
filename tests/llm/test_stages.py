"""The pipeline's stages, each against a brute-force version of what it must do to its own input."""

import zlib

import pandas as pd
import pytest

import corpus_pipeline as P
from tracklume.llm.toxicity import learn, scores
from tracklume.llm.toxicity_query import held_out

SF = "/root/testdata/sf0.01"
WINDOW = 13


def words(text):
    return (text or "").encode().split()


def lower(text):
    return [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words(text)]


def near_components(rows):
    """From each doc_id to the smallest of its component: sets of five-word shingles that share eight tenths."""
    sets = []
    for doc, text in rows:
        w = lower(text)
        sets.append((doc, {tuple(w[i : i + P.SHINGLE]) for i in range(len(w) - P.SHINGLE + 1)} or ({tuple(w)} if w else set())))
    root = {doc: doc for doc, _ in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= P.PERCENT * len(s | t):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {doc: top(doc) for doc in root}


def without_repeats(rows):
    """From each doc_id to its text, without the words of windows that start in a smaller doc_id."""
    owner = {}
    for doc, text in sorted(rows):
        w = words(text)
        for i in range(len(w) - WINDOW + 1):
            owner.setdefault(tuple(w[i : i + WINDOW]), doc)
    out = {}
    for doc, text in rows:
        w = words(text)
        gone = {p for i in range(len(w) - WINDOW + 1) if owner[tuple(w[i : i + WINDOW])] < doc for p in range(i, i + WINDOW)}
        out[doc] = b" ".join(x for p, x in enumerate(w) if p not in gone).decode() if gone else text
    return out


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    """Each stage's input as the stage before wrote it, and the last one's output."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in P.STAGES:
        out[name] = docs.toPandas()
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return out | {"end": docs.toPandas()}


def rows(frame):
    return list(zip(frame.doc_id.tolist(), frame.text, strict=True))


def test_toxic_documents_go(spark, inputs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    grammar = learn(docs, spark.read.parquet(f"{SF}/labels.parquet"), "doc_id", "toxic", ~held_out())
    kept = {r.doc_id for r in scores(docs.select("doc_id", "text"), grammar).where("score < 0.5").collect()}
    assert set(inputs["jaccard_join"].doc_id) == kept and len(kept) < len(inputs["toxicity"])
    labels = pd.read_parquet(f"{SF}/labels.parquet")
    clean = labels[(labels.toxic == 0) & labels.doc_id.isin(inputs["toxicity"].doc_id)]
    assert clean.doc_id.isin(kept).mean() > 0.97


def test_one_of_each_component_stays(inputs):
    before, after = inputs["jaccard_join"], inputs["substring_dedup"]
    of = near_components(rows(before))
    assert sorted(after.doc_id) == sorted(set(of.values())) and len(after) < len(before)
    assert dict(rows(after)) == {d: t for d, t in rows(before) if of[d] == d}


def test_repeated_passages_go(inputs):
    before, after = inputs["substring_dedup"], inputs["decontamination"]
    assert dict(rows(after)) == without_repeats(rows(before)) and dict(rows(after)) != dict(rows(before))
    assert list(after.columns) == list(before.columns) and (after.n_chars == after.text.str.len()).all()


def test_benchmark_documents_go(inputs):
    before, after = inputs["decontamination"], inputs["packing"]
    flat = lambda x: " ".join((x or "").split())
    items = [flat(x) for x in pd.read_parquet(f"{SF}/benchmark.parquet").text]
    leaking = {d for d, t in rows(before) if any(x and x in flat(t) for x in items)}
    kept = set(after.doc_id)
    assert not leaking & kept and kept <= set(before.doc_id)
    assert len(set(before.doc_id) - leaking - kept) <= 0.02 * len(before)


def test_every_token_is_packed(inputs):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = inputs["end"]
    assert set(pieces.doc_id) == set(inputs["packing"].doc_id) and pieces.groupby("sequence_id").length.sum().max() <= 2048
    for doc, text in rows(inputs["packing"]):
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = pieces[pieces.doc_id == doc].sort_values("piece")
        assert own.length.sum() == len(ids)
        assert [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own.itertuples()] == own.ids_crc32.tolist()
