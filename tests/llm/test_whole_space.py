"""The latent space is fitted on every passage of the corpus."""

import numpy as np

from tracklume.llm import decontamination as D

DOCS = "doc_id long, text string"


def matrix(space, texts, weight):
    """Dense rows of the passages of texts, one by one."""
    rows = []
    for text in texts:
        _, terms = D._terms(D.pa.array([text]))
        for a in range(0, len(terms), D.BLOCK):
            part = terms[a : a + D.BLOCK * D.BLOCKS]
            row, norm = np.zeros(len(space.basis)), np.zeros(D.TERMS)
            for t in part:
                norm[t] += space.idf[t]
                if space.place[t] >= 0:
                    row[space.place[t]] += space.idf[t]
            rows.append(row / max(np.sqrt((space.idf[part] ** 2).sum()), 1e-9) * weight)
    return np.array(rows)


def test_every_passage_counts(spark, monkeypatch):
    """Of 2,600 documents the last 100 alone hold words of an item together: products of all passages know them, and both ways agree."""
    items = ["alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma", "one two three four five six seven"]
    texts = [f"filler{i % 50} word{i % 31} plain{i % 17} alpha one" if i < 2_500 else "theta iota kappa nu xi two three " * 6 for i in range(2_600)]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    space = D.latent_space(docs, items)
    a = np.r_[matrix(space, texts, 1.0), matrix(space, items, D.BENCHMARK_WEIGHT)]
    rows = docs.selectExpr("text", "1d as weight").union(spark.createDataFrame([(x, D.BENCHMARK_WEIGHT) for x in items], "text string, weight double"))
    products = D._products(rows, space.idf, space.place, len(space.basis))
    assert np.allclose(products, a.T @ a, rtol=1e-4, atol=1e-4)
    assert np.allclose(D._summed(rows, space.idf, space.place, np.eye(len(space.basis))), a.T @ a, rtol=1e-3, atol=1e-3)
    sizes = []
    products_of = D._products
    monkeypatch.setattr(D, "_products", lambda passages, *x: sizes.append(passages.count()) or products_of(passages, *x))
    D.latent_space(docs, items)
    assert sizes == [2_602]


def test_products_stay_in_the_cluster(spark, monkeypatch):
    """The driver gets matrices of (terms x dimensions) alone, and no slices are left."""
    items = [" ".join(f"w{i}x{j}" for j in range(20)) for i in range(15)]
    docs = spark.createDataFrame([(i, f"filler{i % 7} {items[i % 15]}" if i % 3 else None) for i in range(60)], DOCS)
    shapes, made, gathered, products = [], [], D._gathered, D._products
    monkeypatch.setattr(D, "DIMENSIONS", 8)
    monkeypatch.setattr(D, "_gathered", lambda slices, shape: shapes.append(shape) or gathered(slices, shape))
    monkeypatch.setattr(D, "_products", lambda *x: made.append(products(*x)) or made[-1])
    space = D.latent_space(docs, items)
    assert shapes == [(len(space.basis), 8)] * 2 and len(space.basis) > 100
    path = spark._jvm.org.apache.hadoop.fs.Path(made[0].scratch.root)
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def test_only_texts_that_hold_an_item_are_projected(spark, monkeypatch):
    """An item's rarest words in a heap are no reason to project a text."""
    item = " ".join(f"w{j}" for j in range(30))
    texts = [f"before {item} after", " ".join(reversed(item.split())), "nothing of it"] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    search, sizes, candidates = D.Search([5], [item], D.latent_space(docs, [item])), [], D.candidates
    monkeypatch.setattr(D, "candidates", lambda texts, *x: sizes.append(len(texts)) or candidates(texts, *x))
    assert list(search.find(D.pa.array(texts, D.pa.string()))) == [(0, 0)] and sizes == [1]
    assert not search.find(D.pa.array(texts[1:], D.pa.string())) and sizes == [1]
