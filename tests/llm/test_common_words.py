"""Benchmarks of common words: what the checks would pass is found, whatever the space keeps and however many items there are."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
from test_llm_operators import DOCS, exhaustive  # noqa: E402

from tracklume.llm import decontamination as D


@pytest.mark.parametrize(("dimensions", "n"), [(256, 20), (2, 20), (16, 200)])
def test_exchanged_names(spark, monkeypatch, dimensions, n):
    """Items of 28 words that most documents have and four names; each copied once with other names."""
    monkeypatch.setattr(D, "DIMENSIONS", dimensions)
    own = random.Random(31)
    common, rare = [f"c{i}" for i in range(60)], iter(f"r{i}" for i in range(1_000_000))
    rows = [(i, " ".join(own.sample([*own.choices(common, k=60), *(next(rare) for _ in range(60))], 120))) for i in range(200)]
    items = []
    for i in range(n):
        words = [*own.choices(common, k=28)]
        for at in (3, 9, 15, 21):
            words.insert(at, next(rare))
        text = " ".join(words[:24]) + ". " + " ".join(words[24:])
        items.append((i, text))
        for kind in range(2):  # verbatim, and with the names exchanged
            copy = [next(rare) if kind and x[0] == "r" else x for x in words]
            rows.append((1000 + 10 * i + kind, " ".join([*own.choices(common, k=own.randint(0, 60)), *copy, *own.choices(common, k=own.randint(0, 60))])))
    wanted = exhaustive(rows, items)
    assert sum(d % 10 == 1 for d, _ in wanted if d >= 1000) > n / 3
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in D.contaminated(docs, bench).collect()}
    assert found <= wanted and len(found) >= 0.9 * len(wanted), (len(found), len(wanted))
