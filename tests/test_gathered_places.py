"""Events of one place are held once: what is worked out follows places, and rows of equal values follow each other."""

import glob
import random

import pyarrow.parquet as pq
import pytest

from made_tables import EVENTS, event, written
from oracle import same
from tracklume.plans import contact_queries as C
from tracklume.plans import geometry_queries as G

COPIED = ["circle_clearance", "circle_rect_clearance"]


def _copies(times, shift=3200, objects=7, n=60, values=9.0):
    own = random.Random(5)
    rows = [event(i, own.choice([0.5, 3.2]), i % 9, own.choice(["purchase", "view", "click"]), own.uniform(0.0, values)) for i in range(n)]
    return [(r[0] + k * shift, r[1], r[2] + k * objects, *r[3:]) for r in rows for k in range(times)]


@pytest.mark.parametrize("name", COPIED)
def test_files_grow_less_than_pairs(spark, tmp_path, name):
    """Eight times the copies are 64 times the pairs; their files are far from that."""
    sizes, counts = [], []
    for times in (5, 40):
        folder, _ = written(spark, tmp_path / str(times), events=(_copies(times), EVENTS))
        G.QUERIES[name](spark, folder).write.parquet(out := f"{tmp_path}/out-{times}")
        found = [pq.ParquetFile(f).metadata for f in glob.glob(f"{out}/*.parquet")]
        counts.append(sum(m.num_rows for m in found))
        sizes.append(sum(m.row_group(r).column(i).total_compressed_size for m in found for r in range(m.num_row_groups) for i in range(m.num_columns)))
    assert counts[1] == 64 * counts[0]
    assert sizes[1] < 0.35 * counts[1]


@pytest.mark.parametrize("name", COPIED)
def test_shares_of_a_place(spark, tmp_path, monkeypatch, name):
    """A place of more events than a row may hold, and events without an id, which have no place."""
    monkeypatch.setattr(G, "COPIES", 3)
    rows = _copies(7) + [(None, *event(0, 0.5, 3, kind, 5.0)[1:]) for kind in ("purchase", "purchase", "view", "click")]
    folder, db = written(spark, tmp_path, events=(rows, EVENTS))
    same(G.QUERIES[name], G.ORACLE[name], spark, folder, db)


def test_rectangles_move_with_the_input(spark, tmp_path):
    """Eight times the poses: what is shuffled doesn't grow with the pairs."""
    store, sent = spark.sparkContext._jsc.sc().statusStore(), []
    for times in (5, 40):
        folder, _ = written(spark, tmp_path / str(times), events=(_copies(times, shift=3203, objects=1), EVENTS))
        before = _stages(spark, store)
        C.near_rectangles(spark, folder).write.parquet(f"{tmp_path}/out-{times}")
        sent.append(sum(s.shuffleWriteRecords() for k, s in _stages(spark, store).items() if k not in before))
    assert spark.read.parquet(f"{tmp_path}/out-40").count() > 20 * 40 * len(_copies(1))
    assert sent[1] < 10 * sent[0] and sent[1] < 20 * len(_copies(40))


def test_rectangles_of_shares(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(G, "COPIES", 3)
    rows = _copies(7, values=60.0) + [(None, *event(0, 0.5, 3, kind, 5.0)[1:]) for kind in ("purchase", "view")] + [event(60 + i, 0.5, 1, kind, None) for i, kind in enumerate(("purchase", "view"))]
    folder, db = written(spark, tmp_path, events=(rows, EVENTS))
    same(C.near_rectangles, C.ORACLE["near_rectangles"], spark, folder, db)


def _stages(spark, store):
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    found = store.stageList(None, False, False, none, None)
    return {found.apply(i).stageId(): found.apply(i) for i in range(found.size())}
