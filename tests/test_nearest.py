"""The nearest of an hour: pairs stay inside tasks, in whatever blocks; odd places as in SQL."""

import math
import random

from made_tables import EVENTS, event, written
from oracle import same
from tracklume.operators import nearest as N
from tracklume.plans import geometry_queries as G


def _rows_of_steps(spark, run):
    """The most rows that a step of a query puts out."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsList().size()
    run()
    most, found = 0, store.executionsList()
    for i in range(before, found.size()):
        at = found.apply(i).executionId()
        values, nodes = store.executionMetrics(at), store.planGraph(at).allNodes()
        for node in (nodes.apply(j) for j in range(nodes.size())):
            for metric in (node.metrics().apply(k) for k in range(node.metrics().size())):
                told = values.get(metric.accumulatorId())
                if metric.name() == "number of output rows" and told.isDefined():
                    most = max(most, int(told.get().replace(",", "")))
    return most


def test_pairs_leave_no_task(spark, tmp_path):
    """1,200 events of an hour make 288,000 pairs of different places."""
    rows = [event(i, 0.5, i % 9, "purchase" if i % 3 == 0 else "view", i / 17) for i in range(1200)]
    folder, db = written(spark, tmp_path, events=(rows, EVENTS))
    same(G.risk_labels, G.ORACLE["risk_labels"], spark, folder, db)
    assert 1200 <= _rows_of_steps(spark, lambda: G.risk_labels(spark, folder).collect()) < 12 * 1200


def test_blocks(spark, tmp_path, monkeypatch):
    """Hours that are cut into parts and shares; equal distances, objects without an id and values that are no numbers."""
    own = random.Random(11)
    odd = [None, math.nan, math.inf, -math.inf, 1e9, 50.0, 50.0, 60.0, 40.0]
    rows = [event(i, own.choice([0.5, 2.2]), i % 9, own.choice(["purchase", "view", "click"]), round(own.expovariate(0.02), 2)) for i in range(260)]
    rows += [event(1000 + i, own.choice([4.1, 5.3, 6.7]), 1, kind, own.choice(odd if kind == "view" else [x for x in odd if x is None or not math.isinf(x)])) for i, kind in enumerate(["purchase", "view", "view"] * 30)]
    rows += [event(2000 + i, 8 + i % 2, 1, "purchase" if i % 4 == 0 else "view", None if i % 2 else math.nan if i % 3 else 5.0) for i in range(24)]
    rows += [event(3000 + i, 11.5, 1, kind, value) for i, (kind, value) in enumerate([("purchase", 3.0), ("view", None), ("click", None)])]
    rows += [(None, *event(0, hour, 1, "view", 4.0)[1:]) for hour in (0.5, 8, 13)] + [event(4000, 13, 1, "purchase", 4.0)]
    folder, db = written(spark, tmp_path, events=(rows, EVENTS))
    same(G.risk_labels, G.ORACLE["risk_labels"], spark, folder, db)
    monkeypatch.setattr(N, "OTHERS", 13)
    monkeypatch.setattr(N, "PLACES", 7)
    same(G.risk_labels, G.ORACLE["risk_labels"], spark, folder, db)


def test_ties_that_rounding_makes(spark, tmp_path):
    """Squares that differ where distances don't, to nine digits: the least id tells."""
    rows = [event(100, 0.5, 1, "purchase", 50.0)]
    rows += [event(200 + 100 * i, 0.5, 2, "view", 80.0 + d) for i, d in enumerate((0.0, 1e-9, -1e-9, 3e-10, 2e-8))]
    folder, db = written(spark, tmp_path, events=(rows, EVENTS))
    same(G.risk_labels, G.ORACLE["risk_labels"], spark, folder, db)
