"""Base states gather poses behind their joins, and the funnel gathers none."""

import pytest

from tracklume.plans import base_state_queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["base_state_objects", "base_state_funnel"])
def test_gathered_poses_are_not_moved(spark, name):
    plan = Q.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    if name == "base_state_funnel":
        assert "collect_list" not in plan
    else:
        assert "Join" not in plan[: plan.rindex("collect_list")] and "Join" in plan
