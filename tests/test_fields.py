"""Look-ups in stored fields never collect the field in the driver, however small the planner takes it for."""

import pytest

import __spark_entry__ as entry


def broadcast_products(df):
    """Broadcasts of a plan that hold an exploded table; totals of one are as small as their keys."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    found = []
    for n, line in enumerate(lines):
        if "BroadcastExchange" in line:
            for below in lines[n + 1 :]:
                if depth(below) <= depth(line) or "Aggregate(" in below:
                    break
                found += [below] if "Generate explode" in below and "[c#" in below else []
    return found


@pytest.mark.parametrize("name", ["fat_ray", "split_welch", "split_welch_pvalue", "origin_deviation", "event_origin_spread", "travel_deviation", "cell_lookup_join", "model_arrival_deviation"])
def test_no_field_is_broadcast(spark, sf, name):
    assert broadcast_products(entry.queries()[name](spark, sf)) == []
