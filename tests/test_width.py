"""Steps that need no more than one shuffle of the graph, or one cut of a side."""

from test_queries import DATA

from plumbline.operators import graph
from plumbline.plans import metadata


def test_nodes_need_no_distinct_edges(spark):
    plan = metadata.graph_nodes(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1


def test_statistics_cut_the_edges_once_a_side(spark, monkeypatch):
    cuts, by_end = [], graph.by_end
    monkeypatch.setattr(graph, "by_end", lambda edges, end: cuts.append(end) or by_end(edges, end))
    metadata.graph_stats(spark, DATA)
    assert sorted(cuts) == ["from_key", "to_key"]


def test_impact_neither_moves_nor_sorts_edges_again_and_makes_only_found_ones_distinct(spark, monkeypatch):
    plans, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    got = metadata.impact_both(spark, DATA)
    assert got.count() == got.distinct().count() > 0
    steps = [p for p in plans if "Join" in p and "LeftAnti" not in p]
    assert steps and all("ShuffledHashJoin" in p and "Sort" not in p and "Broadcast" not in p and p.count("Exchange") == 2 for p in steps)  # of the frontier, and of what it meets
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    assert [p.count("HashAggregate") for p in plans if "Scan parquet" in p] == [0, 0]
