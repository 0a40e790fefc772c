"""Traversals on small graphs with cycles, self-loops and parallel edges, against a plain breadth-first search."""

import itertools
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from plumbline.operators import graph


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, "IDENTITY", f"{n}") for n, (a, b) in enumerate(pairs)], "from_key string, to_key string, transformation string, description string")


def seeds(spark, *keys):
    return spark.createDataFrame([(k,) for k in keys], "key string")


def searched(pairs, start, depth):
    dist, queue = {start: 0}, deque([start])
    while queue:
        x = queue.popleft()
        for a, b in pairs:
            if a == x and b not in dist:
                dist[b] = dist[x] + 1
                queue.append(b)
    return sorted((a, b, dist[b] or graph.NO_LEVEL) for a, b in pairs if a in dist and (not depth or dist[a] < depth))


@pytest.mark.parametrize("seed", range(3))
def test_impact_is_the_edge_set_of_a_breadth_first_search(spark, seed):
    rng = random.Random(seed)
    pairs = [tuple(rng.choices("abcdef", k=2)) for _ in range(9)]
    for depth in (0, 1):
        got = graph.impact(edges(spark, pairs), seeds(spark, "a"), "downstream", depth).select("from_key", "to_key", "level").collect()
        assert sorted(map(tuple, got)) == searched(pairs, "a", depth)


def test_upstream_is_downstream_of_the_turned_graph(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "b"), ("d", "c")]
    up = graph.impact(edges(spark, pairs), seeds(spark, "c"), "upstream").select("to_key", "from_key", "level").collect()
    assert sorted(map(tuple, up)) == searched([(b, a) for a, b in pairs], "c", 0)


def test_waves_end_on_cycles(spark):
    got = dict(map(tuple, graph.waves(edges(spark, [("a", "b"), ("b", "c"), ("c", "b"), ("c", "d")])).collect()))
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_selectors():
    assert graph.parse_selector("+a.b") == graph.Selector("a.b", "upstream")
    assert graph.parse_selector("a.b+").direction == "downstream"
    assert graph.parse_selector("+a.b+").direction == "both"
    assert graph.parse_selector("..").error and graph.parse_selector("one").error and graph.parse_selector("a.b.c.d.e").error and graph.parse_selector("t.*").error
    assert graph.parse_selector(".x").pattern == "..x" and not graph.parse_selector("+dbo.t.*").error


def test_patterns(spark):
    rows = [("mssql://h/DW", t, c) for t, c in itertools.product(("STG.dbo.Orders", "MART.dbo.fct"), ("ID", "Revenue"))]
    nodes = spark.createDataFrame(rows, "n string, t string, c string")
    hit = lambda p: {tuple(r) for r in nodes.where(graph.matches(p, F.col("n"), F.col("t"), F.col("c"))).select("t", "c").collect()}
    assert len(hit("dbo.Orders.*")) == 2 and len(hit("STG..rev")) == 1 and len(hit("..R?v*")) == 2 and hit("..") == set()
    assert len(hit("mssql://h/DW..id")) == 2 and len(hit("mssql://other..id")) == 0


def test_exact_patterns(spark):
    rows = [("mssql://h/STG", "STG.dbo.t", "id"), ("mssql://h/STG", "STG.dbo.t", "id_old"), ("mssql://h/X", "X.dbo.t", "id"), ("mssql://h/STG", "STG.core.t", "id"), ("mssql://h/STG", "dbo.u", "id"), ("mssql://h/STG", "xSTG.dbo.t", "id")]
    nodes = spark.createDataFrame(rows, "n string, t string, c string")
    hit = lambda p, db=None: {tuple(r) for r in nodes.where(graph.matches(p, F.col("n"), F.col("t"), F.col("c"), db)).select("t", "c").collect()}
    assert hit("stg.dbo.t.ID") == {("STG.dbo.t", "id")}
    assert hit("t.id", "STG") == {("STG.dbo.t", "id")} and hit("t.id") == {("STG.dbo.t", "id"), ("X.dbo.t", "id"), ("xSTG.dbo.t", "id")}
    assert hit("core.t.id") == {("STG.core.t", "id")} and hit("dbo.u.id", "STG") == {("dbo.u", "id")} and hit("STG.dbo.u.id") == {("dbo.u", "id")}
    assert hit("STG.dbo.t.i") == set() and hit("mssql://h/X.X.dbo.t.id") == {("X.dbo.t", "id")}
    assert hit("STG.dbo.t.*") == {("STG.dbo.t", "id"), ("STG.dbo.t", "id_old")}


def test_waves_of_separate_cycles(spark):
    got = dict(map(tuple, graph.waves(edges(spark, [("a", "b"), ("b", "a"), ("x", "y"), ("y", "x"), ("y", "z"), ("s", "s")])).collect()))
    assert got == {"a": 1, "x": 1, "b": 2, "y": 2, "z": 3, "s": 0}
