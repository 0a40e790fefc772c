"""Catalogues whose names repeat, renames against all pairs, and plans that broadcast no catalogue."""

import random
from collections import defaultdict

import pytest
from test_diff import SHAPE
from test_queries import DATA

from plumbline.operators import diff
from plumbline.plans import metadata

LINEAGE = "object string, column string, transformation string, inputs array<string>"


def of_all_pairs(old, new, told_old, told_new):
    """Renames as the rule says, each removed column against each added one of its object."""
    names = lambda rows: {(r[0], r[2]) for r in rows}
    gone, come = [r for r in old if (r[0], r[2]) not in names(new)], [r for r in new if (r[0], r[2]) not in names(old)]
    precision = lambda t: t[t.index("(") + 1 : t.index(")")] if t and "(" in t else t and ""
    same = lambda a, b: a is not None and a == b
    clean = lambda t: t and t.strip().upper()
    partners = defaultdict(list)
    for o in gone:
        for n in (n for n in come if n[0] == o[0]):
            a, b = told_old.get((o[0], o[2])), told_new.get((n[0], n[2]))
            score = 2 * same(clean(o[3]), clean(n[3])) + 2 * same(o[4], n[4]) + same(precision(o[3]), precision(n[3])) + (3 * (a == b) if a else int(abs(o[5] - n[5]) <= 1))
            partners[o[0], o[2], o[5]].append((score, n[2]))
    taken = defaultdict(list)
    for (t, o, at), met in partners.items():
        top = [m for m in met if m[0] == max(met)[0] and m[0] >= 4]
        if len(top) == 1:
            taken[t, top[0][1]].append((-top[0][0], at, o))
    return sorted((t, min(x)[2], n, -min(x)[0]) for (t, n), x in taken.items())


@pytest.mark.parametrize("seed", range(4))
def test_renames_are_those_of_all_pairs(spark, seed):
    rng = random.Random(seed)
    version = lambda p: [(f"t{t}", "table", f"{p}{i}" if rng.random() < 0.8 else f"k{i}", rng.choice([None, "INT", " int", "VARCHAR(5)", "DECIMAL(5)", "DATE"]), rng.choice([None, True, False]), i) for t in range(3) for i in range(9)]
    old, new = version("a"), version("b")
    told = lambda rows: {(r[0], r[2]): sorted(rng.sample("xyz", rng.randint(0, 2))) for r in rows if rng.random() < 0.7}
    told_old, told_new = (told(rows) if seed % 2 else {} for rows in (old, new))
    frame = lambda t: spark.createDataFrame([(o, c, "CAST", i) for (o, c), i in t.items()], LINEAGE) if seed % 2 else None
    found = diff.renames(spark.createDataFrame(old, SHAPE), spark.createDataFrame(new, SHAPE), frame(told_old), frame(told_new))
    assert sorted(map(tuple, found.collect())) == of_all_pairs(old, new, told_old, told_new)


def test_a_name_that_repeats_is_compared_once_a_pair(spark):
    old = spark.createDataFrame([("t", "table", "a", "INT", True, 0), ("T", "table", "A", "INT", True, 0)], SHAPE)
    new = spark.createDataFrame([("t", "table", "a", "DATE", True, 0)], SHAPE)
    assert [r["change_type"] for r in diff.changes(old, new).collect()] == ["COLUMN_TYPE_CHANGED"] * 2


@pytest.mark.parametrize("name", ["diff_columns", "diff_types", "diff_objects", "diff_renames", "diff_lineage", "diff_summary"])
def test_no_catalogue_is_broadcast(spark, name):
    plan = getattr(metadata, name)(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_no_removed_column_meets_all_added_ones_of_its_object(spark):
    plan = metadata.diff_renames(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and all("key" in line for line in joins) and "Window" not in plan
