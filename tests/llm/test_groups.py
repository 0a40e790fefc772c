"""Near duplicates against brute force, with the groups that are hard: one passage in all, and chains of near copies."""

import numpy as np
import pytest
from test_rows import shingles

from plumbline.llm import near_dedup


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (a, x) in enumerate(sets):
        for b, y in sets[:n]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                lo, hi = sorted((find(a), find(b)))
                parent[hi] = lo
    return {(i, find(i)) for i, _ in rows}


def words(rng, n, of=10**6):
    return [f"w{x}" for x in rng.integers(0, of, n)]


def boilerplate(rng, start, n, own):
    """Texts of one long passage and some words of their own: much alike, few linked."""
    passage = words(rng, 100)
    return [(start + k, " ".join(passage + words(rng, own))) for k in range(n)]


def copies(rng, start, n, edits):
    """Copies of a text with scattered edits: some linked with the first, some only through others."""
    base, out = words(rng, 150), []
    for k in range(n):
        text = list(base)
        for at in rng.integers(0, len(base), int(rng.integers(0, edits))):
            text[at] = f"e{rng.integers(0, 10**6)}"
        out.append((start + k, " ".join(text)))
    return out


@pytest.mark.parametrize("block", [near_dedup.BLOCK_SHINGLES, 700])
def test_hard_groups(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", block)
    monkeypatch.setattr(near_dedup, "MEMBERS", 9)
    rng = np.random.default_rng(11)
    rows = boilerplate(rng, 0, 150, 21) + boilerplate(rng, 1000, 40, 16) + copies(rng, 2000, 150, 12) + copies(rng, 3000, 60, 7) + [(9000 + k, " ".join(words(rng, 50))) for k in range(40)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == brute(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) and r["n_shingles"] == len(shingles(dict(rows)[r["doc_id"]])) for r in got)


def test_a_block_gives_a_forest(spark):
    rng = np.random.default_rng(2)
    rows = copies(rng, 0, 80, 3)
    sets = spark.createDataFrame([(i, len(s := near_dedup.shingle_set(t).view(np.int64).tolist()), s) for i, t in rows], "cls long, n long, shingles array<long>")
    buckets = spark.createDataFrame([(7, i, i) for i, _ in rows], "key long, cls long, root long")
    links = near_dedup._searched(buckets, sets).collect()
    assert len(links) <= len(rows) - 1
    assert {(r["a"], r["b"]) for r in links} == {(r["a"], r["b"]) for r in links if r["a"] < r["b"]}


def test_rows_that_repeat(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(5, text)] * 30 + [(4, text + " a")] * 3 + [(6, "b " + text)] + [(7, "other words")] * 2
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == sorted((i, 7 if i == 7 else 4) for i, _ in rows)
