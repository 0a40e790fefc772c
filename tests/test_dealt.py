"""Joins and windows over lines: partitions by rows, however few the shuffle partitions are."""

import pytest
from test_queries import DATA, rows_of

from plumbline import storage
from plumbline.plans import warehouse


@pytest.mark.parametrize("name", ["vw_sales_analytics", "fct_sales"])
def test_partitions_grow_with_the_lines(spark, monkeypatch, name):
    query, lines = getattr(warehouse, name), spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    before = rows_of(query(spark, DATA).toPandas())
    monkeypatch.setattr(storage, "ROWS_A_TASK", 300, raising=False)
    dealt = query(spark, DATA)
    assert dealt.rdd.getNumPartitions() == -(-lines // 300)
    assert rows_of(dealt.toPandas()) == before
