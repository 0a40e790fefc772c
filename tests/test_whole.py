"""Queries over whole tables, by their SQL and by what they must not leave out."""

import json

import pytest
from test_queries import DATA, duck, rows_of  # noqa: F401

from plumbline import cli
from plumbline.plans import catalogue
from plumbline.plans.oracles import oracles
from plumbline.tsql import artifacts
from plumbline.tsql.frontend import Extractor


def same(spark, duck, name):  # noqa: F811
    found = catalogue.queries()[name](spark, DATA).toPandas()
    assert rows_of(found) == rows_of(duck.sql(oracles()[name]).df())
    return found


def test_every_edge_gets_a_colour(spark, duck):  # noqa: F811
    found = same(spark, duck, "edge_colours")
    edges = catalogue.queries()["graph_edges"](spark, DATA).toPandas()
    assert set(zip(found.from_key, found.to_key)) == set(zip(edges.from_key, edges.to_key)) and len(found) == len(edges)
    assert set(found.colour) == set(range(6))


@pytest.mark.parametrize("name", ["fn_customer_orders_inline", "fn_customer_orders_mstvf"])
def test_the_table_function_gives_every_line(spark, duck, name):  # noqa: F811
    assert len(same(spark, duck, name)) == duck.sql("SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey").fetchall()[0][0]


def test_tiers_of_customers_beyond_any_range(spark, duck):  # noqa: F811
    assert same(spark, duck, "demo_tvf_proc").customer_id.max() > 50


def test_events_name_tables_that_give_no_column(spark):
    tables = "\nGO\n".join(f"CREATE TABLE S.dbo.{t} (id INT NOT NULL, x INT NULL);" for t in ("base", "joined", "filtered", "inner_one", "listed", "of_cte"))
    view = """CREATE VIEW S.dbo.v AS WITH c AS (SELECT id FROM S.dbo.of_cte)
    SELECT b.x FROM S.dbo.base AS b JOIN S.dbo.joined AS j ON j.id = b.id JOIN c ON c.id = b.id
    WHERE EXISTS (SELECT 1 FROM S.dbo.filtered AS f WHERE f.id = b.id AND f.x IN (SELECT i.x FROM S.dbo.inner_one AS i)) AND b.id IN (SELECT l.id FROM S.dbo.listed AS l)"""
    found = Extractor(spark)
    found.script(f"{tables}\nGO\n{view}")
    want = {f"dbo.{t}" for t in ("base", "joined", "filtered", "inner_one", "listed", "of_cte")}
    events = {r["name"]: json.loads(r["event"]) for r in artifacts.events(*found.tables(), dependencies=found.dependencies()).collect()}
    assert {i["name"] for i in events["S.dbo.v"]["inputs"]} == want and not events["S.dbo.base"]["inputs"]


@pytest.mark.parametrize("name", ["ol_inputs", "ol_column_lineage"])
def test_openlineage_queries(spark, duck, name):  # noqa: F811
    same(spark, duck, name)


def test_the_command_line_prints_every_row(spark, tmp_path, capsys):
    n = 1500
    edges = spark.range(n).selectExpr("'db.dbo.t.c' AS from_key", "concat('db.dbo.v.c', id) AS to_key", "'IDENTITY' AS transformation", "'' AS description")
    edges.write.parquet(str(tmp_path / "graph/edges"))
    wide = spark.range(n).selectExpr("'db.dbo.v' AS object", "'view' AS object_type", "concat('c', id) AS column", "'int' AS data_type", "true AS nullable", "cast(id AS int) AS ordinal")
    told = spark.createDataFrame([], "object string, column string, transformation string, inputs array<string>")
    for name, columns in (("base", wide), ("head", wide.where("ordinal = 0"))):
        columns.write.parquet(str(tmp_path / name / "columns"))
        told.write.parquet(str(tmp_path / name / "lineage"))
    assert cli.main(["impact", "db.dbo.t.c+", str(tmp_path / "graph")]) == 0
    lines = capsys.readouterr().out.splitlines()
    assert len(lines) == n + 1 and lines[0].startswith("from_key\t")
    assert cli.main(["diff", str(tmp_path / "base"), str(tmp_path / "head")]) == 1
    assert len(capsys.readouterr().out.splitlines()) == n


def test_the_summary_counts_every_type_of_change(spark, duck):  # noqa: F811
    found = same(spark, duck, "diff_summary")
    assert {"COLUMN_RENAMED", "COLUMN_TYPE_CHANGED", "COLUMN_ORDER_CHANGED", "COLUMN_NULLABILITY_CHANGED", "LINEAGE_TYPE_CHANGED", "LINEAGE_INPUTS_CHANGED"} <= set(found.change_type)
