"""OpenLineage files, the registry file, order of scripts, adapters and the command line's options."""

import json

import pytest

from plumbline import adapters, cli
from plumbline.operators import diff, registry
from plumbline.sources import openlineage
from plumbline.tsql import order

SCRIPTS = {
    "10_mart.sql": "USE MART\nGO\nCREATE PROCEDURE dbo.load AS BEGIN SELECT v.id, v.twice INTO #t FROM STG.dbo.v AS v JOIN STG.dbo.only_joined AS j ON j.id = v.id; INSERT INTO dbo.f (id, total) SELECT id, SUM(twice) FROM #t GROUP BY id; END",
    "20_view.sql": "CREATE VIEW STG.dbo.v AS SELECT s.id, s.x * 2 AS twice FROM STG.dbo.s AS s",
    "30_table.sql": "CREATE TABLE STG.dbo.s (id INT NOT NULL, x DECIMAL(10, 2)); CREATE TABLE STG.dbo.only_joined (id INT)",
    "40_tmp.sql": "CREATE TABLE STG.dbo.tmp_skip (a INT)",
}


@pytest.fixture(scope="module")
def out(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    for name, sql in SCRIPTS.items():
        (folder / name).write_text(sql)
    assert cli.extract(spark, str(folder), str(folder / "out"), ignore=["dbo.TMP_*"], known=str(folder / "db.json")) == 0
    return folder


def test_order():
    names = list(SCRIPTS)
    assert [names[k] for k in order.ordered(list(SCRIPTS.values()))] == ["30_table.sql", "40_tmp.sql", "20_view.sql", "10_mart.sql"]
    ring = ["CREATE VIEW a AS SELECT * FROM dbo.b", "CREATE VIEW b AS SELECT * FROM a", "CREATE VIEW c AS SELECT * FROM b"]
    assert order.ordered(ring) == [0, 1, 2] and order.ordered([]) == []


def test_event_files(spark, out):
    names = {p.name for p in (out / "out").glob("*.json")}
    assert names == {"STG.dbo.s.json", "STG.dbo.v.json", "STG.dbo.only_joined.json", "MART.dbo.f.json", "MART.dbo.load__temp__t.json", "column_graph.json"}
    event = json.loads((out / "out" / "STG.dbo.v.json").read_text())
    told = event["outputs"][0]["facets"]["columnLineage"]["fields"]["twice"]
    assert told["inputFields"] == [{"namespace": "mssql://localhost/STG", "name": "dbo.s", "field": "x"}] and "x" in told["transformationDescription"]
    assert "schema" not in event["outputs"][0]["facets"] and json.loads((out / "out" / "STG.dbo.s.json").read_text())["outputs"][0]["facets"]["schema"]["fields"][0] == {"name": "id", "type": "int"}
    temp = json.loads((out / "out" / "MART.dbo.load__temp__t.json").read_text())
    assert {i["name"] for i in temp["inputs"]} == {"dbo.v", "dbo.only_joined"}
    nodes = json.loads((out / "out" / "column_graph.json").read_text())["nodes"]
    assert {"namespace": "mssql://localhost/STG", "table": "dbo.only_joined", "column": "id"} in nodes


def test_reading_event_files(spark, out, tmp_path):
    (out / "out" / "broken.json").write_text("{ not json")
    columns, lineage, dependencies = openlineage.load(spark, str(out / "out"))
    assert {(r["object"], r["column"]) for r in columns.collect()} >= {("STG.dbo.s", "x"), ("MART.dbo.f", "total")}
    assert {(r["object"], r["column"], tuple(r["inputs"])) for r in lineage.collect()} >= {("STG.dbo.v", "twice", ("STG.dbo.s.x",))}
    assert ("STG.dbo.v", "STG.dbo.s") in {tuple(r) for r in dependencies.collect()}
    head = tmp_path / "head"
    head.mkdir()
    for p in (out / "out").glob("*.dbo.*.json"):
        (head / p.name).write_text(p.read_text().replace('"decimal(10,2)"', '"DECIMAL(18,2)"').replace('"type": "int"', '"type": "bigint"', 1) if p.name == "STG.dbo.s.json" else p.read_text())
    changes = diff.changes(*(openlineage.load(spark, str(f))[0] for f in (out / "out", head)))
    assert {(r["column"], r["severity"]) for r in changes.collect()} == {("id", "NON_BREAKING"), ("x", "NON_BREAKING")}
    assert cli.main(["diff", str(out / "out"), str(head), "--threshold", "NON_BREAKING"]) == 1  # Parquet tables against files


def test_sources(spark, tmp_path):
    (tmp_path / "v.sql").write_text("CREATE VIEW dbo.v AS SELECT a.id, a.x FROM EDW.dbo.a AS a; INSERT INTO dbo.t (id) EXEC EDW.dbo.p")
    (tmp_path / "c.json").write_text('{"tables": [{"name": "EDW.dbo.b", "columns": [{"name": "id", "type": "INT"}]}]}')
    assert cli.extract(spark, str(tmp_path), str(tmp_path / "out")) == 2  # nothing is known of a and p
    assert {p.name for p in (tmp_path / "out" / "sources").glob("*")} == {"src_EDW.dbo.p.json"}


def test_registry_file(spark, out, tmp_path):
    told = json.loads((out / "db.json").read_text())
    assert told["hard"]["view::dbo.v"] == "STG" and told["soft"]["*::dbo.s"] == {"STG": 1}
    hard, soft = registry.load(spark, out / "db.json")
    registry.save(hard, soft, tmp_path / "again.json")
    assert json.loads((tmp_path / "again.json").read_text()) == told
    (tmp_path / "x.sql").write_text("INSERT INTO EDW.dbo.q (a) SELECT a FROM EDW.dbo.r; SELECT a FROM dbo.q")
    (tmp_path / "y.sql").write_text("CREATE TABLE dbo.q (a INT)")
    cli.extract(spark, str(tmp_path), str(tmp_path / "o"))
    assert {r["object"] for r in spark.read.parquet(str(tmp_path / "o" / "objects")).collect()} >= {"EDW.dbo.q"}


def test_adapters(spark):
    event = json.loads(adapters.extract_lineage(spark, "CREATE TABLE dbo.t (a INT)", "t"))
    assert event["outputs"][0]["name"] == "dbo.t"
    assert json.loads(adapters.extract_lineage(spark, "PRINT 1", "none"))["outputs"][0]["facets"]["schema"]["fields"][0]["name"] == "error"
    with pytest.raises(KeyError):
        adapters.get_adapter("oracle")


def test_options(spark, out, tmp_path, capsys):
    assert cli.main(["--format", "json", "impact", "STG.dbo.s.x+", str(out / "out")]) == 0
    told = json.loads(capsys.readouterr().out)
    assert told["columns"][0] == "from_key" and [r[0] for r in told["rows"]] == ["stg.dbo.s.x", "stg.dbo.v.twice", "mart.dbo.load#t.twice"]
    for selector in ("s.x", "dbo.s.x", "mssql://localhost/STG.dbo.s.x"):
        assert cli.main(["impact", selector, str(out / "out"), "--out", str(tmp_path / "r" / "rows.txt")]) == 0
    assert len((tmp_path / "r" / "rows.txt").read_text().splitlines()) == 4
    assert cli.main(["impact", "dbo.s.x_old", str(out / "out")]) == 1 and "no columns match" in capsys.readouterr().err
    assert cli.main(["impact", "a.b.c.d.e", str(out / "out")]) == 1
    assert cli.main(["viz", str(out / "out"), str(tmp_path / "p.html"), "--focus", "STG.dbo.v.twice", "--depth", "1", "--direction", "upstream"]) == 0
    page = (tmp_path / "p.html").read_text()
    assert "stg.dbo.s" in page and "mart.dbo.f" not in page
    with pytest.raises(SystemExit):
        cli.main(["--version"])


def test_models(spark, tmp_path):
    (tmp_path / "stg_a.sql").write_text("-- dbt model: stg\nSELECT a.id, a.x FROM {{ source('dbo', 'a') }} AS a")
    (tmp_path / "a_mart.sql").write_text("{{ config(materialized='table') }}\nSELECT id, x + 1 AS y FROM {{ ref('stg') }}")
    (tmp_path / "c.json").write_text('{"tables": [{"name": "dbo.a", "columns": [{"name": "id", "type": "INT"}, {"name": "x", "type": "INT"}]}]}')
    assert cli.extract(spark, str(tmp_path), str(tmp_path / "out"), catalogue=str(tmp_path / "c.json"), dbt=True) == 0
    rows = {(r["object"], r["column"]): r["inputs"] for r in spark.read.parquet(str(tmp_path / "out" / "lineage")).collect()}
    assert rows["WarehouseDB.dbo.a_mart", "y"] == ["WarehouseDB.dbo.stg.x"]
