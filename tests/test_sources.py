import codecs

import pytest

from plumbline import cli, config, viz
from plumbline.sources import scripts


def test_encodings():
    sql = "SELECT 'zażółć' AS a FROM t"
    for name in ("utf-8", "utf-16le", "utf-16be", "cp1250"):
        assert scripts.decode(sql.encode(name))[1] == sql
    assert scripts.decode(codecs.BOM_UTF8 + sql.encode())[0] == "utf-8-sig"
    assert scripts.decode(b"a\r\nb\rc")[1] == "a\nb\nc" and scripts.decode(b"")[1] == ""
    with pytest.raises(ValueError):
        scripts.decode(sql.encode(), "latin-9")


def test_commands(spark, tmp_path):
    for n, kind in (("one", "INT"), ("two", "BIGINT")):
        (tmp_path / n).mkdir()
        (tmp_path / n / "10_view.sql").write_text("CREATE VIEW MART.dbo.v AS SELECT t.a AS b FROM STG.dbo.t AS t")
        (tmp_path / n / "20_table.sql").write_text(f"CREATE TABLE STG.dbo.t (a {kind} NOT NULL)", encoding="utf-16")
        assert cli.extract(spark, str(tmp_path / n), str(tmp_path / f"{n}-out")) == 0
    rows = cli.impact(spark, "+mart.dbo.v.*", str(tmp_path / "one-out")).collect()
    assert [(r["from_key"], r["to_key"], r["level"]) for r in rows] == [("stg.dbo.t.a", "mart.dbo.v.b", 1)]
    found, code = cli.compare(spark, str(tmp_path / "one-out"), str(tmp_path / "two-out"), "NON_BREAKING")
    assert code == 1 and found.where("change_type = 'COLUMN_TYPE_CHANGED'").count() == 2


def test_settings_catalogue_and_page(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"include": ["*.sql"], "other": 1, "severity_threshold": "NON_BREAKING"}')
    (tmp_path / "skip").write_text("# no\n*tmp*\n")
    told = config.settings(tmp_path / "s.json", tmp_path / "skip", severity_threshold="BREAKING")
    assert told.include == ["*.sql"] and told.ignore == ["*tmp*"] and told.severity_threshold == "BREAKING"
    (tmp_path / "c.json").write_text('{"tables": [{"name": "STG.dbo.t", "columns": [{"name": "b", "type": "INT", "ordinal": 1}, {"name": "a", "type": "INT", "ordinal": 0}]}]}')
    assert config.catalogue(tmp_path / "c.json") == [("STG.dbo.t", [("a", "INT", True), ("b", "INT", True)])]
    (tmp_path / "sql").mkdir()
    (tmp_path / "sql" / "v.sql").write_text("CREATE VIEW MART.dbo.v AS SELECT t.a + t.b AS c FROM STG.dbo.t AS t")
    assert cli.extract(spark, str(tmp_path / "sql"), str(tmp_path / "out"), catalogue=str(tmp_path / "c.json")) == 0
    made = viz.page(spark.read.parquet(str(tmp_path / "out" / "edges")))
    assert made.count("<path") == 2 and "mart.dbo.v" in made
    assert viz.layers({"a", "b", "c"}, {("a", "b"), ("b", "c"), ("c", "b")})["a"] == 0
