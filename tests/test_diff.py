from plumbline.operators import diff

SHAPE = "object string, object_type string, column string, data_type string, nullable boolean, ordinal int"


def catalogue(spark, *rows):
    return spark.createDataFrame([("t", "table", c, kind, null, n) for n, (c, kind, null) in enumerate(rows)], SHAPE)


def test_rename_suppresses_added_and_removed(spark):
    old, new = catalogue(spark, ("a", "INT", False), ("b", "DATE", True)), catalogue(spark, ("a", "INT", False), ("c", "DATE", True))
    assert {(r["change_type"], r["old_value"], r["new_value"]) for r in diff.changes(old, new).collect()} == {("COLUMN_RENAMED", "b", "c")}


def test_ambiguous_rename_is_none(spark):
    old, new = catalogue(spark, ("b", "DATE", True)), catalogue(spark, ("c", "DATE", True), ("d", "DATE", True))
    assert {r["change_type"] for r in diff.changes(old, new).collect()} == {"COLUMN_REMOVED", "COLUMN_ADDED"}


def test_threshold_and_exit_code(spark):
    old, new = catalogue(spark, ("a", "INT", False)), catalogue(spark, ("a", "BIGINT", False))
    found = diff.changes(old, new)
    assert [r["severity"] for r in found.collect()] == ["NON_BREAKING"]
    assert diff.exit_code(found, "BREAKING") == 0 and diff.exit_code(found, "NON_BREAKING") == 1


def test_severities_of_types(spark):
    kinds = [("INT", "BIGINT", 0), ("nvarchar(50)", "NVARCHAR(100)", 0), ("VARCHAR(50)", "VARCHAR(100)", 0), ("DECIMAL(10,2)", "DECIMAL(18,2)", 0), ("FLOAT", "DOUBLE", 2), ("NVARCHAR(50)", "VARCHAR(20)", 1), ("DECIMAL(18,2)", "DECIMAL(10,2)", 1), ("INT", "DATE", 2)]
    old, new = (catalogue(spark, *((f"c{n}", k[i], True) for n, k in enumerate(kinds))) for i in (0, 1))
    found = {(r["old_value"], r["new_value"]): r["severity"] for r in diff.changes(old, new).collect()}
    assert found == {(a, b): diff.SEVERITIES[n] for a, b, n in kinds}


def test_renames_fold_types(spark):
    old, new = catalogue(spark, ("b", " varchar(9)", True)), catalogue(spark, ("c", "VARCHAR(9) ", True))
    assert [r["score"] for r in diff.renames(old, new).collect()] == [6]


def test_inputs_differ_beyond_their_database(spark):
    shape = "object string, column string, transformation string, inputs array<string>"
    old = spark.createDataFrame([("t", "a", "CAST", ["STG.dbo.s.x"]), ("t", "b", "CAST", ["dbo.s.x"])], shape)
    new = spark.createDataFrame([("T", "A", "CAST", ["EDW.dbo.s.X"]), ("t", "b", "CAST", ["dbo.s.y"])], shape)
    assert [r["column"] for r in diff.lineage_changes(old, new).collect()] == ["b"]


def test_ignored_objects(spark):
    rows = spark.createDataFrame([("STG.dbo.tmp_1",), ("STG.dbo.t",), ("X.core.tmp_2",)], "object string")
    assert [r["object"] for r in diff.without(rows, ["DBO.tmp*"]).collect()] == ["STG.dbo.t", "X.core.tmp_2"]
    assert [r["object"] for r in diff.without(rows, ["tmp*"]).collect()] == ["STG.dbo.t"]
