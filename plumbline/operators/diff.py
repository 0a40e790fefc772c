"""Changes between two versions of a warehouse's catalogue, with severities.

columns: object, object_type, column, data_type, nullable, ordinal. lineage: object, column, transformation, inputs
(array of strings). Objects and columns are matched by lower-case name. Everything is a join on those names.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.graph import glob
from plumbline.storage import cut

CHANGE = ("object", "column", "change_type", "severity", "old_value", "new_value")
# Severities from the mildest.
SEVERITIES = ("NON_BREAKING", "POTENTIALLY_BREAKING", "BREAKING")
# Changes of type that lose nothing.
SAFE = (("INT", "BIGINT"), ("DECIMAL(10,2)", "DECIMAL(18,2)"), ("VARCHAR(50)", "VARCHAR(100)"), ("NVARCHAR(50)", "NVARCHAR(100)"))


def _change(df: DataFrame, kind: str, severity: Column | str, old: Column | None = None, new: Column | None = None) -> DataFrame:
    text = lambda c: (F.lit(None) if c is None else c).cast("string")
    column = F.col("column") if "column" in df.columns else F.lit(None).cast("string")
    level = F.lit(severity) if isinstance(severity, str) else severity
    return df.select("object", column.alias("column"), F.lit(kind).alias("change_type"), level.alias("severity"), text(old).alias("old_value"), text(new).alias("new_value"))


def _join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """By sorted partitions always: a catalogue whose file looks small is no table to collect and broadcast."""
    return left.join(right.hint("merge"), on, how)


def _told(rows: DataFrame, *kinds: tuple) -> DataFrame:
    """The changes of each row in one pass: (condition, change_type, severity, old value, new value)."""
    text = lambda c: (F.lit(None) if c is None else c).cast("string")
    level = lambda x: F.lit(x) if isinstance(x, str) else x
    made = [F.when(when, F.struct(F.lit(kind).alias("change_type"), level(severity).alias("severity"), text(old).alias("old_value"), text(new).alias("new_value"))) for when, kind, severity, old, new in kinds]
    column = F.col("column") if "column" in rows.columns else F.lit(None).cast("string")
    return rows.select("object", column.alias("column"), F.explode(F.array(*made)).alias("c")).where("c IS NOT NULL").select("object", "column", "c.*")


def _objects(columns: DataFrame) -> DataFrame:
    return columns.groupBy(F.lower("object").alias("object")).agg(F.max("object_type").alias("object_type"), F.lit(True).alias("there"))


def object_changes(base: DataFrame, head: DataFrame) -> DataFrame:
    """Objects added, removed, and of another type."""
    new = _objects(head).select("object", F.col("object_type").alias("new_type"), F.col("there").alias("still"))
    return _told(
        _join(_objects(base), new, ["object"], "full"),
        (F.col("there").isNull(), "OBJECT_ADDED", "NON_BREAKING", None, None),
        (F.col("still").isNull(), "OBJECT_REMOVED", "BREAKING", None, None),
        (F.col("object_type") != F.col("new_type"), "OBJECT_TYPE_CHANGED", "BREAKING", F.col("object_type"), F.col("new_type")),
    )


#: Database before `schema.table` in the names of inputs, which doesn't count.
_SHORT = r"^[^.]+\.([^.]+\.[^.]+\.[^.]+)$"


def _inputs(lineage: DataFrame) -> Column:
    """The set of inputs, in small letters and without databases."""
    return F.array_sort(F.array_distinct(F.transform("inputs", lambda i: F.regexp_replace(F.lower(i), _SHORT, "$1"))))


def without(df: DataFrame, patterns: list[str]) -> DataFrame:
    """Rows of objects whose names fit none of the globs, case aside; a pattern may leave out database and schema."""
    name = F.lower("object")
    forms = (name, F.substring_index(name, ".", -2), F.substring_index(name, ".", -1))
    for pattern in patterns:
        for form in forms:
            df = df.where(~form.rlike(glob(pattern.lower())))
    return df


def _named(columns: DataFrame) -> DataFrame:
    return columns.select(F.lower("object").alias("object"), F.lower("column").alias("column"), "data_type", "nullable", "ordinal")


def _pairs_of(base: DataFrame, head: DataFrame, how: str) -> DataFrame:
    """Columns of both versions side by side: those of the second have new_ before their names; was, is: whether a version has it."""
    after = _named(head).select("object", "column", *[F.col(c).alias(f"new_{c}") for c in ("data_type", "nullable", "ordinal")], F.lit(True).alias("is"))
    return _join(_named(base).withColumn("was", F.lit(True)), after, ["object", "column"], how)


def _loose(base: DataFrame, head: DataFrame) -> DataFrame:
    """object, column, data_type, nullable, ordinal, was: columns of one version only (was: the first), of objects of both; computed once."""
    names = lambda df: df.select(F.lower("object").alias("object")).distinct()
    shared = _join(names(base), names(head), ["object"])
    alone = _pairs_of(base, head, "full").where("was IS NULL OR is IS NULL")
    either = [F.when(F.col("was"), F.col(c)).otherwise(F.col(f"new_{c}")).alias(c) for c in ("data_type", "nullable", "ordinal")]
    return cut(_join(alone.select("object", "column", *either, F.coalesce("was", F.lit(False)).alias("was")), shared, ["object"], "left_semi"))


def precision_of(data_type: Column) -> Column:
    return F.regexp_extract(data_type, r"\(([^)]*)\)", 1)


# What agreement counts. Of inputs and place one counts: inputs where the removed column has some.
WEIGHTS = {"type": 2, "nullable": 2, "inputs": 3, "place": 1, "precision": 1}
LEAST_SCORE = 4
#: The sets of agreements that are enough, with their scores.
WAYS = [(w, score) for n in range(1, 5) for w in combinations(WEIGHTS, n) if not {"inputs", "place"} <= set(w) and (score := sum(map(WEIGHTS.get, w))) >= LEAST_SCORE]


def renames(base: DataFrame, head: DataFrame, base_lineage: DataFrame | None = None, head_lineage: DataFrame | None = None) -> DataFrame:
    """object, old_column, new_column, score: removed columns that live on under another name.

    Type and nullability count 2 each, equal lineage 3 (without old lineage, a place at most one away counts 1), equal
    precision 1; the best partner counts if its score is 4 or more and no other reaches it.
    """
    return _renames(_loose(base, head), base_lineage, head_lineage)


def _renames(loose: DataFrame, base_lineage: DataFrame | None, head_lineage: DataFrame | None) -> DataFrame:
    """No removed column meets the added ones of its object one by one: it meets, for each way to agree, their number and one name.

    All weights are positive, so those that agree in a way of the best score agree in nothing more: they are in one way only, and numbers add up.
    """
    ways = [(n, set(w), score) for n, (w, score) in enumerate(WAYS) if base_lineage is not None or "inputs" not in w]

    def keyed(rows: DataFrame, lineage: DataFrame | None, places: tuple, removed: bool) -> DataFrame:
        if lineage is None:
            rows = rows.withColumn("inputs", F.lit(None).cast("array<string>"))
        else:
            rows = _join(rows, lineage.select(F.lower("object").alias("object"), F.lower("column").alias("column"), _inputs(lineage).alias("inputs")), ["object", "column"], "left")
        rows = rows.select("object", "column", "ordinal", F.upper(F.trim("data_type")).alias("type"), "nullable", F.when(F.size("inputs") > 0, F.col("inputs")).alias("inputs"), F.col("ordinal").cast("long").alias("place"), precision_of(F.col("data_type")).alias("precision"))
        kinds = [F.struct(F.lit(n).alias("way"), F.lit(score).alias("score"), F.lit(step).alias("step"), *[F.lit(p in way).alias(p) for p in WEIGHTS]) for n, way, score in ways for step in (places if "place" in way else (0,))]
        met = rows.withColumn("w", F.explode(F.array(*kinds)))
        # inputs count where the removed column has some, its place where it hasn't
        whole = ~F.col("w.place") | F.col("inputs").isNull() if removed else F.lit(True)
        for part in WEIGHTS:
            whole = whole & (~F.col(f"w.{part}") | F.col(part).isNotNull())
        value = lambda p: F.when(F.col(f"w.{p}"), F.col(p) + F.col("w.step") if p == "place" else F.col(p)).alias(p)
        return met.where(whole).select("object", "column", "ordinal", F.struct("w.way", *map(value, WEIGHTS)).alias("key"), "w.score")

    come = keyed(loose.where("NOT was"), head_lineage, (-1, 0, 1), False).groupBy("object", "key").agg(F.count(F.lit(1)).alias("n"), F.min("column").alias("new_column"))
    met = _join(keyed(loose.where("was"), base_lineage, (0,), True), come, ["object", "key"])
    scored = met.groupBy("object", "column", "score").agg(F.sum("n").alias("n"), F.min("new_column").alias("new_column"), F.min("ordinal").alias("at"))
    best = scored.groupBy("object", "column").agg(F.max(F.struct("score", "n", "new_column", "at")).alias("b")).where("b.n = 1")
    # a new name is taken once: by the better match, then by the earlier column
    first = best.groupBy("object", F.col("b.new_column").alias("new_column")).agg(F.min(F.struct((-F.col("b.score")).alias("less"), F.col("b.at").alias("at"), "column")).alias("f"))
    return first.select("object", F.col("f.column").alias("old_column"), "new_column", (-F.col("f.less")).cast("int").alias("score"))


def _type_severity(old: Column, new: Column) -> Column:
    a, b = F.upper(old), F.upper(new)
    same = lambda family: a.contains(family) & b.contains(family)
    safe = F.lit(False)
    for x, y in SAFE:
        safe = safe | ((a == x) & (b == y))
    return F.when(safe, "NON_BREAKING").when(same("VARCHAR") | same("DECIMAL"), "POTENTIALLY_BREAKING").otherwise("BREAKING")


def column_changes(base: DataFrame, head: DataFrame, base_lineage: DataFrame | None = None, head_lineage: DataFrame | None = None) -> DataFrame:
    """Columns added, removed, renamed, retyped, reordered, and of other nullability, within objects of both versions."""
    loose = _loose(base, head)
    found = cut(_renames(loose, base_lineage, head_lineage))
    gone, come = loose.where("was").drop("was"), loose.where("NOT was").drop("was")
    removed = _join(gone, found.select("object", F.col("old_column").alias("column")), ["object", "column"], "left_anti")
    added = _join(come, found.select("object", F.col("new_column").alias("column")), ["object", "column"], "left_anti")
    # of names that repeat, every row is compared
    before = _join(found.select("object", F.col("old_column").alias("column"), "new_column"), gone, ["object", "column"]).drop("column").withColumnRenamed("new_column", "column")
    renamed = _join(before, come.select("object", "column", *[F.col(c).alias(f"new_{c}") for c in ("data_type", "nullable", "ordinal")]), ["object", "column"])
    kept = _pairs_of(base, head, "inner").drop("was", "is").unionByName(renamed)
    return (
        _change(added, "COLUMN_ADDED", "POTENTIALLY_BREAKING", None, F.col("data_type"))
        .unionByName(_change(removed, "COLUMN_REMOVED", "BREAKING", F.col("data_type")))
        .unionByName(_change(found.withColumn("column", F.col("new_column")), "COLUMN_RENAMED", "POTENTIALLY_BREAKING", F.col("old_column"), F.col("new_column")))
        .unionByName(
            _told(
                kept,
                (~F.col("data_type").eqNullSafe(F.col("new_data_type")), "COLUMN_TYPE_CHANGED", _type_severity(F.col("data_type"), F.col("new_data_type")), F.col("data_type"), F.col("new_data_type")),
                (F.col("nullable") != F.col("new_nullable"), "COLUMN_NULLABILITY_CHANGED", F.when(F.col("new_nullable"), "POTENTIALLY_BREAKING").otherwise("BREAKING"), F.col("nullable"), F.col("new_nullable")),
                (F.col("ordinal") != F.col("new_ordinal"), "COLUMN_ORDER_CHANGED", "POTENTIALLY_BREAKING", F.col("ordinal"), F.col("new_ordinal")),
            )
        )
    )


def lineage_changes(base: DataFrame, head: DataFrame) -> DataFrame:
    """Columns of both versions whose transformation or set of inputs is another."""
    shape = lambda df, p: df.select(F.lower("object").alias("object"), F.lower("column").alias("column"), F.col("transformation").alias(f"{p}_type"), _inputs(df).alias(f"{p}_in"))
    text = lambda c: F.array_join(c, ",")
    return _told(
        _join(shape(base, "old"), shape(head, "new"), ["object", "column"]),
        (F.col("old_type") != F.col("new_type"), "LINEAGE_TYPE_CHANGED", "POTENTIALLY_BREAKING", F.col("old_type"), F.col("new_type")),
        (F.col("old_in") != F.col("new_in"), "LINEAGE_INPUTS_CHANGED", "POTENTIALLY_BREAKING", text(F.col("old_in")), text(F.col("new_in"))),
    )


def changes(base: DataFrame, head: DataFrame, base_lineage: DataFrame | None = None, head_lineage: DataFrame | None = None) -> DataFrame:
    out = object_changes(base, head).unionByName(column_changes(base, head, base_lineage, head_lineage))
    return out if base_lineage is None or head_lineage is None else out.unionByName(lineage_changes(base_lineage, head_lineage))


def at_or_above(found: DataFrame, threshold: str) -> DataFrame:
    """Changes of the threshold's severity or a graver one."""
    return found.where(F.col("severity").isin(*SEVERITIES[SEVERITIES.index(threshold) :]))


def exit_code(found: DataFrame, threshold: str = "BREAKING") -> int:
    return 0 if at_or_above(found, threshold).isEmpty() else 1


def summary(found: DataFrame) -> DataFrame:
    return found.groupBy("severity", "change_type").agg(F.count(F.lit(1)).alias("changes"))
