"""OpenLineage events and edges from extracted tables, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edges(lineage: DataFrame) -> DataFrame:
    """An edge from each input column to its output column, with the expression as its description."""
    description = F.col("description") if "description" in lineage.columns else F.lit("").alias("description")
    return lineage.select(F.explode("inputs").alias("i"), "object", "column", "transformation", description).select(
        F.lower("i").alias("from_key"), F.lower(F.concat_ws(".", "object", "column")).alias("to_key"), "transformation", "description"
    )


def coverage(columns: DataFrame, lineage: DataFrame) -> DataFrame:
    """(object, columns, covered, coverage): the share of an object's columns with an input, or that are constants."""
    told = lineage.where("size(inputs) > 0 OR transformation = 'CONSTANT'").select("object", "column").distinct().withColumn("has", F.lit(1))
    grouped = columns.join(told, ["object", "column"], "left").groupBy("object").agg(F.count(F.lit(1)).alias("columns"), F.count("has").alias("covered"))
    return grouped.withColumn("coverage", F.round(F.col("covered") / F.col("columns"), 4))


def inputs(lineage: DataFrame, dependencies: DataFrame | None = None) -> DataFrame:
    """(object, input) pairs: the objects of the input columns, and the dependencies."""
    found = lineage.select("object", F.explode("inputs").alias("i")).select("object", F.regexp_replace("i", r"\.[^.]*$", "").alias("input"))
    return (found if dependencies is None else found.unionByName(dependencies)).distinct()


#: Where a database is, by its name.
HOST = "mssql://localhost/"
_ZERO = "00000000-0000-0000-0000-000000000000"
_FACETS = "https://openlineage.io/spec/facets/1-0-0/"


def namespace_of(name: Column, default: str = "WarehouseDB") -> Column:
    """The database of a full name as a namespace; a temp table without an owner's database is in tempdb."""
    database = F.when(F.size(F.split(name, r"\.")) >= 3, F.substring_index(name, ".", 1)).when(name.contains("#"), "tempdb").otherwise(default)
    return F.concat(F.lit(HOST), database)


def name_of(name: Column) -> Column:
    """A full name without its database."""
    return F.when(F.size(F.split(name, r"\.")) >= 3, F.regexp_replace(name, r"^[^.]+\.", "")).otherwise(name)


def _facet(name: str, fields: Column) -> Column:
    return F.struct(F.lit("https://github.com/OpenLineage/OpenLineage").alias("_producer"), F.lit(f"{_FACETS}{name}.json").alias("_schemaURL"), fields.alias("fields"))


def events(objects: DataFrame, columns: DataFrame, lineage: DataFrame, job: str = "plumbline/scripts", dependencies: DataFrame | None = None, time: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(name, event): one OpenLineage event an object as JSON, with schema, columnLineage and quality facets.

    Tables, temp tables and procedures that were resolved have a schema; a procedure's result is `procedures.<name>`. Inputs are those of
    the columns and the dependencies, variables left out.
    """
    of_input = lambda i: F.struct(namespace_of(F.regexp_replace(i, r"\.[^.]*$", "")).alias("namespace"), name_of(F.regexp_replace(i, r"\.[^.]*$", "")).alias("name"), F.substring_index(i, ".", -1).alias("field"))
    fields = columns.groupBy("object").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "column", "data_type"))), lambda c: F.struct(c["column"].alias("name"), c["data_type"].alias("type"))).alias("fields"))
    described = F.col("description") if "description" in lineage.columns else F.lit("")
    # a column that several statements write has their inputs, and the class of the first by name
    united = lineage.withColumn("description", described).groupBy("object", "column").agg(F.min(F.struct("transformation", "description")).alias("t"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("inputs")))).alias("inputs"))
    per = united.select("object", "column", F.struct(F.transform("inputs", of_input).alias("inputFields"), F.col("t.transformation").alias("transformationType"), F.col("t.description").alias("transformationDescription")).alias("l"))
    maps = per.groupBy("object").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("column", "l")))).alias("lineage"))
    sources = inputs(lineage, dependencies).where("input NOT LIKE '@%' AND input NOT LIKE '%+%'").groupBy("object").agg(F.array_sort(F.collect_set("input")).alias("sources"))
    whole = objects.join(fields, "object", "left").join(maps, "object", "left").join(sources, "object", "left").join(coverage(columns, lineage), "object", "left")
    name = F.when((F.col("object_type") == "procedure") & F.col("fields").isNotNull(), F.concat(F.lit("procedures."), name_of(F.col("object")))).otherwise(name_of(F.col("object")))
    schema = F.when(F.col("object_type").isin("table", "temp_table", "procedure") & ~F.col("is_fallback"), _facet("SchemaDatasetFacet", F.coalesce("fields", F.array().cast("array<struct<name:string,type:string>>"))))
    told = F.when(F.col("lineage").isNotNull(), _facet("ColumnLineageDatasetFacet", F.col("lineage")))
    quality = F.struct(F.coalesce("coverage", F.lit(0.0)).alias("lineageCoverage"), F.col("is_fallback").alias("isFallback"), F.col("reason").alias("reasonCode"))
    return whole.select(
        F.col("object").alias("name"),
        _event(job, F.col("object"), F.transform(F.coalesce("sources", F.array().cast("array<string>")), lambda s: F.struct(namespace_of(s).alias("namespace"), name_of(s).alias("name"))), F.struct(namespace_of(F.col("object")).alias("namespace"), name.alias("name"), F.struct(schema.alias("schema"), told.alias("columnLineage"), quality.alias("quality")).alias("facets")), time),
    )


def _event(job: str, name: Column, inputs: Column, output: Column, time: str) -> Column:
    out = F.struct(
        F.lit("COMPLETE").alias("eventType"), F.lit(time).alias("eventTime"), F.struct(F.lit(_ZERO).alias("runId")).alias("run"),
        F.struct(F.lit(job).alias("namespace"), name.alias("name")).alias("job"), inputs.alias("inputs"), F.array(output).alias("outputs"),
    )
    return F.to_json(out).alias("event")


def source_events(objects: DataFrame, lineage: DataFrame, dependencies: DataFrame | None = None, job: str = "plumbline/sources", time: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(name, event): an event for each input that no script makes, with the columns that are read of it."""
    read = lineage.select(F.explode("inputs").alias("i")).select(F.regexp_replace("i", r"\.[^.]*$", "").alias("name"), F.substring_index("i", ".", -1).alias("column"))
    names = inputs(lineage, dependencies).select(F.col("input").alias("name")).distinct().join(objects.select(F.col("object").alias("name")), "name", "left_anti").where("name NOT LIKE '@%'")
    columns = read.where("column <> '*'").groupBy("name").agg(F.array_sort(F.collect_set("column")).alias("columns"))
    fields = F.transform(F.coalesce("columns", F.array().cast("array<string>")), lambda c: F.struct(c.alias("name"), F.lit("unknown").alias("type")))
    output = F.struct(namespace_of(F.col("name")).alias("namespace"), name_of(F.col("name")).alias("name"), F.struct(_facet("SchemaDatasetFacet", fields).alias("schema")).alias("facets"))
    return names.join(columns, "name", "left").select("name", _event(job, F.col("name"), F.array().cast("array<struct<namespace:string,name:string>>"), output, time))
