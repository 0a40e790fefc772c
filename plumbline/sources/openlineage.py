"""OpenLineage files: one JSON file an object, events of sources that no script makes, the column graph; and reading them back."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import graph
from plumbline.tsql import artifacts

GRAPH = "column_graph.json"
_FIELD = "struct<inputFields:array<struct<namespace:string,name:string,field:string>>,transformationType:string,transformationDescription:string>"
EVENT = f"""inputs array<struct<namespace:string,name:string>>, outputs array<struct<namespace:string,name:string,facets:struct<
  schema:struct<fields:array<struct<name:string,type:string>>>, columnLineage:struct<fields:map<string,{_FIELD}>>>>>"""


def file_name(name: str) -> str:
    return re.sub(r"[^\w.#@-]", "_", name)


def write(folder: str | Path, events: DataFrame, sources: DataFrame, edges: DataFrame, nodes: DataFrame) -> int:
    """Writes `<object>.json` for each event, `sources/src_<name>.json` for each source, and the column graph; the number of objects.

    Rows come one partition at a time. A temp table's file is named after its owner, `<owner>__temp__<name>.json`.
    """
    out = Path(folder)
    (out / "sources").mkdir(parents=True, exist_ok=True)
    n = 0
    for row in events.toLocalIterator():
        owner, mark, temp = row["name"].partition("#")
        stem = f"{owner}__temp__{temp}" if mark else row["name"]
        _put(out / f"{file_name(stem)}.json", row["event"])
        n += 1
    for row in sources.toLocalIterator():
        _put(out / "sources" / f"src_{file_name(row['name'])}.json", row["event"])
    shown = {"edges": [{"from": r["from_key"], "to": r["to_key"], "transformation": r["transformation"], "description": r["description"]} for r in edges.toLocalIterator()]}
    shown["nodes"] = [r.asDict() for r in nodes.toLocalIterator()]
    (out / GRAPH).write_text(json.dumps(shown, indent=2, ensure_ascii=False), encoding="utf-8")
    return n


def _put(path: Path, event: str) -> None:
    path.write_text(json.dumps(json.loads(event), indent=2, ensure_ascii=False, sort_keys=True), encoding="utf-8")


def load(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(columns, lineage, dependencies) of the event files right in a folder; the column graph and files that don't parse are passed over.

    Of an event the first output counts. A name of three parts without a namespace tells its database. A column's place is that in
    the file, and it may be missing; what has lineage is a view, else a table.
    """
    files = spark.read.schema(f"{EVENT}, _corrupt_record string").option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    files = files.select("*", F.col("_metadata.file_name").alias("file")).where(F.col("file") != GRAPH).where("_corrupt_record IS NULL AND size(outputs) > 0")
    first = F.col("outputs")[0]
    name = F.coalesce(first["name"], F.lit("unknown"))
    space = F.substring_index(first["namespace"], "/", -1)
    full = F.when(first["namespace"].isNotNull() & (F.size(F.split(name, r"\.")) < 3), F.concat_ws(".", space, name)).otherwise(name)
    told = files.select(full.alias("object"), first["facets"]["schema"]["fields"].alias("fields"), first["facets"]["columnLineage"]["fields"].alias("lineage"), "inputs")
    kind = F.when(F.size(F.coalesce(F.map_keys("lineage"), F.array().cast("array<string>"))) > 0, "view").otherwise("table")
    columns = told.select("object", kind.alias("object_type"), F.posexplode("fields").alias("ordinal", "f")).select(
        "object", "object_type", F.coalesce("f.name", F.lit("unknown")).alias("column"), F.coalesce("f.type", F.lit("unknown")).alias("data_type"), F.lit(True).alias("nullable"), "ordinal"
    )
    refer = lambda i: F.concat_ws(".", F.substring_index(i["namespace"], "/", -1), i["name"], i["field"])
    lineage = told.select("object", F.explode("lineage").alias("column", "l")).select(
        "object", "column", F.coalesce("l.transformationType", F.lit("IDENTITY")).alias("transformation"), F.coalesce(F.transform("l.inputFields", refer), F.array().cast("array<string>")).alias("inputs"), F.coalesce("l.transformationDescription", F.lit("")).alias("description")
    )
    dependencies = told.select("object", F.explode("inputs").alias("i")).select("object", F.concat_ws(".", F.substring_index("i.namespace", "/", -1), "i.name").alias("input"))
    return columns, lineage, dependencies


def load_edges(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of a folder's column graph; nodes without edges are there too."""
    shape = "edges array<struct<from:string,to:string,transformation:string,description:string>>, nodes array<struct<namespace:string,`table`:string,`column`:string>>"
    file = spark.read.schema(shape).option("multiLine", True).json(f"{folder}/{GRAPH}")
    edges = file.select(F.explode("edges").alias("e")).select(F.col("e.from").alias("from_key"), F.col("e.to").alias("to_key"), "e.transformation", "e.description")
    return graph.distinct_edges(edges), file.select(F.explode("nodes").alias("n")).select("n.*")


def nodes_of(columns: DataFrame, lineage: DataFrame) -> DataFrame:
    """(namespace, table, column) of all columns, and of inputs that no script makes; variables and unknown names left out."""
    own = columns.select("object", "column")
    read = lineage.select(F.explode("inputs").alias("i")).select(F.regexp_replace("i", r"\.[^.]*$", "").alias("object"), F.substring_index("i", ".", -1).alias("column"))
    both = own.unionByName(read).distinct().where("object NOT LIKE '%@%' AND lower(object) NOT LIKE '%unknown%' AND column <> '*'")
    return both.select(artifacts.namespace_of(F.col("object")).alias("namespace"), artifacts.name_of(F.col("object")).alias("table"), "column")
