"""Command line: `extract`, `impact`, `diff` and `viz`, over folders of Parquet tables and OpenLineage files."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from collections.abc import Iterator
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import VERSION, config, viz
from plumbline.adapters import get_adapter
from plumbline.operators import diff, graph, registry
from plumbline.sources import openlineage, scripts
from plumbline.tsql import artifacts, order, text

log = logging.getLogger("plumbline")


def extract(
    spark: SparkSession, folder: str, out: str, encoding: str = "auto", include: list[str] | None = None, exclude: list[str] | None = None, catalogue: str | None = None, database: str = "WarehouseDB",
    ignore: list[str] | None = None, dbt: bool = False, adapter: str = "mssql", known: str | None = None,
) -> int:
    """Writes objects, columns, lineage, edges and events below `out`, as Parquet and as OpenLineage files; returns the number of warnings.

    Scripts are taken in order of dependency; those that name objects not known yet, as in cycles, once more at the end. Objects whose names
    fit an `ignore` glob are left out. known: a file of settled databases and votes, which the scripts add to.
    """
    found_scripts = scripts.scan(spark, folder, include, exclude, encoding)
    hard, databases = _databases(spark, found_scripts.select("name", F.col("text").alias("sql_text")), known)
    found = get_adapter(adapter)(spark, database, databases)
    for name, declared in config.catalogue(catalogue) if catalogue else []:
        found.declare(name, [(c, kind, null, n) for n, (c, kind, null) in enumerate(declared)])
    rows = [(r["name"], r["text"]) for r in found_scripts.orderBy("path").collect()]
    if dbt:
        rows = [(text.model_name(sql) or name, sql) for name, sql in rows]
        place = order.ordered([f"CREATE VIEW {name} AS {text.without_templates(sql)}" for name, sql in rows])
    else:
        place = order.ordered([sql for _, sql in rows])
    take = (lambda k: found.model(*rows[k])) if dbt else (lambda k: found.script(rows[k][1]))
    for k in place:
        take(k)
    for _ in range(len(place)):
        open_ones = [k for k, v in found.objects.items() if v[2]]
        for k in place if open_ones else []:
            take(k)
        if open_ones == [k for k, v in found.objects.items() if v[2]]:
            break
    objects, columns, lineage = (diff.without(t, ignore or []) for t in found.tables())
    depends = diff.without(found.dependencies(), ignore or [])
    edges = graph.distinct_edges(artifacts.edges(lineage))
    events = artifacts.events(objects, columns, lineage, dependencies=depends)
    for name, table in (("objects", objects), ("columns", columns), ("lineage", lineage), ("edges", edges), ("events", events), ("dependencies", depends)):
        table.write.mode("overwrite").parquet(f"{out}/{name}")
    if "://" not in out:
        openlineage.write(out, events, artifacts.source_events(objects, lineage, depends), edges, openlineage.nodes_of(columns, lineage))
    for name, reason in found.warnings:
        log.warning("%s: %s", name, reason)
    missed = [v for v in found.objects.values() if v[2]]
    for name, _, _, reason in missed:
        log.warning("%s: %s", name, reason)
    return len(missed) + len(found.warnings)


def _databases(spark: SparkSession, told: DataFrame, known: str | None) -> tuple[DataFrame, dict[str, str]]:
    """What is settled of databases, and that of each `schema.table`: by what the file knew, what the scripts settle and their votes."""
    hard, votes = registry.learn(told)
    tallied = registry.tally(votes)
    if known:
        old_hard, old = registry.load(spark, known)
        hard = hard.unionByName(old_hard.join(hard.select("key"), "key", "left_anti"))
        tallied = old.unionByName(tallied).groupBy("key", "db").agg(F.sum("n").alias("n"))
    settled = hard.unionByName(registry.promoted(tallied).join(hard.select("key"), "key", "left_anti"))
    if known:
        registry.save(settled, tallied, known)
    wild = settled.where("key LIKE '*::%' AND lower(db) NOT IN ('warehousedb', 'warehousedw')")
    return settled, {r["key"].removeprefix("*::"): r["db"] for r in wild.collect()}


def edges_of(spark: SparkSession, folder: str) -> DataFrame:
    """The edges of a folder: its Parquet table, or else its column graph file."""
    try:
        return spark.read.parquet(f"{folder}/edges")
    except AnalysisException:
        edges, _ = openlineage.load_edges(spark, folder)
        bare = lambda c: F.lower(F.regexp_replace(c, r"^[a-z]+://[^/]*/", ""))
        return edges.withColumns({c: bare(c) for c in ("from_key", "to_key")})


def impact(spark: SparkSession, selector: str, folder: str, max_depth: int = 0, database: str | None = None) -> DataFrame:
    """Edges within reach of the columns that a selector names, ordered by level; LookupError if it names none."""
    asked = graph.parse_selector(selector)
    if asked.error:
        raise ValueError(asked.error)
    edges = edges_of(spark, folder)
    nodes = graph.nodes_of(edges)
    table, column = F.expr("substring_index(key, '.', size(split(key, '[.]')) - 1)"), F.substring_index("key", ".", -1)
    space = F.concat(F.lit(artifacts.HOST), F.substring_index("key", ".", 1))
    pattern = asked.pattern
    if "://" in pattern and ".." not in pattern and not pattern.endswith(".*"):  # a column's URI, without its host
        pattern = pattern.split("://", 1)[1].split("/", 1)[-1]
    seeds = nodes.where(graph.matches(pattern, space, table, column, database)).select("key")
    if seeds.isEmpty():
        raise LookupError(f"no columns match {selector!r}")
    return graph.impact(edges, seeds, asked.direction, max_depth).orderBy("level", "from_key", "to_key")


def tables_of(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(columns, lineage) of a folder: its Parquet tables, or else its OpenLineage files."""
    try:
        return spark.read.parquet(f"{folder}/columns"), spark.read.parquet(f"{folder}/lineage")
    except AnalysisException:
        return openlineage.load(spark, folder)[:2]


def compare(spark: SparkSession, base: str, head: str, threshold: str = "BREAKING") -> tuple[DataFrame, int]:
    """Changes at or above the threshold, and the exit code."""
    (columns, lineage), (new_columns, new_lineage) = tables_of(spark, base), tables_of(spark, head)
    found = diff.changes(columns, new_columns, lineage, new_lineage)
    return diff.at_or_above(found, threshold), diff.exit_code(found, threshold)


def lines(df: DataFrame, form: str) -> Iterator[str]:
    """Every row, a partition at a time on the driver: tab-separated below the names, or a JSON object with columns and rows.

    As text, missing values read NULL; tabs, line ends and backslashes within values are escaped.
    """
    plain = lambda v: "NULL" if v is None else str(v).replace("\\", r"\\").replace("\t", r"\t").replace("\n", r"\n").replace("\r", r"\r")
    if form == "json":
        yield f'{{"columns": {json.dumps(df.columns)}, "rows": ['
        for n, row in enumerate(df.toLocalIterator()):
            yield ("," if n else "") + json.dumps(list(row), ensure_ascii=False, default=str)
        yield "]}"
        return
    yield "\t".join(df.columns)
    for row in df.toLocalIterator():
        yield "\t".join(map(plain, row))


def show(df: DataFrame, form: str = "text", out: str | None = None) -> None:
    """Prints every row, or writes it to a file."""
    if out is None:
        for line in lines(df, form):
            print(line)
        return
    Path(out).parent.mkdir(parents=True, exist_ok=True)
    with open(out, "w", encoding="utf-8") as f:
        f.writelines(line + "\n" for line in lines(df, form))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="plumbline")
    top.add_argument("--config", help="a settings file")
    top.add_argument("--log-level", default="warning", choices=("debug", "info", "warning", "error"))
    top.add_argument("--format", default="text", choices=("text", "json"))
    top.add_argument("--version", action="version", version=VERSION)
    commands = top.add_subparsers(dest="command", required=True)
    e = commands.add_parser("extract")
    e.add_argument("folder", nargs="?")
    e.add_argument("out", nargs="?")
    e.add_argument("--encoding", choices=scripts.ENCODINGS)
    e.add_argument("--include", action="append")
    e.add_argument("--exclude", action="append")
    e.add_argument("--ignore", action="append", help="globs of object names that are left out")
    e.add_argument("--catalogue")
    e.add_argument("--adapter", default="mssql")
    e.add_argument("--dbt", action="store_true", help="the scripts are dbt models")
    e.add_argument("--databases", help="a file of settled databases, read and brought up to date")
    e.add_argument("--settings")
    e.add_argument("--fail-on-warn", action="store_true")
    v = commands.add_parser("viz")
    v.add_argument("folder")
    v.add_argument("out")
    v.add_argument("--focus", help="a selector; only what is near its columns is drawn")
    v.add_argument("--depth", type=int, default=2)
    v.add_argument("--direction", default="both", choices=("upstream", "downstream", "both"))
    i = commands.add_parser("impact")
    i.add_argument("selector")
    i.add_argument("folder", nargs="?")
    i.add_argument("--max-depth", type=int, default=0)
    i.add_argument("--out")
    d = commands.add_parser("diff")
    d.add_argument("base")
    d.add_argument("head")
    d.add_argument("--threshold", choices=diff.SEVERITIES)
    d.add_argument("--out")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=args.log_level.upper())
    spark = SparkSession.builder.appName("plumbline").getOrCreate()
    told = config.settings(getattr(args, "settings", None) or args.config)
    if args.command == "extract":
        told = config.settings(args.settings or args.config, include=args.include, exclude=args.exclude, ignore=args.ignore, encoding=args.encoding, sql_dir=args.folder, out_dir=args.out)
        database = config.dbt_variables(told.sql_dir).get("default_database", told.default_database)
        missed = extract(spark, told.sql_dir, told.out_dir, told.encoding, told.include, told.exclude, args.catalogue, database, told.ignore, args.dbt, args.adapter, args.databases)
        return int(missed > 0 and args.fail_on_warn)
    if args.command == "viz":
        edges = edges_of(spark, args.folder)
        if args.focus:
            sides = {"upstream": f"+{args.focus}", "downstream": f"{args.focus}+", "both": f"+{args.focus}+"}
            edges = impact(spark, sides[args.direction], args.folder, args.depth, None).select("from_key", "to_key", "transformation", "description")
        with open(args.out, "w", encoding="utf-8") as f:
            f.write(viz.page(edges))
        return 0
    if args.command == "impact":
        try:
            show(impact(spark, args.selector, args.folder or told.out_dir, args.max_depth), args.format, args.out)
        except (LookupError, ValueError) as error:
            print(error, file=sys.stderr)
            return 1
        return 0
    changes, code = compare(spark, args.base, args.head, args.threshold or told.severity_threshold)
    show(changes, args.format, args.out)
    return code


if __name__ == "__main__":
    sys.exit(main())
