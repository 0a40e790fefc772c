"""Which database an object belongs to, by votes; names and dependencies from SQL text."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Databases that are only a default, so that votes may overrule them.
WEAK = ("warehousedb", "warehousedw")


def tally(votes: DataFrame) -> DataFrame:
    """(key, db, n): weights of votes (key, db, weight) by key and database."""
    return votes.groupBy("key", "db").agg(F.sum("weight").cast("long").alias("n"))


def ranked(tallied: DataFrame) -> DataFrame:
    order = Window.partitionBy("key").orderBy(F.desc("n"), "db")
    return tallied.withColumn("nth", F.row_number().over(order)).withColumn("second", F.lead("n", 1, 0).over(order)).where("nth = 1").drop("nth")


def leaders(tallied: DataFrame) -> DataFrame:
    """(key, db): the database with strictly more votes than any other; keys with a tie are missing."""
    return ranked(tallied).where("n > second").select("key", "db")


def promoted(tallied: DataFrame, least: int = 2, margin: int = 1) -> DataFrame:
    """(key, db) of leaders with enough votes and distance to the runner-up to count as settled."""
    return ranked(tallied).where((F.col("n") >= least) & (F.col("n") - F.col("second") >= margin)).select("key", "db")


def resolve(keys: DataFrame, hard: DataFrame, tallied: DataFrame, default: str, weak: tuple[str, ...] = WEAK) -> DataFrame:
    """(key, db) of typed keys `type::name`: a strong hard entry, that of any type, the votes' leader, a weak hard entry, the default."""
    wild = F.concat(F.lit("*::"), F.substring_index("key", "::", -1))
    h = hard.select(F.col("key").alias("k"), F.col("db").alias("hard_db"))
    lead = leaders(tallied)
    out = keys.withColumn("wild", wild)
    out = out.join(h, F.col("key") == F.col("k"), "left").drop("k").withColumnRenamed("hard_db", "own")
    out = out.join(h, F.col("wild") == F.col("k"), "left").drop("k").withColumnRenamed("hard_db", "any_type")
    soft = lead.select(F.col("key").alias("k"), F.col("db").alias("voted"))
    out = out.join(soft, F.col("wild") == F.col("k"), "left").drop("k")
    strong = lambda c: F.when(~F.lower(c).isin(*weak), F.col(c))
    return out.select("key", F.coalesce(strong("own"), strong("any_type"), "voted", "own", "any_type", F.lit(default)).alias("db"))


def plain_name(name: Column) -> Column:
    """A name without brackets and quotes, cut to its last three parts."""
    bare = F.regexp_replace(F.trim(name), r'[\[\]"`]', "")
    parts = F.filter(F.split(bare, r"\."), lambda p: F.length(p) > 0)
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), F.lit(3)), ".")


def schema_and_table(name: Column) -> Column:
    """`schema.table` of a name of one to three parts; the schema is dbo where none is given."""
    parts = F.split(plain_name(name), r"\.")
    return F.when(F.size(parts) == 1, F.concat(F.lit("dbo."), parts[0])).otherwise(F.array_join(F.slice(parts, -2, 2), "."))


def referenced(sql: Column) -> Column:
    """Array of the names that follow FROM, JOIN, UPDATE or MERGE INTO in SQL text, comments aside."""
    bare = F.regexp_replace(F.regexp_replace(sql, r"(?s)/\*.*?\*/", " "), r"--[^\n]*", " ")
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(bare, F.lit(r"(?i)\b(?:from|join|update|merge\s+into)\s+([\[\]\w.#@]+)"), F.lit(1)), lambda n: F.lower(plain_name(n)))))


# what scripts tell of databases

_THREE = r"([\[\]\w]+\s*\.\s*[\[\]\w]+\s*\.\s*[\[\]\w#]+)"
#: First parts of names that are no databases.
NO_DATABASE = ("view", "function", "procedure", "tempdb")


def _uncommented(sql: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(sql, r"(?s)/\*.*?\*/", " "), r"--[^\n]*", " ")


def _named(scripts: DataFrame, pattern: str) -> DataFrame:
    """(name, found, db, key) of three-part names that a pattern finds in scripts (name, sql_text); key: `schema.table` in small letters."""
    found = scripts.select("name", F.explode(F.regexp_extract_all(_uncommented(F.col("sql_text")), F.lit(pattern), F.lit(0))).alias("found"))
    bare = F.split(F.regexp_replace(F.regexp_extract("found", _THREE, 1), r"[\[\]\s]", ""), r"\.")
    return found.select("name", "found", bare[0].alias("db"), F.lower(F.concat_ws(".", bare[1], bare[2])).alias("key")).where(~F.lower("db").isin(*NO_DATABASE))


def script_votes(scripts: DataFrame) -> DataFrame:
    """(name, db, n): for each script, 1 for every three-part name and 3 more for each that an INSERT or SELECT INTO fills."""
    every = _named(scripts, _THREE).select("name", "db", F.lit(1).alias("weight"))
    filled = _named(scripts, rf"(?i)\bINTO\s+{_THREE}").select("name", "db", F.lit(3).alias("weight"))
    return every.unionByName(filled).groupBy("name", "db").agg(F.sum("weight").cast("long").alias("n"))


def learn(scripts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hard: key, db; votes: key, db, weight) that scripts teach.

    CREATE settles the typed key of what it makes, a target the key of any type with 10 votes, a reference gives 1 vote.
    """
    made = _named(scripts, rf"(?i)\bCREATE\s+(?:OR\s+ALTER\s+)?(?:TABLE|VIEW|PROCEDURE|PROC|FUNCTION)\s+{_THREE}")
    kind = F.regexp_replace(F.lower(F.regexp_extract("found", r"(?i)\b(TABLE|VIEW|PROCEDURE|PROC|FUNCTION)\b", 1)), "^proc$", "procedure")
    typed = made.select(F.concat(kind, F.lit("::"), "key").alias("key"), F.upper("db").alias("db"))
    filled = _named(scripts, rf"(?i)\b(?:INTO|UPDATE)\s+{_THREE}").select(F.concat(F.lit("*::"), "key").alias("key"), F.upper("db").alias("db"))
    read = _named(scripts, rf"(?i)\b(?:FROM|JOIN)\s+{_THREE}").select(F.concat(F.lit("*::"), "key").alias("key"), F.upper("db").alias("db"))
    votes = filled.withColumn("weight", F.lit(10)).unionByName(read.withColumn("weight", F.lit(1)))
    one = lambda df: df.groupBy("key").agg(F.max("db").alias("db"))
    return one(typed.unionByName(filled)), votes


def save(hard: DataFrame, tallied: DataFrame, path: str | Path) -> None:
    """Writes what is settled (key, db) and tallied votes (key, db, n) as one JSON file."""
    soft: dict[str, dict[str, int]] = {}
    for r in tallied.orderBy("key", "db").toLocalIterator():
        soft.setdefault(r["key"], {})[r["db"]] = r["n"]
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps({"hard": {r["key"]: r["db"] for r in hard.orderBy("key").toLocalIterator()}, "soft": soft}, indent=2, ensure_ascii=False), encoding="utf-8")


def load(spark: SparkSession, path: str | Path) -> tuple[DataFrame, DataFrame]:
    """(hard: key, db; tallied: key, db, n) of a file that `save` wrote; empty where there is none."""
    told = json.loads(Path(path).read_text(encoding="utf-8")) if Path(path).exists() else {}
    soft = [(k, db, n) for k, counts in told.get("soft", {}).items() for db, n in counts.items()]
    return spark.createDataFrame(list(told.get("hard", {}).items()), "key string, db string"), spark.createDataFrame(soft, "key string, db string, n long")
