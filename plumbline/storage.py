"""Table access, partitions by rows, lineage cuts and small tables in the plan."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` below `folder`."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Rows that one task joins and sorts at a time, of tables of which a task of each core would get more.
ROWS_A_TASK = 250_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """`df` in partitions by `keys`, as many as `rows` rows need, so that a task's memory doesn't grow with the table; as it is where there is a core for each.

    AQE joins partitions of a shuffle of its own to about one a core, or to a size of compressed bytes; not those of a given number.
    """
    n = -(-rows // ROWS_A_TASK)
    return df.repartition(n, *keys) if n > df.sparkSession.sparkContext.defaultParallelism else df


def cut(df: DataFrame) -> DataFrame:
    """`df` computed once into the shared checkpoint folder, so that loops don't grow the plan and survive lost executors."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        master = spark.sparkContext.master
        if not named and (not master.startswith("local") or master.startswith("local-cluster")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="plumbline-"))
    return df.checkpoint(eager=True)


def values(spark: SparkSession, rows: str, columns: str) -> DataFrame:
    """A small table written as SQL rows: part of the plan, read by no job."""
    return spark.sql(f"SELECT * FROM (VALUES {rows}) AS t({columns})")
