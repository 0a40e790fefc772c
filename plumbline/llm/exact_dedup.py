"""Exact duplicates by a heavy-hitter split.

A Misra-Gries summary (Spark's freqItems, the Karp-Schenker-Papadimitriou form of it) names every digest that may fill
more than `support` of the rows. Those few are counted exactly and their winners broadcast, so the copies of a hot text
are resolved in the map task that reads them; all other digests take an ordinary shuffle, in which the minima and counts of a
group are combined before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import cut, local_rows, written

#: Share of the rows from which a digest counts as frequent. At most 1 / SUPPORT digests can be, which bounds the broadcast.
SUPPORT = 0.001
#: Rows (id, digest) that may be broadcast to tell what goes: 100 bytes each or less.
FEW_GONE = 200_000


def text_digest(text: Column) -> Column:
    """SHA-256 (32 bytes) of the UTF-8 text; a missing text counts as empty."""
    return F.unhex(F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256))


def elect(rows: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Adds to `rows` (id, digest, row_no) of each digest: keep_id, keep_row (of the row with the largest id) and group_size.

    `rows` must be cut from its lineage, as row_no has to stay what it is over several passes. A missing id is smaller
    than any other; of rows that repeat an id, the one with the largest row_no wins.
    """
    spark = rows.sparkSession
    keyed = rows.withColumn("key", F.xxhash64("digest"))
    candidates = keyed.stat.freqItems(["key"], support).first()[0] or []  # at most 1 / support numbers
    best = F.max(F.struct(F.col("id").alias("keep_id"), F.col("row_no").alias("keep_row")))
    frequent = []
    if candidates:
        named = F.broadcast(local_rows(spark, [(k,) for k in candidates], "key long"))
        frequent = (
            keyed.join(named, "key", "left_semi")
            .groupBy("digest")
            .agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
            .where("group_size > 1")
            .select("digest", "best.keep_id", "best.keep_row", "group_size")
            .collect()  # verified winners, bounded like the candidates
        )
    schema = T.StructType(
        [
            T.StructField("digest", rows.schema["digest"].dataType),
            T.StructField("keep_id", rows.schema["id"].dataType),
            T.StructField("keep_row", T.LongType()),
            T.StructField("group_size", T.LongType()),
        ]
    )
    winners = F.broadcast(local_rows(spark, [tuple(r) for r in frequent], schema))
    hot = rows.join(winners, "digest", "inner")
    cold = rows.join(winners, "digest", "left_anti")
    chosen = cold.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    rest = cold.join(chosen, "digest").select(*rows.columns, "best.keep_id", "best.keep_row", "group_size")
    return hot.select(rest.columns).unionByName(rest)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per row of `docs`: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after no change; a missing text equals the empty one. Of equal texts the row with the
    largest id stays (a missing id is the smallest; of whole rows that repeat, exactly one stays). Other columns are
    ignored, whatever their names; an empty table gives an empty result.
    """
    meta = cut(docs.select(F.col(id_col).alias("id"), text_digest(F.col(text_col)).alias("digest"), F.monotonically_increasing_id().alias("row_no")))
    return elect(meta, support).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("row_no") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """`docs` with one row of each text, all columns kept, whatever their names; see exact_duplicates for which row.

    What goes is told as (id, digest): up to FEW_GONE of those are broadcast, so texts aren't moved at all; more take one join by
    digest, into which each text goes once. Rows that repeat both id and text of a row that stays are numbered, one of them stays.
    """
    meta = cut(docs.select(F.col(id_col).alias("id"), text_digest(F.col(text_col)).alias("digest"), F.monotonically_increasing_id().alias("row_no")))
    found = elect(meta, support).where("group_size > 1")
    lost = ~F.col("id").eqNullSafe(F.col("keep_id"))
    told = written(found.groupBy("id", "digest").agg(F.max(lost).alias("lost"), F.count(F.lit(1)).alias("copies")).where("lost OR copies > 1"))
    own = docs.select(F.struct(*map(_quoted, docs.columns)).alias("row"), F.col(id_col).alias("id"), text_digest(F.col(text_col)).alias("digest"))
    gone, again = told.where("lost"), told.where("NOT lost")
    kept = own.join(_small(gone), _same(own, gone), "left_anti")
    if not again.isEmpty():
        copies = cut(kept.join(_small(again), _same(kept, again), "left_semi").withColumn("nth", F.monotonically_increasing_id()))
        first = copies.groupBy("id", "digest").agg(F.min("nth").alias("nth"))
        one = copies.join(_small(first), _same(copies, first) & (copies["nth"] == first["nth"]), "left_semi")
        kept = kept.join(_small(again), _same(kept, again), "left_anti").unionByName(one.drop("nth"))
    return kept.select("row.*")


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _same(a: DataFrame, b: DataFrame) -> Column:
    return (a["digest"] == b["digest"]) & a["id"].eqNullSafe(b["id"])


def _small(told: DataFrame) -> DataFrame:
    return F.broadcast(told) if told.count() <= FEW_GONE else told
