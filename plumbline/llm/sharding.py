"""Sharding by a K-d tree over the documents' metadata.

A node holding more than the target bytes is split at the byte-weighted median of its widest metadata dimension; the
halves are its children. Dimensions are scaled to the range they have in the whole corpus, so that widths compare; a
category's place is its rank by name. Medians are exact and found without moving a text or gathering rows: each level costs one
aggregate for the widths and four that sum bytes by the next 13 bits of a row's place along the dimension. The digits
are picked in the plan too; the driver gets a row per node. Each level is cut, so it doesn't repeat those before it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import crc32_of, cut, local_rows

#: Rows that one task numbers at most, on average, when slots are dealt out.
SLOT_ROWS = 50_000
_TIE_BITS = 28
_DIGIT_BITS = 13
_PLACE_BITS = 52
_VALUE_TOP = 2**24 - 1  # a dimension's value and the tie number fit _PLACE_BITS together
#: Categories of a dimension that are ordered by name in one place, and broadcast.
MOST_CATEGORIES = 10_000


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of the text (a missing one: none) plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(1)).cast("long")


def _scaled(value: Column, low: float, high: float) -> Column:
    """A value's place between the corpus's smallest and largest, from 0 to _VALUE_TOP; a missing one is 0."""
    return F.coalesce(F.floor((value.cast("double") - float(low)) / max(float(high) - float(low), 1.0) * _VALUE_TOP), F.lit(0)).cast("long")


def _with_dimensions(rows: DataFrame, numbers: list[str], categories: list[str]) -> DataFrame:
    """`rows` with a column d_x for each number and category x, in place of it."""
    ends = rows.agg(*[f(n).alias(f"{n}_{f.__name__}") for n in numbers for f in (F.min, F.max)]).first()
    rows = rows.select(*rows.columns, *[_scaled(F.col(n), ends[f"{n}_min"] or 0, ends[f"{n}_max"] or 0).alias(f"d_{n}") for n in numbers])
    for name in categories:
        known = rows.select(name).distinct()
        few = known.limit(MOST_CATEGORIES + 1).count()
        if few <= MOST_CATEGORIES:
            rank = F.row_number().over(Window.orderBy(F.col(name).asc_nulls_first())) - 1
            ranked = F.broadcast(known.select(F.col(name).alias("category"), (rank * F.lit(_VALUE_TOP) / F.lit(max(1, few - 1))).cast("long").alias(f"d_{name}")))
            rows = rows.join(ranked, F.col(name).eqNullSafe(F.col("category"))).drop("category")
        else:  # too many to order in one place: by their first four bytes
            head = F.conv(F.hex(F.rpad(F.substring(F.encode(F.coalesce(name, F.lit("")), "UTF-8"), 1, 3), 3, F.unhex(F.lit("00")))), 16, 10).cast("long")
            rows = rows.withColumn(f"d_{name}", F.coalesce(head, F.lit(0)))
    return rows.drop(*numbers, *categories)


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id_col, size, text_crc32, law, shard, slot, grown_shard.

    Give the number of shards, or the target bytes of a leaf, from which it follows. A node of `n` shards splits its bytes
    in the ratio of the shards its children get, so the number needn't be a power of two. Law `bytes`: shards hold nearly
    equal bytes, but for the largest document of each. Rows equal in a dimension are ordered by a hash of id and text, so
    ties, repeated rows and a hot source are cut through like anything else; only rows that agree in id and text are tied
    for good, and one group of those is as large as a cut can miss by. A missing text has size 1 and CRC 0; an empty
    table gives an empty result. slot numbers the rows of a shard from 0 without gaps.
    """
    spark = docs.sparkSession
    quoted = lambda name: F.col("`" + name.replace("`", "``") + "`")
    numbers, categories = ["length", "arrival"], [c for c in ("lang", "source") if c in docs.columns]
    tie = F.pmod(F.xxhash64(quoted(id_col), quoted(text_col)), F.lit(2**_TIE_BITS))
    read = docs.select(
        quoted(id_col).alias("id"),
        text_bytes(quoted(text_col)).alias("size"),
        crc32_of(quoted(text_col)).alias("text_crc32"),
        tie.alias("tie"),
        F.monotonically_increasing_id().alias("row_no"),
        F.coalesce(F.char_length(quoted(text_col)), F.lit(0)).cast("long").alias("length"),
        quoted(id_col).try_cast("double").alias("arrival"),
        *[quoted(c).cast("string").alias(c) for c in categories],
    )
    rows = cut(_with_dimensions(cut(read), numbers, categories))
    dims = [*numbers, *categories]
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    if shards is None:
        shards = max(1, math.ceil(total / target_bytes)) if target_bytes else 1
    placed, nodes = rows.withColumn("shard", F.lit(0)), {0: shards}  # a node is named by its first shard
    while n and any(k > 1 for k in nodes.values()):
        placed, nodes = _split(spark, placed, nodes, dims)
    return _slots(spark, placed, shards, n).select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def _split(spark: SparkSession, placed: DataFrame, nodes: dict[int, int], dims: list[str]) -> tuple[DataFrame, dict[int, int]]:
    """One level. The weighted median's place is found digit by digit, from at most 2**_DIGIT_BITS sums a node; the driver gets a row a node."""
    open_nodes = F.broadcast(local_rows(spark, [(k, w // 2, w) for k, w in nodes.items() if w > 1], "shard int, left_shards int, width int"))  # a row a node
    inside = placed.join(open_nodes, "shard")
    widths = inside.groupBy("shard", "left_shards", "width").agg(*[(F.max(f"d_{d}") - F.min(f"d_{d}")).alias(f"w_{d}") for d in dims], F.sum("size").alias("bytes"))
    widest = F.array_max(F.array(*[F.struct(F.col(f"w_{d}").alias("w"), F.lit(d).alias("dim")) for d in dims]))["dim"]
    state = cut(widths.select("shard", "left_shards", widest.alias("dim"), (F.col("bytes") * F.col("left_shards") / F.col("width")).alias("goal"), F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("here")))
    value = F.coalesce(*[F.when(F.col("dim") == d, F.col(f"d_{d}")) for d in dims])
    place = value * F.lit(2**_TIE_BITS) + F.col("tie")
    for shift in range(_PLACE_BITS - _DIGIT_BITS, -1, -_DIGIT_BITS):
        near = placed.join(F.broadcast(state), "shard").withColumn("place", place).where(F.shiftright("place", shift + _DIGIT_BITS) == F.col("prefix"))
        sums = near.groupBy(*state.columns, F.shiftright("place", shift).bitwiseAND(2**_DIGIT_BITS - 1).alias("digit")).agg(F.sum("size").alias("bytes"))
        upto = Window.partitionBy("shard").orderBy("digit")
        passed = sums.withColumn("sum", F.col("run") + F.sum("bytes").over(upto)).withColumn("last", F.lead("digit").over(upto).isNull())
        # the first digit at which the sum reaches the goal, or the last
        first = passed.where((F.col("sum") >= F.col("goal")) | F.col("last")).withColumn("nth", F.row_number().over(upto)).where("nth = 1")
        state = cut(first.select("shard", "left_shards", "dim", "goal", (F.shiftleft("prefix", _DIGIT_BITS) + F.col("digit")).alias("prefix"), (F.col("sum") - F.col("bytes")).alias("run"), F.col("bytes").alias("here")))
    # prefix is now the place at which the sum passes the goal; its own rows go to the nearer side
    bound = F.col("prefix") - (F.col("run") + F.col("here") - F.col("goal") > F.col("goal") - F.col("run")).cast("int")
    bounds = F.broadcast(state.select("shard", "dim", bound.alias("bound"), (F.col("shard") + F.col("left_shards")).cast("int").alias("upper")))
    moved = placed.join(bounds, "shard", "left")
    shard = F.when(F.col("bound").isNotNull() & (place > F.col("bound")), F.col("upper")).otherwise(F.col("shard"))
    children = {k: w for k, w in nodes.items() if w == 1}
    for k, w in nodes.items():
        if w > 1:
            children |= {k: w // 2, k + w // 2: w - w // 2}
    return cut(moved.withColumn("shard", shard.cast("int")).drop("dim", "bound", "upper")), children


def _slots(spark: SparkSession, placed: DataFrame, shards: int, n: int) -> DataFrame:
    """Numbers each shard's rows in pieces of about SLOT_ROWS; a piece starts where the pieces before it end."""
    pieces = max(16, math.ceil(n / SLOT_ROWS / max(1, shards)))
    dealt = cut(placed.withColumn("piece", F.pmod(F.xxhash64("row_no"), F.lit(pieces)).cast("int")).select("id", "size", "text_crc32", "row_no", "shard", "piece"))
    counts = dealt.groupBy("shard", "piece").count()
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "piece", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "piece").orderBy("row_no")
    return dealt.withColumn("nth", F.row_number().over(within)).join(starts, ["shard", "piece"]).withColumn("slot", (F.col("start") + F.col("nth") - 1).cast("long"))
