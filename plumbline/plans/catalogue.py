"""All queries of the library but the corpus operators', by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.plans import metadata, warehouse
from plumbline.plans.oracles import METADATA, WAREHOUSE

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    found = {name: getattr(warehouse, name, None) or getattr(warehouse, f"q_{name}") for name in WAREHOUSE if name != "merge_upsert"}
    found["merge_upsert"] = warehouse.q_merge_upsert
    return found | {name: getattr(metadata, name) for name in METADATA}
