"""Front ends by dialect: each takes scripts and keeps what they define; `extract_lineage` gives one script's events and never raises."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import SparkSession

from plumbline.tsql import artifacts
from plumbline.tsql.frontend import Extractor

ADAPTERS: dict[str, type[Extractor]] = {"mssql": Extractor}


def get_adapter(name: str) -> Callable[..., Extractor]:
    """The front end of a dialect; KeyError for one that isn't known."""
    if name not in ADAPTERS:
        raise KeyError(f"unknown adapter {name!r}; known: {', '.join(sorted(ADAPTERS))}")
    return ADAPTERS[name]


def extract_lineage(spark: SparkSession, sql: str, hint: str = "script", adapter: str = "mssql", database: str = "WarehouseDB") -> str:
    """The OpenLineage event of what a script makes last, as JSON. What goes wrong is an event with an `error` field in its schema."""
    try:
        found = get_adapter(adapter)(spark, database)
        found.script(sql)
        rows = {r["name"]: r["event"] for r in artifacts.events(*found.tables(), dependencies=found.dependencies()).collect()}
        made = [name for name, o in found.objects.items() if name in rows]
        if made:
            return rows[made[-1]]
        message = "NO_PERSISTENT_OUTPUT_DETECTED"
    except KeyError:
        raise
    except Exception as error:  # a caller of many scripts goes on with the next
        message = f"{type(error).__name__}: {error}"
    schema = {"fields": [{"name": "error", "type": message}]}
    return json.dumps({"eventType": "COMPLETE", "job": {"namespace": "plumbline/scripts", "name": hint}, "inputs": [], "outputs": [{"namespace": artifacts.HOST + database, "name": hint, "facets": {"schema": schema}}]})
