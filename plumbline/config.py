"""Settings and catalogue files: YAML where a parser is installed, JSON always."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path


@dataclass
class Settings:
    default_database: str = "WarehouseDB"
    default_schema: str = "dbo"
    sql_dir: str = "sql"
    out_dir: str = "build/lineage"
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    ignore: list[str] = field(default_factory=list)
    severity_threshold: str = "BREAKING"
    encoding: str = "auto"


def parsed(path: str | Path) -> dict:
    """The mapping in a YAML or JSON file."""
    raw = Path(path).read_text(encoding="utf-8")
    if str(path).endswith(".json"):
        return json.loads(raw) or {}
    import yaml  # only needed for YAML files

    return yaml.safe_load(raw) or {}


def settings(path: str | Path | None = None, ignore_file: str | Path | None = None, **given) -> Settings:
    """File over defaults, arguments over the file; keys not known are passed over. Lines of the ignore file join `ignore`."""
    known = {f.name for f in fields(Settings)}
    told = {k: v for k, v in (parsed(path) if path and Path(path).exists() else {}).items() if k in known}
    out = Settings(**(told | {k: v for k, v in given.items() if v is not None}))
    if ignore_file and Path(ignore_file).exists():
        lines = (x.strip() for x in Path(ignore_file).read_text(encoding="utf-8").splitlines())
        out.ignore = [*out.ignore, *(x for x in lines if x and not x.startswith("#") and x not in out.ignore)]
    return out


def catalogue(path: str | Path) -> list[tuple[str, list[tuple[str, str, bool]]]]:
    """(table, [(column, type, nullable)]) of a catalogue file; columns in order of `ordinal` where it is given."""
    out = []
    for t in parsed(path).get("tables", []):
        columns = sorted(enumerate(t.get("columns", [])), key=lambda x: (x[1].get("ordinal", x[0]), x[0]))
        out.append((t["name"], [(c["name"], c.get("type", "unknown"), bool(c.get("nullable", True))) for _, c in columns]))
    return out


def dbt_variables(folder: str | Path) -> dict:
    """`vars` of the dbt project in a folder or its parent; empty where there is none."""
    for at in (Path(folder), Path(folder).parent):
        if (at / "dbt_project.yml").exists():
            return parsed(at / "dbt_project.yml").get("vars") or {}
    return {}
