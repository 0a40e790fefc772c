"""SQL scripts as a DataFrame: path, name, encoding, text."""

from __future__ import annotations

import codecs
import fnmatch
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The encodings that may be asked for, and byte order marks.
ENCODINGS = ("auto", "utf-8", "utf-8-sig", "utf-16le", "utf-16be", "cp1250")
_MARKS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16le"), (codecs.BOM_UTF16_BE, "utf-16be"))
_LIKE_SQL = re.compile(r"(?i)\b(select|insert|update|delete|create|alter|drop|from|where|join|table|view|procedure|function|declare|exec)\b")


def printable_share(text: str) -> float:
    return sum(c.isprintable() or c.isspace() for c in text) / len(text) if text else 1.0


def detect(content: bytes) -> str:
    """The likeliest encoding: a byte order mark decides; else each candidate is scored by what it makes of the bytes."""
    for mark, name in _MARKS:
        if content.startswith(mark):
            return name
    candidates = [("utf-8", 0.05), ("cp1250", 0.03)]
    even, odd = content[::2].count(0), content[1::2].count(0)
    if content and (even + odd) / len(content) >= 0.2 and max(even, odd) > 1.5 * min(even, odd):
        candidates.insert(0, ("utf-16le" if odd > even else "utf-16be", 0.5))
    best, chosen = -1.0, "utf-8"
    for name, prior in candidates:
        try:
            text = content.decode(name)
        except UnicodeDecodeError:
            continue
        share, like = printable_share(text), bool(_LIKE_SQL.search(text))
        score = prior + share + like - (0.15 if share < 0.85 and not like else 0)
        if score > best:
            best, chosen = score, name
    return chosen


def decode(content: bytes, encoding: str = "auto") -> tuple[str, str]:
    """(encoding, text). A forced encoding that makes nonsense of the bytes is an error, as is one they don't fit."""
    if encoding not in ENCODINGS:
        raise ValueError(f"unknown encoding {encoding!r}; known: {', '.join(ENCODINGS)}")
    used = detect(content) if encoding == "auto" else encoding
    text = content.decode(used, "replace" if encoding == "auto" else "strict")
    if encoding != "auto" and printable_share(text) < 0.9 and not _LIKE_SQL.search(text):
        raise ValueError(f"the bytes are not {encoding}")
    return used, text.lstrip("﻿").replace("\r\n", "\n").replace("\r", "\n")


def as_regex(globs: list[str]) -> str:
    """One Java regular expression for any of the globs, over a whole relative path or its last part."""
    made = [fnmatch.translate(g).replace(r"\Z", "").replace(r"\z", "") for g in globs]
    return r"(?:.*/)?(?:" + "|".join(m.removeprefix("(?s:").removesuffix(")") for m in made) + ")"


def scan(spark: SparkSession, folder: str, include: list[str] | None = None, exclude: list[str] | None = None, encoding: str = "auto") -> DataFrame:
    """path, name, encoding, text of all `*.sql` files below `folder`, decoded where they are read; sort by path for a fixed order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.sql").load(folder).select("path", "content")
    if include:
        files = files.where(F.col("path").rlike(rf"\A{as_regex(include)}\z"))
    if exclude:
        files = files.where(~F.col("path").rlike(rf"\A{as_regex(exclude)}\z"))

    def decoded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            pairs = [decode(bytes(c), encoding) for c in f["content"]]
            yield pd.DataFrame({"path": f["path"], "encoding": [p[0] for p in pairs], "text": [p[1] for p in pairs]})

    return files.mapInPandas(decoded, "path string, encoding string, text string").select("path", F.regexp_extract("path", r"([^/]+)\.sql\z", 1).alias("name"), "encoding", "text")
