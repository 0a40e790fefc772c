"""WARC archives: writing, and reading by boundary-chain verification.

Archives are written by Spark's text sink, so they reach any store Spark writes to: a record's header and payload are one
value, and the four bytes that end a WARC record are the sink's line separator. They are read by Spark's text source, split
at every version line, so a file of any size is dealt out to as many tasks as it has splits (a compressed file: one). A task
emits each version line's offset with the offset its Content-Length leads to. Within a split, each is followed to where its
chain leaves the split; between splits, pointer jumping from the file's start doubles the distance a round and retains the
offsets that a reader walking the file would come to. A version line inside a payload is never one of them; the pieces into
which it cuts the payload are put together again.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import cut, shared_dir, written
from plumbline.llm.exact_dedup import elect

MAGIC = b"WARC/1.1\r\n"
END = "\r\n\r\n"
RECORDS_PER_FILE = 2000
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

RECORD = "path string, start long, next long, record_type string, page_id string, url string, refers_to string, payload_digest string, payload_bytes long, payload binary"
_TOLD = ("record_type", "page_id", "url", "refers_to", "payload_digest", "payload_bytes", "payload")
#: start and next count from the split's first byte after a version line; whole: no other version line is in the record.
_PIECE = "path string, block long, nth long, start long, length long, next long, whole boolean, record_type string, page_id string, url string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: 40 hex digits in eight runs of 20 bits, four letters each."""
    runs = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(F.sha1(payload), i * 5 + 1, F.lit(5)), 16, 10).cast("int"))
    letter = lambda v, shift: F.substring(F.lit(_ALPHABET), F.shiftright(v, shift).bitwiseAND(31) + 1, F.lit(1))
    return F.array_join(F.transform(runs, lambda v: F.concat(*[letter(v, s) for s in (15, 10, 5, 0)])), "")


def write_archives(pages: DataFrame, to: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes a record per row of `pages` below the folder `to`: a response, or a revisit of an equal payload's response.

    The response of equal payloads is the row with the largest id (see exact_dedup for missing and repeated ids). A
    missing html is an empty payload, a missing url an empty target; missing ids are written as `-`. Other columns are
    ignored.
    """
    own = pages.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), F.monotonically_increasing_id().alias("row_no")
    )
    digest = F.unhex(F.sha1(F.encode("html", "UTF-8")))
    groups = elect(cut(own.select("id", digest.alias("digest"), "row_no")))
    # one row a group; page rows find it by id and digest, so their texts move once and never all to one hot digest
    chosen = groups.where("group_size > 1").groupBy("id", "digest").agg(F.max("keep_id").alias("keep_id"), F.max((F.col("row_no") == F.col("keep_row")).cast("int")).alias("wins"), F.count(F.lit(1)).alias("copies"))
    told = written(chosen.select(F.col("id").alias("g_id"), F.col("digest").alias("g_digest"), "keep_id", (F.col("wins") == 1).alias("wins"), "copies"))
    found = own.drop("row_no").withColumn("digest", digest).join(told, F.col("id").eqNullSafe(F.col("g_id")) & (F.col("digest") == F.col("g_digest")), "left")
    plain = F.col("g_digest").isNull() | ~F.col("wins") | (F.col("copies") == 1)
    rows = found.where(plain).withColumn("revisit", F.col("g_digest").isNotNull() & ~F.col("wins"))
    if not told.where("wins AND copies > 1").isEmpty():  # rows that repeat the winner's id and payload: one of them is the response
        again = cut(found.where(~plain).withColumn("row_no", F.monotonically_increasing_id()))
        first = again.groupBy(F.col("id").alias("f_id"), F.col("digest").alias("f_digest")).agg(F.max("row_no").alias("first"))
        again = again.join(first, F.col("id").eqNullSafe(F.col("f_id")) & (F.col("digest") == F.col("f_digest"))).withColumn("revisit", F.col("row_no") != F.col("first"))
        rows = rows.unionByName(again.select(rows.columns))
    rows = rows.select("id", "url", "html", "revisit", "keep_id", base32_sha1(F.encode("html", "UTF-8")).alias("sha"), F.octet_length("html").alias("bytes"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    name_of = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    uri = lambda c: F.concat(F.lit("<urn:page:"), name_of(c), F.lit(">"))
    safe_url = F.regexp_replace("url", r"[\r\n]+", " ")
    head = F.concat(
        F.lit(MAGIC.decode()),
        line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", uri(F.col("id"))),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        line("WARC-Target-URI", safe_url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha"))),
        line("WARC-Payload-Length", F.col("bytes").cast("string")),
        F.when(F.col("revisit"), F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", uri(F.col("keep_id"))))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(F.col("revisit"), F.lit("0")).otherwise(F.col("bytes").cast("string"))),
        F.lit("\r\n"),
    )
    record = F.concat(head, F.when(F.col("revisit"), F.lit("")).otherwise(F.col("html")))
    rows.select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(to)


def header(data: bytes) -> tuple[dict[str, str], int, int] | None:
    """(fields, where the payload starts, where it stops) of a record without its version line; None if it can't be one."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for row in data[:end].split(b"\r\n"):
        name, colon, value = row.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not length.isascii() or not length.isdigit():
        return None
    return fields, end + 4, end + 4 + int(length)


def _said(fields: dict[str, str], body: bytes, payloads: bool) -> tuple:
    """_TOLD of a record. What a response says of itself is computed anew from its payload; a revisit has only its header."""
    response = fields.get("warc-type") != "revisit"
    digest = base64.b32encode(hashlib.sha1(body).digest()).decode() if response else fields.get("warc-payload-digest", "").removeprefix("sha1:")
    size = len(body) if response else int(fields.get("warc-payload-length", "0"))
    ident = lambda x: None if (m := re.fullmatch(r"<urn:page:(.*)>", x or "")) is None or m[1] == "-" else m[1]
    return fields.get("warc-type"), ident(fields.get("warc-record-id")), fields.get("warc-target-uri"), ident(fields.get("warc-refers-to")), digest, size, body if payloads else None


def _pieces(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pd.DataFrame]:
    """A row per piece between version lines, in a split's order, with what its header says if it has one."""
    names, at, split, nth = [c.split()[0] for c in _PIECE.split(", ")], 0, None, 0
    for frame in batches:
        out = []
        for path, block, data in zip(frame["path"], frame["block"], frame["value"], strict=True):
            data = bytes(data)
            if (path, block) != split:
                split, at, nth = (path, block), 0, 0
            told = header(data)
            whole = bool(told) and len(data) == told[2] + 4 and data[told[2] :] == b"\r\n\r\n"
            out.append((path, block, nth, at - len(MAGIC), len(data), at + told[2] + 4 if told else None, whole, *(_said(told[0], data[told[1] : told[2]], payloads) if whole else (None,) * 7)))
            at, nth = at + len(data) + len(MAGIC), nth + 1
        if out:
            yield pd.DataFrame(out, columns=names).astype({"next": "Int64", "payload_bytes": "Int64"})


def reachable(starts: np.ndarray, nexts: np.ndarray, entry: int = 0) -> np.ndarray:
    """Which of the sorted starts a walk from `entry` comes to, by pointer jumping: each round doubles the jump and the marked part."""
    n = len(starts)
    first = int(np.searchsorted(starts, entry))
    if first >= n or starts[first] != entry:
        return np.zeros(n, dtype=bool)
    jump = np.append(_following(starts, nexts), n)
    marked = np.zeros(n + 1, dtype=bool)
    marked[first] = True
    for _ in range(max(1, int(n).bit_length())):
        marked[jump[marked]] = True
        jump = jump[jump]
    return marked[:n]


def _following(starts: np.ndarray, nexts: np.ndarray) -> np.ndarray:
    """The place of each next offset among the starts; their number where it isn't among them."""
    n = len(starts)
    to = np.searchsorted(starts, nexts)
    return np.where((to < n) & (starts[np.minimum(to, n - 1)] == nexts), to, n) if n else to


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, start, to): where the chain from each start of a split leaves it."""
    for batch in batches:
        for path, chain in zip(batch.column("path").to_pylist(), batch.column("chain"), strict=True):
            starts, nexts = (chain.values.field(c).to_numpy() for c in ("start", "next"))
            n = len(starts)
            last, jump = np.arange(n + 1), np.append(_following(starts, nexts), n)
            for _ in range(max(1, int(n).bit_length())):  # a jump that stays is taken, one that leaves is not
                stays = jump[last] < n
                last = np.where(stays, jump[last], last)
                jump = np.where(jump < n, np.where(jump[jump] < n, jump[jump], jump), n)
            yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array(starts), pa.array(nexts[last[:n]])], names=["path", "start", "to"])


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, start) of what a walk from a split's entry comes to."""
    for batch in batches:
        for path, entry, chain in zip(batch.column("path").to_pylist(), batch.column("entry").to_pylist(), batch.column("chain"), strict=True):
            starts, nexts = (chain.values.field(c).to_numpy() for c in ("start", "next"))
            hit = starts[reachable(starts, nexts, entry)]
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(hit), pa.string()), pa.array(hit)], names=["path", "start"])


def _split_at_version_lines(spark: SparkSession, folder: str) -> DataFrame:
    text = spark.read.option("lineSep", MAGIC.decode()).option("pathGlobFilter", "part-*").text(folder)
    return text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """A row per record of the archives below `folder`: RECORD's columns, offsets counting uncompressed bytes.

    Files may be plain, or gzip of one or many members. A file that doesn't start with a record has none; a record whose
    Content-Length leads past the file's end, or to no record, is the last of its file. No files: no rows.
    """
    found = written(_split_at_version_lines(spark, folder).mapInPandas(lambda frames: _pieces(frames, payloads), _PIECE))
    sizes = found.groupBy("path", "block").agg(F.sum(F.col("length") + len(MAGIC)).alias("size"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(sizes.select(F.col("path").alias("b_path"), F.col("block").alias("b_block"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"), "size"))
    at_base = (F.col("path") == F.col("b_path")) & (F.col("block") == F.col("b_block"))
    placed = found.join(bases.drop("size"), at_base).withColumn("start", F.col("start") + F.col("base")).withColumn("next", F.col("next") + F.col("base")).drop("b_path", "b_block", "base")
    headed = placed.where("next IS NOT NULL AND start >= 0")
    chains = written(headed.groupBy("path", "block").agg(F.array_sort(F.collect_list(F.struct("start", "next"))).alias("chain")))
    entries = _entries(chains)
    inside = chains.join(entries, "path").where((F.col("entry") >= F.col("chain")[0]["start"]) & (F.col("entry") <= F.element_at("chain", -1)["start"]))
    reached = inside.select("path", "entry", "chain").mapInArrow(_walked, "path string, start long").select(F.col("path").alias("r_path"), F.col("start").alias("r_start"))
    records = headed.join(reached, (F.col("path") == F.col("r_path")) & (F.col("start") == F.col("r_start"))).select("path", "start", "next", "whole", *_TOLD)
    cut_ones = written(records.where("NOT whole").select("path", "start", "next"))
    whole = records.where("whole").select("path", "start", "next", *_TOLD)
    return whole if cut_ones.isEmpty() else whole.unionByName(_joined(spark, folder, cut_ones, bases, payloads))


def _entries(chains: DataFrame) -> DataFrame:
    """(path, entry): the offsets at which a walk of each file enters its splits, by pointer jumping between them."""
    jumps = written(chains.mapInArrow(_exits, "path string, start long, to long"))
    marked = jumps.where("start = 0").select("path", F.col("start").alias("entry"))
    if chains.where("block > 0").isEmpty():
        return marked
    # only offsets that another split leads to can be entries
    led = jumps.select(F.col("path").alias("l_path"), F.col("to").alias("l_to")).distinct()
    jumps = written(jumps.join(led, (F.col("path") == F.col("l_path")) & (F.col("start") == F.col("l_to")), "left_semi").unionByName(jumps.where("start = 0")))
    marked, n = written(marked), -1
    while (now := marked.count()) != n:
        n = now
        onward = marked.join(jumps, (marked["path"] == jumps["path"]) & (marked["entry"] == jumps["start"])).select(marked["path"], F.col("to").alias("entry"))
        ends = jumps.select(F.col("path").alias("j_path"), F.col("start").alias("j_start"), F.col("to").alias("j_to"))
        onward = onward.join(ends, (F.col("path") == F.col("j_path")) & (F.col("entry") == F.col("j_start")), "left_semi")
        marked = written(marked.unionByName(onward).distinct())
        far = jumps.join(ends, (F.col("path") == F.col("j_path")) & (F.col("to") == F.col("j_start")), "left")
        jumps = written(far.select("path", "start", F.coalesce("j_to", "to").alias("to")))
    return marked


def _joined(spark: SparkSession, folder: str, cut_ones: DataFrame, bases: DataFrame, payloads: bool) -> DataFrame:
    """Records that have version lines inside: their pieces are read again, from the splits that hold any, and joined."""
    spans = cut_ones.select(F.col("path").alias("s_path"), F.col("start").alias("s_start"), F.col("next").alias("s_next"))
    touched = spans.join(bases, (F.col("s_path") == F.col("b_path")) & (F.col("base") - len(MAGIC) < F.col("s_next")) & (F.col("base") + F.col("size") > F.col("s_start")))
    touched = touched.select("s_path", "s_start", "s_next", F.col("b_block").alias("s_block"), "base")
    raw = _split_at_version_lines(spark, folder).mapInPandas(_raw_pieces, "path string, block long, start long, value binary")
    mine = raw.join(touched, (F.col("path") == F.col("s_path")) & (F.col("block") == F.col("s_block")) & (F.col("start") + F.col("base") >= F.col("s_start")) & (F.col("start") + F.col("base") < F.col("s_next")))
    parts = mine.groupBy("path", F.col("s_start").alias("begin"), F.col("s_next").alias("next")).agg(F.array_sort(F.collect_list(F.struct((F.col("start") + F.col("base")).alias("at"), "value"))).alias("parts"))

    def join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, begin, following, pieces in zip(frame["path"], frame["begin"], frame["next"], frame["parts"], strict=True):
                data = MAGIC.join(bytes(p["value"]) for p in pieces)
                fields, lo, hi = header(data)
                out.append((path, begin, following, *_said(fields, data[lo:hi], payloads)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RECORD.split(", ")])

    return parts.mapInPandas(join, RECORD)


def _raw_pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    at, split = 0, None
    for frame in frames:
        starts = []
        for path, block, data in zip(frame["path"], frame["block"], frame["value"], strict=True):
            if (path, block) != split:
                split, at = (path, block), 0
            starts.append(at - len(MAGIC))
            at += len(data) + len(MAGIC)
        yield frame.assign(start=starts)[["path", "block", "start", "value"]]


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", folder: str | None = None) -> DataFrame:
    """Writes `pages` to archives and reads them back: id_col, payload_bytes, payload_digest, record_type, refers_to.

    A row per row of `pages`. A missing html is an empty payload, a missing id stays missing. Of rows with equal payloads that
    with the largest id is the response, a missing id being the smallest; of rows that repeat id and payload, exactly one.
    Other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, folder, id_col)
    kind = pages.schema[id_col].dataType
    back = read_archives(spark, folder, payloads=False)
    return back.select(F.col("page_id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
