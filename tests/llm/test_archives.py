"""WARC archives: awkward rows, splits, members and version lines in payloads."""

import base64
import gzip
import hashlib

import numpy as np
import pytest
from test_rows import LONG

from plumbline.llm import warc

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc"


def round_trip(spark, rows, shape="page_id long, url string, html string"):
    return [tuple(r) for r in warc.archive_round_trip(spark.createDataFrame(rows, shape)).collect()]


def expected(rows):
    """By brute force: of equal payloads, the first of the rows with the largest id is the response."""
    best = {}
    for n, (i, _, html) in enumerate(rows):
        key = html or ""
        if key not in best or (i if i is not None else -1) > (rows[best[key]][0] if rows[best[key]][0] is not None else -1):
            best[key] = n
    out = []
    for n, (i, _, html) in enumerate(rows):
        raw, winner = (html or "").encode(), best[html or ""]
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if n == winner else "revisit", None if n == winner else rows[winner][0]))
    return out


def test_awkward_rows(spark):
    rows = [(1, "u", "<p>one</p>"), (1, "v", "<p>one</p>"), (1, "v", "<p>one</p>"), (2, None, None), (3, "w", ""), (None, "x", "no id"), (None, "x", "no id"), (4, "y", LONG), (5, "y", LONG), (6, "a\r\nb: c", "ü日\n\n")]
    rows += [(7, "z", f"x\r\n\r\n{FAKE}\r\n\r\ny"), (8, "z", FAKE), (9, "z", f"{FAKE}\r\n\r\n{FAKE}"), (10, "z", "WARC/1.1\r\n" * 5), (11, "z", "WARC/1.1\r\n")]
    order = lambda r: tuple((x is None, x) for x in r)
    assert sorted(round_trip(spark, rows), key=order) == sorted(expected(rows), key=order)
    assert round_trip(spark, []) == []


def test_columns_that_clash(spark):
    shape = "page_id long, url string, html string, digest string, row_no long, revisit boolean, sha string, id string"
    assert sorted(round_trip(spark, [(1, "u", "a", "d", 1, True, "s", "i"), (2, "u", "a", "d", 1, True, "s", "i")], shape)) == sorted(expected([(1, "u", "a"), (2, "u", "a")]))


def record(n, payload):
    return b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (n, len(payload), payload)


@pytest.mark.parametrize("split", [200, 1000, 10_000_000])
@pytest.mark.parametrize("members", [False, True])
def test_splits_and_members(spark, tmp_path, split, members):
    rng = np.random.default_rng(4)
    payloads = {}
    for n in range(120):
        payload = bytes(rng.integers(0, 256, int(rng.integers(0, 300))).astype(np.uint8))
        payloads[n] = payload + FAKE.encode() * int(rng.integers(0, 3)) if n % 5 == 0 else payload
    for part in range(2):
        records = [record(n, p) for n, p in payloads.items() if n % 2 == part]
        (tmp_path / f"part-{part}.{'warc.gz' if members else 'warc'}").write_bytes(b"".join(map(gzip.compress, records)) if members else b"".join(records))
    (tmp_path / "part-9.warc").write_bytes(b"no record " + record(1000, b"x"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        got = warc.read_archives(spark, f"file://{tmp_path}").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {int(r["page_id"]): bytes(r["payload"]) for r in got} == payloads and len(got) == len(payloads)
