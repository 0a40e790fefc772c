"""Hierarchical residual packing of tokenised documents into sequences of bounded length.

Every partition packs its pieces best-fit and emits the bins that are nearly full. Underfull bins travel on as items:
groups of partitions merge in a tree, each node packing its items best-fit again, until one node is left. A bin carries
its pieces as (document, piece, start, length, checksum), so no join is needed to learn where a piece ended up, and the
token ids themselves never travel.
"""

from __future__ import annotations

import bisect
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut, slices

CAPACITY = 2048
#: Partitions that one node of the tree merges.
FAN_IN = 8
#: A bin with at most this many free places is emitted where it was made; a level further up counts FAN_IN times as many
#: as full, up to half the capacity. Two bins beyond that half fit together, so each block passes on one at most.
SLACK = 8
#: Items that a node packs at once; more are packed in blocks of this many, which bounds its memory.
BLOCK_ITEMS = 200_000
#: Words whose ids a worker keeps, and as many of the time before: about 200 bytes each.
CACHE_WORDS = 150_000

_BIN = "done boolean, length int, first long, pieces array<struct<doc_id: long, piece: int, start: long, length: int, crc: long, row_no: long, at: int>>"
_FIELDS = ("doc_id", "piece", "start", "length", "crc", "row_no", "at")
_PIECE = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("crc", pa.int64()), ("row_no", pa.int64()), ("at", pa.int32())])
_ARROW = pa.schema([("done", pa.bool_()), ("length", pa.int32()), ("first", pa.int64()), ("pieces", pa.list_(_PIECE))])
#: Marks, of which the tokenizer cuts any run from a word of letters before it: ASCII punctuation but the apostrophe.
_MARKS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
#: Below this, small letters are the same by Python and by the tokenizer, and composed forms stay composed.
_FOLDS_ALIKE = "\u0250"


class WordTokenizer:
    """Ids of whole texts, by ids of their words.

    The tokenizer drops white space and works within words only, so a text's ids are its words' ids in a row. Words are cut
    at space, tab and line ends alone; any other white space stays inside a "word" and is left to the tokenizer. It also
    folds case and cuts marks from letters, so a word of letters that ends in marks has the ids of both, and a capital
    those of the small letter: what it is asked for is plain stems, most of which are known.
    """

    def __init__(self, path: str, end_id: int = 0) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.end = array("I", [end_id]).tobytes()
        # how byte-level tokenizers write bytes: printable Latin-1 as it is, the others from U+0100 on
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = [b for b in range(256) if b not in plain]
        self.alphabet = {b: chr(256 + i) for i, b in enumerate(rest)}
        self.known = _Known(self.tokenizer, self.alphabet, {})

    def ids_of(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        for text in texts:
            if len(self.known) > CACHE_WORDS:  # the words of the time before last are dropped
                self.known = _Known(self.tokenizer, self.alphabet, dict(self.known))
            yield np.frombuffer(b"".join([*map(self.known.__getitem__, _words(text or "")), self.end]), dtype="<u4")


class _Known(dict):
    """Ids of words as bytes; a word not met yet is asked of the tokenizer."""

    def __init__(self, tokenizer, alphabet: dict[int, str], older: dict[str, bytes]) -> None:  # noqa: ANN001
        super().__init__({"": b""})
        self.encode, self.tokenize, self.alphabet, self.older = tokenizer.encode, tokenizer.model.tokenize, alphabet, older

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.made(word)
        self[word] = ids
        return ids

    def made(self, word: str) -> bytes:
        if not word.isascii() and (max(word) >= _FOLDS_ALIKE or "\u0130" in word):
            return self.plain(word)
        low = word.lower()
        stem = low.rstrip(_MARKS)
        if not stem.isalpha():
            return self.plain(word)
        if len(stem) < len(low):  # the mark, or run of marks, is cut from the letters
            return self[stem] + self[low[len(stem) :]]
        if low != word:
            return self[low]
        # folded letters: only the merges are left to do
        raw = low if low.isascii() else low.encode().decode("latin-1").translate(self.alphabet)
        return array("I", [t.id for t in self.tokenize(raw)]).tobytes()

    def plain(self, word: str) -> bytes:
        return array("I", self.encode(word, add_special_tokens=False).ids).tobytes()


def _words(text: str) -> list[str]:
    """A text cut at space, tab and line ends. Latin-1 folds alike letter by letter, so the whole text is folded at once and has fewer words."""
    try:
        text.isascii() or text.encode("latin-1")
        text = text.lower()
    except UnicodeEncodeError:
        pass
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


_tokenizers: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One per worker process, with what it has learnt of the corpus's words."""
    return _tokenizers.get(path) or _tokenizers.setdefault(path, WordTokenizer(path))


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of indices: the longest item first, each into the fullest bin that still holds it, by order of index."""
    free: list[int] = []  # sorted free places that some bin has
    bins_with: list[list[int]] = [[] for _ in range(capacity + 1)]
    out: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        size = lengths[i]
        at = bisect.bisect_left(free, size)
        if at < len(free):
            room = free[at]
            b = bins_with[room].pop()
            if not bins_with[room]:
                del free[at]
        else:
            room, b = capacity, len(out)
            out.append([])
        out[b].append(i)
        left = room - size
        if left:
            if not bins_with[left]:
                bisect.insort(free, left)
            bins_with[left].append(b)
    return out


def _pack(items: list[tuple[int, list[tuple]]], capacity: int, slack: int) -> pa.RecordBatch:
    """items: (length, pieces). Bins with more than `slack` free places stay open."""
    rows: dict[str, list] = {"done": [], "length": [], "first": [], "pieces": []}
    for members in best_fit([x[0] for x in items], capacity):
        length, pieces = 0, []
        for i in members:
            pieces += [(*p[:-1], p[-1] + length) for p in items[i][1]] if length else items[i][1]
            length += items[i][0]
        for name, value in zip(rows, (length >= capacity - slack, length, pieces[0][0], [dict(zip(_FIELDS, p, strict=True)) for p in pieces]), strict=True):
            rows[name].append(value)
    return pa.RecordBatch.from_pydict(rows, schema=_ARROW)


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, slack: int) -> Iterator[pa.RecordBatch]:
    """Tokenises whole texts and packs their pieces in blocks of BLOCK_ITEMS."""
    tok, items = word_tokenizer(path), []
    for batch in slices(batches):
        docs, texts, rows = (batch.column(c).to_pylist() for c in ("id", "text", "row_no"))
        for doc_id, row_no, ids in zip(docs, rows, tok.ids_of(texts), strict=True):
            for n, at in enumerate(range(0, len(ids), capacity)):
                part = ids[at : at + capacity]
                items.append((len(part), [(doc_id, n, at, len(part), zlib.crc32(part.tobytes()), row_no, 0)]))
        if len(items) >= BLOCK_ITEMS:
            yield _pack(items, capacity, slack)
            items = []
    if items:
        yield _pack(items, capacity, slack)


def _merge(batches: Iterator[pa.RecordBatch], capacity: int, slack: int) -> Iterator[pa.RecordBatch]:
    items: list[tuple[int, list[tuple]]] = []
    for batch in batches:
        for length, pieces in zip(batch.column("length").to_pylist(), batch.column("pieces").to_pylist(), strict=True):
            items.append((length, [tuple(p.values()) for p in pieces]))
        if len(items) >= BLOCK_ITEMS:
            yield _pack(items, capacity, slack)
            items = []
    if items:
        yield _pack(items, capacity, slack)


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and the end id 0 (a missing or empty text: the end id alone). Only documents longer than
    `capacity` are cut, into pieces of `capacity` and a last one that may be shorter. Rows that repeat an id are packed
    each for itself; ids may be missing. Other columns are ignored. An empty table gives an empty result.
    """
    path = tokenizer_path or public_tokenizers.path("word_bpe_49k.json")
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row_no"))
    slack = SLACK
    level = cut(own.mapInArrow(lambda batches, slack=slack: _pieces(batches, path, capacity, slack), _BIN))
    width = max(1, level.rdd.getNumPartitions())
    bins = level.where("done")
    while width > 1:
        width = -(-width // FAN_IN)
        slack = capacity if width == 1 else min(slack * FAN_IN, capacity // 2)  # the root leaves nothing open
        # a node takes its items by the document that opens them, longest first, so a lost task packs again as before
        items = level.where("NOT done").repartition(width, F.xxhash64("first", "length")).sortWithinPartitions(F.desc("length"), "first", F.col("pieces")[0]["row_no"])
        level = cut(items.mapInArrow(lambda batches, slack=slack: _merge(batches, capacity, slack), _BIN))
        bins = bins.unionByName(level.where("done"))
    bins = bins.unionByName(level.where("NOT done"))  # only where the first level had a single partition
    placed = bins.select(F.monotonically_increasing_id().alias("sequence_id"), "pieces").select("sequence_id", F.explode("pieces").alias("p"))
    return placed.select(
        F.col("p.doc_id").alias(id_col), "p.piece", "p.start", F.col("p.length").cast("long").alias("length"), F.col("p.crc").alias("ids_crc32"), "sequence_id", F.col("p.at").cast("long").alias("offset")
    )
