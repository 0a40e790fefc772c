"""Byte-level BPE: encoding by a segment tree of pair ranks, and decoding.

A piece of text starts as single bytes. The leaves of a segment tree over byte positions hold the rank of the pair that
starts there (its live part and the next live one), inner nodes the smallest of their two, ties to the left; so the root
is the leftmost pair of lowest rank. A merge changes three leaves (its own, its left neighbour's and the swallowed
part's) and the paths above them. The same steps run over many pieces side by side as numpy rows, a row per piece, which
is the main path; a long piece has a tree of its own.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE = np.int64(2**62)
#: Bytes up to which pieces are merged side by side; any longer one is merged alone.
SIDE_BY_SIDE = 64
#: Pieces in one such batch, and pieces whose ids a worker keeps.
BATCH, CACHE_PIECES = 4096, 400_000
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)
        # a pair of ids is named left * 2**20 + right; every token that two others make up gives a pair
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left << 20 | right] = rank
        self.pairs = pairs
        names = np.array(sorted(pairs), dtype=np.int64)
        self.names, self.made = np.append(names, np.int64(2**62)), np.array([pairs[k] for k in names.tolist()] + [0], dtype=np.int64)
        self.known: dict[str, bytes] = {}

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBpe:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it makes no token."""
        name = left << 20 | right
        at = np.searchsorted(self.names, name)
        return np.where(self.names[at] == name, self.made[at], NONE)

    def merge_one(self, piece: bytes) -> list[int]:
        """The ids of one piece of any length."""
        n = len(piece)
        ids = self.single[np.frombuffer(piece, dtype=np.uint8)].tolist()
        after, before, pairs = list(range(1, n + 1)), list(range(-1, n - 1)), self.pairs
        width = 1 << max(0, n - 1).bit_length()
        none = (1 << 60, 0)
        tree = [none] * (2 * width)
        for i in range(n - 1):
            if (rank := pairs.get(ids[i] << 20 | ids[i + 1])) is not None:
                tree[width + i] = (rank, i)
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def update(i: int) -> None:
            j = after[i] if i >= 0 else n
            rank = pairs.get(ids[i] << 20 | ids[j]) if j < n else None
            point(i, none if rank is None else (rank, i))

        def point(i: int, value: tuple[int, int]) -> None:
            k = width + i
            tree[k] = value
            while k > 1:
                k >>= 1
                tree[k] = min(tree[2 * k], tree[2 * k + 1])

        while tree[1] is not none and tree[1][0] < none[0]:
            rank, i = tree[1]
            j = after[i]
            ids[i], after[i] = rank, after[j]
            if after[j] < n:
                before[after[j]] = i
            ids[j] = -1
            point(j, none)
            update(i)
            if before[i] >= 0:
                update(before[i])
        return [x for x in ids if x >= 0]

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as little-endian 32-bit numbers, all pieces merged side by side."""
        n, width = len(pieces), 1 << max(0, max(map(len, pieces)) - 1).bit_length()
        length = np.array([len(p) for p in pieces], dtype=np.int64)
        raw = np.frombuffer(b"".join(p.ljust(width + 1, b"\0") for p in pieces), dtype=np.uint8).reshape(n, width + 1)
        column = np.arange(width + 1)
        ids = np.where(column < length[:, None], self.single[raw], -1)  # -1: no live part starts here
        after = np.minimum(column + 1, length[:, None])
        before = np.broadcast_to(column - 1, (n, width + 1)).copy()
        # a node is rank * width + position, so the smaller of two is the lower rank, or the leftmost of equal ones
        tree = np.full((n, 2 * width), NONE, dtype=np.int64)
        first = self._rank(ids[:, :width], ids[:, 1:])
        first[(ids[:, :width] < 0) | (ids[:, 1:] < 0)] = NONE
        tree[:, width:] = np.where(first < NONE, first * width + column[:width], NONE)
        k = width
        while k > 1:
            tree[:, k // 2 : k] = np.minimum(tree[:, k : 2 * k : 2], tree[:, k + 1 : 2 * k : 2])
            k //= 2

        def point(row: np.ndarray, at: np.ndarray, value: np.ndarray | np.int64) -> None:
            node = at + width
            tree[row, node] = value
            while (node := node >> 1)[0] > 0:
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

        def pair(row: np.ndarray, at: np.ndarray) -> None:
            right = after[row, at]
            rank = self._rank(ids[row, at], np.maximum(ids[row, right], 0))
            point(row, at, np.where((right < length[row]) & (rank < NONE), rank * width + at, NONE))

        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            rank, i = np.divmod(tree[rows, 1], width)
            j = after[rows, i]
            beyond = after[rows, j]
            ids[rows, i] = rank
            ids[rows, j] = -1
            after[rows, i] = beyond
            before[rows, beyond] = i
            point(rows, j, NONE)
            pair(rows, i)
            left = before[rows, i]
            has = left >= 0
            if has.any():
                pair(rows[has], left[has])
            rows = rows[tree[rows, 1] < NONE]
        live = ids >= 0
        flat, counts = ids[live].astype("<u4").tobytes(), live.sum(axis=1)
        ends = np.cumsum(counts).tolist()
        return [flat[4 * (e - c) : 4 * e] for e, c in zip(ends, counts.tolist(), strict=True)]

    def learn(self, pieces: set[str]) -> None:
        """Puts the ids of pieces not met before into the cache."""
        if len(self.known) + len(pieces) > CACHE_PIECES:
            self.known.clear()
        short, long = [], []
        for piece in pieces - self.known.keys():
            raw = piece.encode("utf-8", "surrogatepass")
            if (rank := self.ranks.get(raw)) is not None:
                self.known[piece] = np.array([rank], dtype="<u4").tobytes()
            else:
                (short if len(raw) <= SIDE_BY_SIDE else long).append((raw, piece))
        short.sort(key=lambda x: len(x[0]))  # alike lengths side by side, so that trees are no wider than need be
        for k in range(0, len(short), BATCH):
            part = short[k : k + BATCH]
            self.known.update(zip((p for _, p in part), self.merge_many([r for r, _ in part]), strict=True))
        for raw, piece in long:
            self.known[piece] = np.array(self.merge_one(raw), dtype="<u4").tobytes()

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        cut = [self.pattern.findall(t) for t in texts]
        known = self.known
        new: set[str] = set()
        for pieces in cut:
            new.update(pieces)
        self.learn(new)
        for pieces in cut:
            yield b"".join(map(known.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_coders: dict[tuple[str, str], ByteBpe] = {}


def coder(path: str, pattern: str) -> ByteBpe:
    """One per worker process, with the pieces it has met."""
    key = (path, pattern)
    return _coders.get(key) or _coders.setdefault(key, ByteBpe.from_file(path, pattern))


def _batches(batches: Iterator[pa.RecordBatch], path: str, pattern: str, group: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Texts are taken in groups of about `group` characters, so many short ones share a batch and memory stays bounded."""
    bpe = coder(path, pattern)
    for batch in batches:
        ids, texts = batch.column("id"), batch.column("text").to_pylist()
        start = 0
        while start < len(texts):
            stop, size = start, 0
            while stop < len(texts) and (stop == start or size < group):
                size += len(texts[stop] or "")
                stop += 1
            coded = list(bpe.encode_all([t or "" for t in texts[start:stop]]))
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(start, stop - start),
                    pa.array([len(c) // 4 for c in coded], pa.int64()),
                    pa.array([hashlib.sha256(c).hexdigest() for c in coded], pa.string()),
                    pa.array([hashlib.sha256(bpe.decode(c)).hexdigest() for c in coded], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
            start = stop


def encode_documents(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id_col, n_tokens, ids_sha256, decoded_sha256 (of the bytes that the ids decode to).

    Missing and empty texts have no ids, and the hashes of nothing. Repeated rows and missing ids are kept as they are,
    other columns ignored; an empty table gives an empty result. No row leaves its partition.
    """
    path = ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    shape = pattern or public_tokenizers.PATTERN
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return own.mapInArrow(lambda batches: _batches(batches, path, shape), RESULT).withColumnRenamed("doc_id", id_col)
