"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins; a lookup table per feature, and one per pair of features, holds what a bin adds
to the log odds. The tables are learnt by cyclic boosting: round after round, each feature in turn gets a shallow tree
fitted to the residual of all others, at a small learning rate; then the pairs that promise most get trees over both
bins. Scoring is one lookup and addition per table, for whole columns at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that the fit may use at most: the bound of what the driver holds.
MAX_TRAINING_ROWS = 20_000
THRESHOLD = 0.3
BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE, LEAVES, MIN_LEAF = 48, 240, 80, 12, 0.1, 3, 12

FEATURES = (
    "log_chars", "log_words", "word_length", "upper_share", "digit_share", "symbol_share", "stop_share", "pipe_share", "exclaim_share", "beyond_ascii_share",
    "distinct_share", "top_word_share", "repeat_neighbours", "repeat_window_share", "dup_line_share", "line_words", "short_word_share", "long_word_share", "stop_word_rate", "upper_start_share",
)
# The commonest function words of four languages.
_FUNCTION_WORDS = frozenset("the of and to in is that for it with as on be by this at le la les de des du et un en que pour der die das und von zu mit ist el los y no por su con una se".split())


def features(text: str) -> list[float]:
    """The numbers of one whole text, in the order of FEATURES; an empty text is all zeros."""
    raw = text.encode("utf-8", "surrogatepass")
    words = text.split()
    n, chars = len(words), len(text)
    if not chars or not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    share = lambda chars_in: float(counts[[ord(c) for c in chars_in]].sum()) / chars
    seen = Counter(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    number: dict[str, int] = dict(zip(seen, range(len(seen)), strict=True))
    ids = np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=n)
    windows = ids[:-1] * len(seen) + ids[1:]
    lines = [x for x in text.split("\n") if x.strip()]
    function = sum(k for w, k in seen.items() if w.lower().strip(".,;:!?") in _FUNCTION_WORDS)
    starts = sum(k for w, k in seen.items() if w[0].isupper())
    return [
        float(np.log1p(chars)),
        float(np.log1p(n)),
        float(lengths.mean()),
        float(counts[65:91].sum()) / chars,
        float(counts[48:58].sum()) / chars,
        share("#*$%&<>@=_/^~+"),
        share(".,;:?"),
        share("|"),
        share("!"),
        float(counts[192:].sum()) / chars,  # each character beyond ASCII starts with one such byte
        len(seen) / n,
        max(seen.values()) / n,
        float((ids[1:] == ids[:-1]).mean()) if n > 1 else 0.0,
        1 - len(np.unique(windows)) / len(windows) if n > 1 else 0.0,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        float(np.log1p(n / max(1, len(lines)))),
        float((lengths <= 2).mean()),
        float((lengths >= 12).mean()),
        function / n,
        starts / n,
    ]


class AdditiveModel:
    """Lookup tables over binned features and pairs of them."""

    def __init__(self, bins: int = BINS) -> None:
        self.bins, self.edges, self.tables, self.pairs, self.base = bins, [], np.zeros(0), {}, 0.0

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        """x: rows of features; y: 0 or 1. With one label only (or no rows), the model is a constant."""
        n, width = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) if n else np.zeros(0) for j in range(width)]
        self.tables = np.zeros((width, self.bins))
        share = (y.sum() + 0.5) / (n + 1)
        self.base = float(np.log(share / (1 - share)))
        if n == 0 or y.min() == y.max():
            return self
        b = self.binned(x)
        margin = np.full(n, self.base)
        for _ in range(ROUNDS):
            for j in range(width):
                p = 1 / (1 + np.exp(-margin))
                step = RATE * _tree(b[:, j], y - p, p * (1 - p), self.bins)
                self.tables[j] += step
                margin += step[b[:, j]]
        for i, j in self._promising(b, y, margin):
            self.pairs[i, j] = np.zeros((self.bins, self.bins))
        for _ in range(PAIR_ROUNDS):
            for (i, j), grid in self.pairs.items():
                p = 1 / (1 + np.exp(-margin))
                step = RATE * _pair_tree(b[:, i], b[:, j], y - p, p * (1 - p), self.bins)
                grid += step
                margin += step[b[:, i], b[:, j]]
        return self

    def _promising(self, b: np.ndarray, y: np.ndarray, margin: np.ndarray) -> list[tuple[int, int]]:
        """The pairs whose first tree explains most of what the single tables leave over."""
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        gain = {}
        for i in range(b.shape[1]):
            for j in range(i):
                step = _pair_tree(b[:, i], b[:, j], g, h, self.bins)[b[:, i], b[:, j]]
                gain[i, j] = float((g * step - h * step * step / 2).sum())
        return sorted(gain, key=lambda k: (-gain[k], k))[:PAIRS]

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        margin = self.base + self.tables[np.arange(b.shape[1]), b].sum(axis=1)
        for (i, j), grid in self.pairs.items():
            margin = margin + grid[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def _tree(bin_of: np.ndarray, g: np.ndarray, h: np.ndarray, bins: int) -> np.ndarray:
    """A tree of up to LEAVES leaves over one feature's bins, as the value of each bin: splits are greedy, by Newton gain."""
    sums = np.stack([np.bincount(bin_of, w, bins) for w in (g, h, np.ones(len(g)))])
    total = np.concatenate([np.zeros((3, 1)), sums.cumsum(axis=1)], axis=1)
    leaves = [(0, bins)]
    for _ in range(LEAVES - 1):
        best = (1e-9, None, None)
        for leaf in leaves:
            lo, hi = leaf
            at = np.arange(lo + 1, hi)
            if not len(at):
                continue
            left, right = total[:, at] - total[:, [lo]], total[:, [hi]] - total[:, at]
            whole = total[:, hi] - total[:, lo]
            gain = left[0] ** 2 / (left[1] + 1) + right[0] ** 2 / (right[1] + 1) - whole[0] ** 2 / (whole[1] + 1)
            gain = np.where((left[2] >= MIN_LEAF) & (right[2] >= MIN_LEAF), gain, 0)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], leaf, int(at[k]))
        if best[1] is None:
            break
        leaves.remove(best[1])
        leaves += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(bins)
    for lo, hi in leaves:
        s = total[:, hi] - total[:, lo]
        out[lo:hi] = s[0] / (s[1] + 1)
    return out


def _pair_tree(a: np.ndarray, b: np.ndarray, g: np.ndarray, h: np.ndarray, bins: int) -> np.ndarray:
    """A tree of depth two over a pair's bins: one cut of the first feature, and one of the second on each side of it."""
    cell = a * bins + b
    sums = np.stack([np.bincount(cell, w, bins * bins).reshape(bins, bins) for w in (g, h, np.ones(len(g)))])
    total = np.zeros((3, bins + 1, bins + 1))
    total[:, 1:, 1:] = sums.cumsum(axis=1).cumsum(axis=2)
    upper, lower = total[:, 1:-1, :], total[:, [-1], :] - total[:, 1:-1, :]  # first feature below the cut, and above it

    def best_cut(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right = side[:, :, 1:-1], side[:, :, [-1]] - side[:, :, 1:-1]
        value = left[0] ** 2 / (left[1] + 1) + right[0] ** 2 / (right[1] + 1)
        value = np.where((left[2] >= MIN_LEAF) & (right[2] >= MIN_LEAF), value, 0)
        at = value.argmax(axis=1)
        return at, value[np.arange(len(at)), at]

    (cut_u, gain_u), (cut_l, gain_l) = best_cut(upper), best_cut(lower)
    k = int((gain_u + gain_l).argmax())
    out = np.zeros((bins, bins))
    for rows, side, c in ((slice(0, k + 1), upper, cut_u[k]), (slice(k + 1, bins), lower, cut_l[k])):
        whole, left = side[:, k, -1], side[:, k, c + 1]
        for columns, s in ((slice(0, c + 1), left), (slice(c + 1, bins), whole - left)):
            out[rows, columns] = s[0] / (s[1] + 1) if s[2] >= MIN_LEAF else 0
    return out


def held_out(id_column: Column) -> Column:
    """Whether a row's label must not be learnt from: crc32 of the id as text leaves 0 when divided by 5."""
    return F.pmod(F.crc32(F.encode(F.coalesce(id_column.cast("string"), F.lit("")), "UTF-8")), F.lit(5)) == 0


def training_rows(docs: DataFrame, labels: DataFrame, label: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """At most about `limit` rows (text, y), none of them held out, drawn by a hash of the id so that they are the same each time.

    The labels are narrowed down before they meet the texts, and travel to them: they are bounded by `limit`.
    """
    usable = labels.where(~held_out(F.col(id_col)) & F.col(label).isin(0, 1)).groupBy(id_col).agg(F.max(label).alias("y"))
    chosen = usable.withColumn("draw", F.xxhash64(F.lit(7), id_col)).orderBy("draw", id_col).limit(limit)
    return one_text_an_id(docs, chosen, id_col, text_col)


def one_text_an_id(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, y) of the chosen ids (id_col, y; a bounded number): of rows that repeat an id, the smallest text, found before any shuffle."""
    told = F.broadcast(chosen.select(F.col(id_col).alias("id"), "y"))
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(told, "id").groupBy("id", "y").agg(F.min("text").alias("text"))


def _feature_rows(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t or "") for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64())), batch.column("y")], schema=schema)


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = MAX_TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text") -> AdditiveModel:
    """Features of the drawn rows are taken on the executors; the driver gets `limit` rows of numbers, in order of id."""
    schema = pa.schema([("id", pa.int64()), ("x", pa.list_(pa.float64())), ("y", pa.int32())])
    rows = training_rows(docs, labels, label, limit, id_col, text_col).select(F.col("id").cast("long").alias("id"), "text", F.col("y").cast("int"))
    got = rows.mapInArrow(lambda batches: _feature_rows(batches, schema), "id long, x array<double>, y int").toArrow()
    got = got.sort_by("id")
    x = np.array(got.column("x").to_pylist(), dtype=float).reshape(len(got), len(FEATURES))
    return AdditiveModel().fit(x, np.array(got.column("y").to_pylist(), dtype=float))


def _scores(batches: Iterator[pa.RecordBatch], model: AdditiveModel) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        x = np.array([features(t or "") for t in texts], dtype=float).reshape(len(texts), len(FEATURES))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column("held_out"), pa.array(model.score(x), pa.float64())], names=["id", "held_out", "score"])


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id_col, held_out, score, predicted.

    Only the text is an input of a score; a missing text scores like the empty one. Labels are learnt from rows that are
    not held out; where no usable label is found, every score is one half. Repeated rows and missing ids are scored like
    any other, other columns are ignored, an empty table gives an empty result.
    """
    model = fit_quality(docs, labels, id_col=id_col, text_col=text_col)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), held_out(F.col(id_col)).alias("held_out"))
    scored = own.mapInArrow(lambda batches: _scores(batches, model), "id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int")).withColumnRenamed("id", id_col)
