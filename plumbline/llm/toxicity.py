"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word enters as a learnt vector beside the two final states of a character network that reads its letters both ways.
Vectors are learnt for the words and word beginnings of the training sample that tell most about its labels; a word takes
its own vector, else that of its longest known beginning, else one that all others share. A second network of that kind reads the words of a window both
ways; attention pools its states, and a linear layer gives the window's log odds. A text is cut into overlapping windows
that cover all of it, and the highest window decides. Training knows only the labels of whole texts, so each round picks
the window of each text that the network finds most toxic (and a few others of the clean texts) and descends on those.
A first guess at those windows comes from the words and word beginnings that set toxic texts apart.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import slices
from plumbline.llm.quality_model import held_out, one_text_an_id

#: Labelled rows of each label that the fit may use at most: the bound of what the driver holds, with whole texts.
MAX_POSITIVE, MAX_NEGATIVE = 900, 1500
THRESHOLD = 0.5
WINDOW, STRIDE = 32, 24
#: Letters of a word that the character network reads at once; a longer word enters as several.
WORD_LETTERS = 16
VOCABULARY, MIN_TEXTS = 3000, 5
LETTERS, LETTER_DIM, LETTER_STATE, WORD_DIM, WORD_STATE, ATTENTION = 256, 8, 12, 8, 8, 8
EPOCHS, BATCH, RATE = 7, 128, 0.01
#: Steps of descent that a small sample gets at least, by smaller batches and more rounds.
LEAST_STEPS = 240
#: Words whose inputs a worker keeps, and windows that run side by side.
CACHE_WORDS, SIDE_BY_SIDE = 150_000, 1024

_WORDS = re.compile(rf"\w{{1,{WORD_LETTERS}}}")


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters and digits; runs of more than WORD_LETTERS in parts."""
    return _WORDS.findall(text.lower())


def window_starts(n: int) -> range:
    """Starts of windows of WINDOW words, STRIDE apart, that cover all `n` words; an empty text has one empty window."""
    return range(0, max(1, n - (WINDOW - STRIDE)), STRIDE)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def run_gru(inputs: np.ndarray, recurrent: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (steps, rows, size) of a gated recurrent layer. inputs: (steps, rows, 3 * size), already times the input
    weights; mask: (steps, rows, 1), 0 where a row has no such step and its state stays. keep: gets what learning needs."""
    size = recurrent.shape[0]
    h = np.zeros((inputs.shape[1], size), dtype=inputs.dtype)
    states = np.empty((*inputs.shape[:2], size), dtype=inputs.dtype)
    for t in range(len(inputs)):
        hu = h @ recurrent
        gates = _sigmoid(inputs[t, :, : 2 * size] + hu[:, : 2 * size])
        z, r = gates[:, :size], gates[:, size:]
        c = np.tanh(inputs[t, :, 2 * size :] + r * hu[:, 2 * size :])
        new = c + z * (h - c)
        if keep is not None:
            keep.append((h, z, r, c, hu[:, 2 * size :]))
        h = h + mask[t] * (new - h)
        states[t] = h
    return states


def back_gru(grads: np.ndarray, recurrent: np.ndarray, mask: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of a gated recurrent layer's inputs and recurrent weights from those of its states."""
    size = recurrent.shape[0]
    d_inputs = np.empty((*grads.shape[:2], 3 * size), dtype=grads.dtype)
    d_recurrent, dh = np.zeros_like(recurrent), np.zeros_like(grads[0])
    for t in range(len(grads) - 1, -1, -1):
        h, z, r, c, huc = kept[t]
        dh = dh + grads[t]
        dn = dh * mask[t]
        d_c = dn * (1 - z) * (1 - c * c)
        d_z = dn * (h - c) * z * (1 - z)
        d_r = d_c * huc * r * (1 - r)
        d_inputs[t] = np.concatenate([d_z, d_r, d_c], axis=1)
        d_hu = np.concatenate([d_z, d_r, d_c * r], axis=1)
        d_recurrent += h.T @ d_hu
        dh = dh * (1 - mask[t]) + dn * z + d_hu @ recurrent.T
    return d_inputs, d_recurrent


class Network:
    def __init__(self, vocabulary: list[str], seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        small = lambda *shape: (0.1 * rng.standard_normal(shape)).astype(np.float32)
        zero = lambda *shape: np.zeros(shape, dtype=np.float32)
        joint = WORD_DIM + 2 * LETTER_STATE
        self.number = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.p = {"letters": small(LETTERS, LETTER_DIM), "words": small(len(vocabulary) + 1, WORD_DIM)}
        for way in ("ahead", "back"):
            self.p |= {f"c_in_{way}": draw(LETTER_DIM, 3 * LETTER_STATE), f"c_b_{way}": zero(3 * LETTER_STATE), f"c_u_{way}": draw(LETTER_STATE, 3 * LETTER_STATE)}
            self.p |= {f"w_in_{way}": draw(joint, 3 * WORD_STATE), f"w_b_{way}": zero(3 * WORD_STATE), f"w_u_{way}": draw(WORD_STATE, 3 * WORD_STATE)}
        self.p |= {"att": draw(2 * WORD_STATE, ATTENTION), "att_b": zero(ATTENTION), "att_v": draw(ATTENTION, 1), "out": draw(2 * WORD_STATE, 1), "out_b": zero(1)}
        self.seen: dict[str, int] = {}
        self.table = [zero(1, 3 * WORD_STATE), zero(1, 3 * WORD_STATE)]

    def __getstate__(self) -> dict:
        return {"number": self.number, "p": self.p}

    def __setstate__(self, state: dict) -> None:
        self.number, self.p = state["number"], state["p"]
        self.forget()

    def forget(self) -> None:
        self.seen, self.table = {}, [np.zeros((1, 3 * WORD_STATE), dtype=np.float32) for _ in range(2)]

    # words

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        codes = np.zeros((WORD_LETTERS, len(words)), dtype=np.int64)
        raw = np.frombuffer("".join(w.ljust(WORD_LETTERS, "\0") for w in words).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(words), WORD_LETTERS)
        codes[:] = np.where(raw < LETTERS, raw, 1 + raw % (LETTERS - 1)).T
        return codes, (raw.T != 0).astype(np.float32)[:, :, None]

    def read_words(self, words: list[str], keep: dict | None = None) -> np.ndarray:
        """(words, WORD_DIM + 2 * LETTER_STATE): the learnt vector and the character network's final states."""
        codes, mask = self._letters(words)
        longest = max(1, int(mask.sum(axis=0).max())) if len(words) else 1
        codes, mask = codes[:longest], mask[:longest]
        number = self.number
        ids = np.array([next((number[p] for p in _parts(w) if p in number), 0) for w in words], dtype=np.int64)
        parts, kept = [self.p["words"][ids]], {}
        for way, turn in (("ahead", 1), ("back", -1)):
            kept[way] = [] if keep is not None else None
            by_letter = self.p["letters"] @ self.p[f"c_in_{way}"] + self.p[f"c_b_{way}"]
            parts.append(run_gru(by_letter[codes][::turn], self.p[f"c_u_{way}"], mask[::turn], kept[way])[-1])
        if keep is not None:
            keep |= {"codes": codes, "mask": mask, "ids": ids, "letters": self.p["letters"][codes], "kept": kept}
        return np.concatenate(parts, axis=1)

    def back_words(self, grad: np.ndarray, keep: dict, g: dict[str, np.ndarray]) -> None:
        np.add.at(g["words"], keep["ids"], grad[:, :WORD_DIM])
        d_letters = np.zeros_like(keep["letters"])
        at = WORD_DIM
        for way, turn in (("ahead", 1), ("back", -1)):
            states = np.zeros((*keep["mask"].shape[:2], LETTER_STATE), dtype=np.float32)
            states[-1] = grad[:, at : at + LETTER_STATE]
            at += LETTER_STATE
            d_in, d_u = back_gru(states, self.p[f"c_u_{way}"], keep["mask"][::turn], keep["kept"][way])
            d_in = d_in[::turn]
            g[f"c_u_{way}"] += d_u
            g[f"c_b_{way}"] += d_in.sum(axis=(0, 1))
            g[f"c_in_{way}"] += np.tensordot(keep["letters"], d_in, axes=([0, 1], [0, 1]))
            d_letters += d_in @ self.p[f"c_in_{way}"].T
        np.add.at(g["letters"], keep["codes"], d_letters)

    def rows_of(self, words: list[str]) -> list[int]:
        """Rows of `table` for the words, those not met before being read first. Row 0 is no word."""
        missing = list(set(words).difference(self.seen))
        if missing:
            if len(self.seen) + len(missing) > CACHE_WORDS and self.seen:
                self.forget()
                missing = list(set(words))
            made: list[list[np.ndarray]] = [[], []]
            missing.sort(key=lambda w: (len(w), w))  # words of a length side by side
            for k in range(0, len(missing), SIDE_BY_SIDE):
                vectors = self.read_words(missing[k : k + SIDE_BY_SIDE])
                for i, way in enumerate(("ahead", "back")):
                    made[i].append(vectors @ self.p[f"w_in_{way}"] + self.p[f"w_b_{way}"])
            first = len(self.table[0])
            self.table = [np.concatenate([t, *m]) for t, m in zip(self.table, made, strict=True)]
            self.seen.update(zip(missing, range(first, first + len(missing)), strict=True))
        return list(map(self.seen.__getitem__, words))

    # windows

    def pool(self, inputs: list[np.ndarray], mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Log odds of windows. inputs: for each way (steps, rows, 3 * WORD_STATE); mask: (steps, rows, 1)."""
        kept = {"ahead": [], "back": []} if keep is not None else {"ahead": None, "back": None}
        states = np.concatenate(
            [run_gru(inputs[0], self.p["w_u_ahead"], mask, kept["ahead"]), run_gru(inputs[1][::-1], self.p["w_u_back"], mask[::-1], kept["back"])[::-1]], axis=2
        )
        hidden = np.tanh(states @ self.p["att"] + self.p["att_b"])
        weight = hidden @ self.p["att_v"]
        weight = np.exp(np.clip(weight, -20, 20)) * mask
        weight = weight / np.maximum(weight.sum(axis=0), 1e-9)
        pooled = (weight * states).sum(axis=0)
        if keep is not None:
            keep |= {"states": states, "hidden": hidden, "weight": weight, "pooled": pooled, "kept": kept, "mask": mask}
        return (pooled @ self.p["out"] + self.p["out_b"])[:, 0]

    def back_pool(self, grad: np.ndarray, keep: dict, g: dict[str, np.ndarray]) -> list[np.ndarray]:
        g["out"] += keep["pooled"].T @ grad[:, None]
        g["out_b"] += grad.sum()
        d_pooled = grad[:, None] * self.p["out"].T
        states, weight, hidden, mask = keep["states"], keep["weight"], keep["hidden"], keep["mask"]
        d_weight = (states * d_pooled).sum(axis=2, keepdims=True)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0, keepdims=True))
        g["att_v"] += np.tensordot(hidden, d_score, axes=([0, 1], [0, 1]))
        d_hidden = d_score * self.p["att_v"].T * (1 - hidden * hidden)
        g["att"] += np.tensordot(states, d_hidden, axes=([0, 1], [0, 1]))
        g["att_b"] += d_hidden.sum(axis=(0, 1))
        d_states = weight * d_pooled + d_hidden @ self.p["att"].T
        ahead, g_ahead = back_gru(d_states[:, :, :WORD_STATE], self.p["w_u_ahead"], mask, keep["kept"]["ahead"])
        back, g_back = back_gru(d_states[::-1, :, WORD_STATE:], self.p["w_u_back"], mask[::-1], keep["kept"]["back"])
        g["w_u_ahead"] += g_ahead
        g["w_u_back"] += g_back
        return [ahead, back[::-1]]

    def window_scores(self, rows: np.ndarray) -> np.ndarray:
        """Log odds of windows given as (windows, WINDOW) rows of the table."""
        out = np.empty(len(rows), dtype=np.float32)
        for k in range(0, len(rows), SIDE_BY_SIDE):
            part = rows[k : k + SIDE_BY_SIDE].T
            out[k : k + SIDE_BY_SIDE] = self.pool([t[part] for t in self.table], (part > 0).astype(np.float32)[:, :, None])
        return out

    def text_windows(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Windows of all texts as rows of the table, and where each text's begin."""
        flat = self.rows_of([w for t in texts for w in t])
        windows, begins, at = [], [], 0
        for t in texts:
            begins.append(sum(map(len, windows[-1:])) + (begins[-1] if begins else 0))
            own = np.zeros(window_starts(len(t))[-1] + WINDOW, dtype=np.int64)
            own[: len(t)] = flat[at : at + len(t)]
            at += len(t)
            windows.append(np.lib.stride_tricks.sliding_window_view(own, WINDOW)[::STRIDE])
        return np.concatenate(windows) if windows else np.zeros((0, WINDOW), dtype=np.int64), np.array(begins, dtype=np.int64)

    def score(self, texts: list[str]) -> np.ndarray:
        """Of each text, the highest of its windows' scores, as a probability."""
        out = []
        start = 0
        while start < len(texts):
            split, size = [], 0  # as many texts as make about 60,000 words: what is in memory at once is bounded
            while start < len(texts) and (not split or size < 60_000):
                split.append(words_of(texts[start]))
                size += len(split[-1])
                start += 1
            windows, begins = self.text_windows(split)
            out.append(np.maximum.reduceat(self.window_scores(windows), begins))
        return 1 / (1 + np.exp(-np.concatenate(out).astype(float))) if out else np.zeros(0)


def train(texts: list[str], y: np.ndarray, prior: float, seed: int = 3) -> Network | None:
    """The network fitted to whole texts' labels; None if one label is missing. prior: share of label 1 among all labels,
    to which the sample's two halves are weighted, so that scores are probabilities."""
    if len(y) == 0 or y.min() == y.max():
        return None
    split = [words_of(t) for t in texts]
    odds = _word_odds(split, y)
    vocabulary = [w for w, _ in sorted(odds.items(), key=lambda x: (-abs(x[1][0]) * np.sqrt(x[1][1]), x[0]))][:VOCABULARY]
    net, rng = Network(vocabulary, seed), np.random.default_rng(seed)
    share = y.mean()
    weight = np.where(y == 1, prior / share, (1 - prior) / (1 - share)).astype(np.float32)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step = 0
    batch = int(np.clip(len(y) // 12, 16, BATCH))
    epochs = max(EPOCHS, -(-LEAST_STEPS * batch // (2 * len(y))))
    for epoch in range(epochs):
        net.forget()
        windows, begins = net.text_windows(split)
        words, ends = ["", *net.seen], np.append(begins[1:], len(windows))
        if epoch:
            logits = net.window_scores(windows)
        else:  # a first guess at which windows matter: those with the word that sets toxic texts apart most
            logits = np.array([max(odds.get(part, (0.0, 0))[0] for part in _parts(w)) for w in words])[windows].max(axis=1)
        tops = begins + np.array([logits[lo:hi].argmax() for lo, hi in zip(begins, ends, strict=True)])
        settled = epoch >= epochs // 2  # before that, both labels weigh the same, so that the rarer one is learnt at all
        chosen, target, factor = [], [], []
        for i, (lo, hi) in enumerate(zip(begins, ends, strict=True)):
            picks = {int(tops[i])} if y[i] else {int(tops[i]), int(rng.integers(lo, hi))}
            for w in sorted(picks):
                chosen.append(w)
                target.append(y[i])
                factor.append((weight[i] if settled else 0.5 / (share if y[i] else 1 - share)) / len(picks))
        order = rng.permutation(len(chosen))
        chosen, target, factor = (np.array(x)[order] for x in (chosen, target, factor))
        rate = RATE * min(1, 1.5 * (1 - epoch / epochs))
        for k in range(0, len(chosen), batch):
            step += 1
            _descend(net, words, windows[chosen[k : k + batch]], target[k : k + batch], factor[k : k + batch], moments, step, rate)
    net.forget()
    return net


def _parts(word: str) -> tuple[str, ...]:
    """A word and its beginnings, the longest first."""
    return word, word[:6] + "-", word[:5] + "-", word[:4] + "-"


def _word_odds(split: list[list[str]], y: np.ndarray) -> dict[str, tuple[float, int]]:
    """Smoothed log ratio of the shares of toxic and clean texts that have a word or a beginning, and how many do: MIN_TEXTS or more."""
    count: tuple[Counter, Counter] = (Counter(), Counter())
    for words, label in zip(split, y, strict=True):
        count[int(label)].update(set().union(*map(_parts, set(words))))
    n = [len(y) - y.sum() + 1, y.sum() + 1]
    return {w: (float(np.log((count[1][w] + 0.5) / n[1]) - np.log((count[0][w] + 0.5) / n[0])), k) for w in count[0].keys() | count[1].keys() if (k := count[0][w] + count[1][w]) >= MIN_TEXTS}


def _descend(net: Network, words: list[str], rows: np.ndarray, y: np.ndarray, factor: np.ndarray, moments: dict, step: int, rate: float) -> None:
    """One step of Adam on a batch of windows."""
    used, at = np.unique(rows, return_inverse=True)
    at = at.reshape(rows.shape)
    word_keep, keep = {}, {}
    vectors = net.read_words([words[i] for i in used], word_keep)
    mask = (rows > 0).T.astype(np.float32)[:, :, None]
    inputs = [(vectors @ net.p[f"w_in_{way}"] + net.p[f"w_b_{way}"])[at.T] for way in ("ahead", "back")]
    logits = net.pool(inputs, mask, keep)
    grad = ((_sigmoid(logits) - y) * factor / factor.sum()).astype(np.float32)
    g = {k: np.zeros_like(v) for k, v in net.p.items()}
    d_vectors = np.zeros_like(vectors)
    for d_in, way in zip(net.back_pool(grad, keep, g), ("ahead", "back"), strict=True):
        d_row = np.zeros((len(used), d_in.shape[2]), dtype=np.float32)
        np.add.at(d_row, at.T, d_in)
        g[f"w_in_{way}"] += vectors.T @ d_row
        g[f"w_b_{way}"] += d_row.sum(axis=0)
        d_vectors += d_row @ net.p[f"w_in_{way}"].T
    net.back_words(d_vectors, word_keep, g)
    for k, v in net.p.items():
        grown = g[k] + 1e-5 * v
        m, s = moments[k]
        m += 0.1 * (grown - m)
        s += 0.001 * (grown * grown - s)
        v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Network | None:
    """Labels are counted over all usable rows; texts come to the driver for at most MAX_POSITIVE + MAX_NEGATIVE of them."""
    usable = labels.where(~held_out(F.col(id_col)) & F.col(label).isin(0, 1)).groupBy(id_col).agg(F.max(label).alias("y"))
    counts = {r["y"]: r["count"] for r in usable.groupBy("y").count().collect()}
    if len(counts) < 2:
        return None
    drawn = usable.withColumn("draw", F.xxhash64(F.lit(11), id_col))
    chosen = [drawn.where(F.col("y") == y).orderBy("draw", id_col).limit(k).select(id_col, "y") for y, k in ((1, MAX_POSITIVE), (0, MAX_NEGATIVE))]
    rows = one_text_an_id(docs, chosen[0].unionByName(chosen[1]), id_col, text_col)
    got = rows.select("id", "text", F.col("y").cast("int")).toArrow().sort_by("id")
    return train([t or "" for t in got.column("text").to_pylist()], np.array(got.column("y").to_pylist(), dtype=float), counts[1] / sum(counts.values()))


def _scores(batches: Iterator[pa.RecordBatch], net: Network | None) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        score = net.score(texts) if net else np.zeros(len(texts))
        kept = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "text"]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(score, pa.float64())], names=[*(x for x in batch.schema.names if x != "text"), "score"])


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id_col, held_out, score, predicted.

    Only the text is an input of a score. A missing text scores like the empty one; where either label is missing among
    the rows that may be learnt from, all scores are 0. Repeated rows and missing ids are scored like any other, other
    columns are ignored, an empty table gives an empty result.
    """
    net = fit_toxicity(docs, labels, id_col=id_col, text_col=text_col)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), held_out(F.col(id_col)).alias("held_out"))
    scored = own.mapInArrow(lambda batches: _scores(batches, net), "id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int")).withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the rows whose whole text scores `threshold` or more; all columns are kept, whatever their names, in one pass.

    A missing text is scored like the empty one; missing and repeated ids, ties and repeated rows don't matter, as only the text
    decides. Where a label is missing among the rows that may be learnt from, all rows stay. An empty table gives an empty result.
    """
    net = fit_toxicity(docs, labels, id_col=id_col, text_col=text_col)
    shape = docs.schema

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            yield batch.filter(pa.array(net.score(texts) < threshold)) if net else batch

    return docs.mapInArrow(clean, shape)
