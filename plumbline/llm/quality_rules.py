"""Quality rules by distribution divergence.

A document's histograms of character classes and of common words are compared with references of its language by
Jensen-Shannon distance. The references are learnt from the corpus itself: every document that passes the base rules
gives its histograms to the language whose common words it uses most, and a reference is the mean of those histograms,
so one long document weighs no more than a short one. Below a minimum length a distance says little; those documents
are judged by the base rules alone. Words that are common in no language share one bar of the histogram.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut

MIN_WORDS = 50
#: Characters from which a histogram of classes is trusted, and words from which one of common words is.
MIN_CHARS, MIN_WORDS_SEEN = 200, 50
#: Largest Jensen-Shannon distance (base 2, 0 to 1) from the language's reference: (at any length, more by one over the
#: root of the length), as a short text strays further from its language by chance.
CHAR_BOUND, WORD_BOUND = (0.1, 2.2), (0.2, 1.05)
SYMBOLS = "#*$%&|<>"

# Function words of four languages.
COMMON_WORDS = {
    "en": "the of and to in a is that for it with as was on be by this are at from or an have not you he".split(),
    "fr": "le la les de des du et un une en que qui dans pour pas sur au par ne se ce il est avec plus son".split(),
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an er so wie".split(),
    "es": "el la los de que y en un una ser se no por con su para como las del al lo más este si sobre todo".split(),
}
LANGUAGES = sorted(COMMON_WORDS)
CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "other", "line")
_WORDS = {lang: {w: i for i, w in enumerate(words)} for lang, words in COMMON_WORDS.items()}
_N_WORDS = max(map(len, COMMON_WORDS.values())) + 1  # the last bar: any other word

_ARROW = pa.schema(
    [
        ("id", pa.int64()),
        ("n_words", pa.int64()),
        ("word_chars", pa.int64()),
        ("n_symbols", pa.int64()),
        ("n_dup_lines", pa.int64()),
        ("n_repeat_words", pa.int64()),
        ("base_failed", pa.bool_()),
        ("language", pa.string()),
        ("chars", pa.list_(pa.float64())),
        ("words", pa.list_(pa.float64())),
        ("n_chars", pa.int64()),
        ("n_common", pa.int64()),
    ]
)
MEASURES = (
    "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "language string, chars array<double>, words array<double>, n_chars long, n_common long"
)

# The characters of the classes that are not told by Unicode's own properties.
_NAMED = {"space": " \t\r\x0b\x0c\u00a0", "line": "\n", "stop": ".,;:!?'\"()-", "symbol": "#*$%&|<>@=_/\\^~+{}[]"}
_tables: list[np.ndarray] = []


def class_table() -> np.ndarray:
    """Class of every code point; built once a worker."""
    if not _tables:
        table = np.full(0x110000, CLASSES.index("other"), dtype=np.uint8)
        for name, test in (("lower", str.islower), ("upper", str.isupper), ("digit", str.isdigit)):
            table[[i for i in range(0x20000) if test(chr(i))]] = CLASSES.index(name)
        for name, chars in _NAMED.items():
            table[[ord(c) for c in chars]] = CLASSES.index(name)
        _tables.append(table)
    return _tables[0]


def repeated_words(words: list) -> int:
    """Words in windows of three that the list has twice or more, the first included; each word counts once."""
    if len(words) < 4:
        return 0
    number: dict = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    size = len(number)
    if size < 2_000_000:  # three numbers fit 64 bits
        windows = (ids[:-2] * size + ids[1:-1]) * size + ids[2:]
    else:
        pairs = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)[1]
        windows = pairs[:-1] * size + ids[2:]
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    often = counts[inverse] > 1
    covered = np.zeros(len(words), dtype=bool)
    for k in range(3):
        covered[k : k + len(often)] |= often
    return int(covered.sum())


def measure(text: str) -> tuple:
    """The base counts and both histograms of a whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes are cut at exactly space and \x09-\x0d
    n = len(words)
    spaces = sum(raw.count(c) for c in (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c"))
    symbols = sum(raw.count(c.encode()) for c in SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x.split()]
    dup_lines = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeats > 50 * n
    counts = np.bincount(class_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")], minlength=len(CLASSES)).astype(float)
    seen: Counter = Counter()
    for w, k in Counter(text.lower().split()).items():
        seen[w.strip(".,;:!?")] += k
    best, found = "", np.zeros(_N_WORDS)
    for lang in LANGUAGES:
        hits = np.zeros(_N_WORDS)
        for w, i in _WORDS[lang].items():
            hits[i] = seen.get(w, 0)
        if hits.sum() > found.sum():
            best, found = lang, hits
    total, common = counts.sum(), found.sum()
    found[-1] = n - common
    return (
        n,
        len(text) - spaces,
        symbols,
        dup_lines,
        repeats,
        failed,
        best,
        (counts / total if total else counts).tolist(),
        (found / n if n else found).tolist(),
        int(total),
        int(common),
    )


def _measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(doc_id, *measure(text or "")) for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ARROW)], schema=_ARROW)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of `p` from the row of `q`, base 2."""
    m = (p + q) / 2

    def relative(a: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(a > 0, a * np.log2(a / m), 0).sum(axis=-1)

    return np.sqrt(np.clip((relative(p) + relative(q)) / 2, 0, 1))


def references(measured: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """Mean histograms of each language over all documents that pass the base rules: a few numbers a language."""
    good = measured.where("NOT base_failed AND language <> '' AND n_common > 0")
    means = lambda c, n: F.array(*[F.avg(F.col(c)[i]) for i in range(n)])
    rows = good.groupBy("language").agg(means("chars", len(CLASSES)).alias("chars"), means("words", _N_WORDS).alias("words")).collect()
    return {r["language"]: (list(r["chars"]), list(r["words"])) for r in rows}


def _verdicts(batches: Iterator[pa.RecordBatch], refs: dict, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        chars, words = (np.array(batch.column(c).to_pylist(), dtype=float) for c in ("chars", "words"))
        langs = np.array(batch.column("language").to_pylist(), dtype=object)
        char_d, word_d = np.zeros(len(langs)), np.zeros(len(langs))
        if refs and len(langs):
            names = list(refs)
            to_chars, to_words = (np.stack([js_distance(h, np.array(refs[k][i])) for k in names]) for i, h in ((0, chars), (1, words)))
            own = np.array([names.index(k) if k in refs else -1 for k in langs])
            own = np.where(own < 0, to_chars.argmin(axis=0), own)  # no common word at all: the nearest language
            char_d, word_d = to_chars[own, np.arange(len(own))], to_words[own, np.arange(len(own))]
        n_chars, n_words = (np.array(batch.column(c).to_pylist(), dtype=float) for c in ("n_chars", "n_words"))
        bound = lambda of, n: of[0] + of[1] / np.sqrt(np.maximum(n, 1))
        far = ((n_chars >= MIN_CHARS) & (char_d > bound(CHAR_BOUND, n_chars))) | ((n_words >= MIN_WORDS_SEEN) & (word_d > bound(WORD_BOUND, n_words)))
        kept = ~np.array(batch.column("base_failed").to_pylist(), dtype=bool) & ~far
        base = [batch.column(f.name) for f in list(schema)[:7]]
        yield pa.RecordBatch.from_arrays([*base, pa.array(kept), batch.column("language"), pa.array(char_d), pa.array(word_d)], schema=schema)


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    language, char_distance, word_distance.

    A missing or empty text has no words and so fails the base rules. A text without common words of any language is
    held against the language whose characters it is nearest to; with no reference at all, distances are 0 and the base rules decide. Repeated rows and missing ids are judged like any other;
    other columns are ignored; an empty table gives an empty result.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    measured = cut(own.mapInArrow(_measures, MEASURES))
    refs = references(measured)
    schema = pa.schema([*list(_ARROW)[:7], ("kept", pa.bool_()), ("language", pa.string()), ("char_distance", pa.float64()), ("word_distance", pa.float64())])
    shape = MEASURES.split(", language")[0] + ", kept boolean, language string, char_distance double, word_distance double"
    return measured.mapInArrow(lambda batches: _verdicts(batches, refs, schema), shape).withColumnRenamed("id", id_col)
