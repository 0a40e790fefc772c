"""Near duplicates by SuperMinHash.

Every shingle of a document draws a random permutation of the signature's places, and a random fraction for each rank;
a place keeps the smallest rank plus fraction that any shingle brings to it. Ranks of one shingle are correlated, as each
is used once, which lowers the estimate's variance below MinHash's. Rank by rank over all shingles at once, a document
is finished when no later rank can lower any place, which for long texts is after one or two.

Documents with equal shingle sets become one class first. Bands of the classes' signatures give buckets. Of a bucket, each
member meets the smallest, and pairs that estimates don't rule out are confirmed on full sets. What is left are buckets of
three or more that still hold several components. Their members are searched by an exact set join: only shingles that
occur in two components can be part of a link, so a class of which they are less than three quarters has none; the
others, by connected groups of buckets, meet in blocks of a bounded number of shingles, and a block gives a forest of its
links, never its pairs. Members of a group's main component meet only those outside it, so a group of n near copies costs
n, and texts that share no more than a common passage drop out by counting. Links become components by union-find within
partitions and by contraction between them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut, slices, written

WORDS, PERCENT = 5, 75
#: 24 bands of 4 places: a pair of similarity 0.75 shares none with probability 1e-4, one of 0.8 with 4e-6.
BANDS, ROWS = 24, 4
PLACES = BANDS * ROWS
#: Pairs whose signatures agree on a smaller share of places aren't confirmed: 8 deviations below 0.75, so chance is no matter.
LEAST_ESTIMATE = 0.40
#: Shingles of one batch of documents.
BATCH_SHINGLES = 150_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

#: Classes whose texts may be found by a broadcast of their ids; more are joined by a shuffle.
FEW_CLASSES = 50_000
#: Members that meet one representative in one group of rows; a larger bucket's are dealt out, with a copy of it for each.
MEMBERS = 500
#: Shingles of one side of a block of the exact set join; a class longer than that is a side of its own.
BLOCK_SHINGLES = 1 << 18

_ARROW = pa.schema(
    [("id", pa.int64()), ("row_no", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64())), ("signature", pa.binary())]
)
_SIGNED = "id long, row_no long, text_key long, n_shingles long, set_key binary, bands array<long>, signature binary"


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles; of fewer words, the whole sequence is one; of none, no set."""
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    if len(tokens) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(tokens))], dtype=np.uint64)
    # a shingle's number is mixed from its words' hashes, each of which is taken once a text
    known = {w: xxhash.xxh3_64_intdigest(w) for w in set(tokens)}
    hashes = np.fromiter(map(known.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    n = len(tokens) - words + 1
    mixed = np.zeros(n, dtype=np.uint64)
    for k in range(words):
        mixed = _mix(mixed + hashes[k : k + n] + np.uint64(0x9E3779B97F4A7C15 + k))
    return np.unique(mixed)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finisher of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def super_minhash(sets: list[np.ndarray], places: int = PLACES) -> np.ndarray:
    """Signatures (documents, places) of non-empty sets."""
    n_docs = len(sets)
    best = np.full(n_docs * places, np.inf)
    state = np.concatenate(sets)
    owner = np.repeat(np.arange(n_docs), [len(s) for s in sets])
    order = None  # each shingle's permutation so far; only made for the shingles that get beyond the first rank
    for rank in range(places):
        state = _mix(state + np.uint64(0x9E3779B97F4A7C15))
        other = rank + ((state >> np.uint64(32)) * np.uint64(places - rank) >> np.uint64(32)).astype(np.int64)
        fraction = (state & np.uint64(0xFFFFFFFF)).astype(float) / 2**32
        if rank == 0:
            place = other
        else:
            if order is None:
                order = np.broadcast_to(np.arange(places, dtype=np.uint8), (len(state), places)).copy()
                first = np.arange(len(state))
                order[first, 0], order[first, earlier] = earlier, 0
            at = np.arange(len(state))
            place = order[at, other].astype(np.int64)
            order[at, other] = order[at, rank]
        np.minimum.at(best, owner * places + place, rank + fraction)
        # a document goes on while some place holds more than the next rank can bring
        going = best.reshape(n_docs, places).max(axis=1) > rank + 1
        if not going.any():
            break
        on = going[owner]
        if rank == 0:
            earlier = place[on]
        elif order is not None and not on.all():
            order = order[on]
        if not on.all():
            state, owner = state[on], owner[on]
    return best.reshape(n_docs, places)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    sets: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        full = [s for s in sets if len(s)]
        bands, codes = [], []
        if full:
            values = super_minhash(full).astype(np.float32).view(np.uint32).astype(np.uint64)
            grouped = values.reshape(len(full), BANDS, ROWS)
            mixed = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(full), BANDS))
            for k in range(ROWS):
                mixed = _mix(mixed * np.uint64(31) + grouped[:, :, k] + np.uint64(k + 1))
            bands, codes = mixed.view(np.int64).tolist(), (_mix(values) & np.uint64(0xFF)).astype(np.uint8)
        made = iter(range(len(full)))
        columns: list[list] = [[] for _ in _ARROW]
        for (ident, row_no, text_key), s in zip(rows, sets, strict=True):
            k = next(made) if len(s) else None
            key = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
            for c, v in zip(columns, (ident, row_no, text_key, len(s), key, None if k is None else bands[k], None if k is None else codes[k].tobytes()), strict=True):
                c.append(v)
        rows.clear()
        sets.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)

    size = 0
    for batch in slices(batches):
        for ident, row_no, text_key, text in zip(*(batch.column(c).to_pylist() for c in ("id", "row_no", "text_key", "text")), strict=True):
            rows.append((ident, row_no, text_key))
            sets.append(shingle_set(text))
            size += len(sets[-1])
            if size >= BATCH_SHINGLES:
                yield flush()
                size = 0
    if rows:
        yield flush()


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with both signatures, those whose estimate is high enough."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, PLACES) for c in ("sig_a", "sig_b"))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array((x == y).mean(axis=1) >= LEAST_ESTIMATE))


def _sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sets = [shingle_set(t).view(np.int64) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array([len(x) for x in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["cls", "n", "shingles"])


def _linked(both: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles that share `both` are linked."""
    return 100 * both >= PERCENT * (n + m - both)


def _against_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of rows (a, part, cls, n, shingles), sorted so that the representative a comes before the members it meets."""
    first, known = None, np.zeros(0, dtype=np.int64)
    for batch in batches:
        values, ends = batch.column("shingles").values.to_numpy(), batch.column("shingles").offsets.to_numpy()
        kept: list[tuple[int, int]] = []
        for k, (a, part, cls) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "part", "cls")), strict=True)):
            own = values[ends[k] : ends[k + 1]]
            if (a, part) != first:
                first, known = (a, part), np.sort(own)
            elif len(known) and len(own):
                found = known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own
                if _linked(found.sum(), len(known), len(own)):
                    kept.append((a, cls))
        a, b = zip(*kept, strict=True) if kept else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) between components, from rows (team, s, t, outer, cls, root, n, shingles) sorted by block (team, s, t)."""
    block, rest = None, []
    for batch in batches:
        marks = list(zip(*(batch.column(c).to_pylist() for c in ("team", "s", "t")), strict=True))
        bounds = [0, *(k for k in range(1, len(marks)) if marks[k] != marks[k - 1]), len(marks)] if marks else [0]
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            if marks[lo] != block and rest:
                yield _join_block(rest)
                rest = []
            block = marks[lo]
            rest.append(batch.slice(lo, hi - lo))
    if rest:
        yield _join_block(rest)


def _join_block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Every outer row against every inner one by an index of the inner rows' shingles; a forest of the links between roots."""
    table = pa.Table.from_batches(parts).combine_chunks()
    column = lambda c: table.column(c).to_numpy()
    outer, root, n = column("outer"), column("root"), column("n")
    sets = table.column("shingles").chunk(0)
    values, ends = sets.values.to_numpy(), sets.offsets.to_numpy()
    lengths = np.diff(ends)
    inner = np.flatnonzero(~outer)
    holders = np.repeat(np.arange(len(inner)), lengths[inner])
    held = np.concatenate([values[ends[k] : ends[k + 1]] for k in inner]) if len(inner) else values[:0]
    order = np.argsort(held, kind="stable")
    held, holders = held[order], holders[order]
    up: dict[int, int] = {}
    links = []
    for k in np.flatnonzero(outer):
        own = values[ends[k] : ends[k + 1]]
        lo, hi = np.searchsorted(held, own, "left"), np.searchsorted(held, own, "right")
        sizes = hi - lo
        at = np.repeat(lo - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
        both = np.bincount(holders[at], minlength=len(inner))
        hits = inner[_linked(both, n[k], n[inner]) & (root[inner] != root[k])]
        for other in set(root[hits].tolist()):
            a, b = _root(up, int(root[k])), _root(up, other)
            if a != b:
                up[max(a, b)] = min(a, b)
                links.append((min(a, b), max(a, b)))
    a, b = zip(*links, strict=True) if links else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _root(up: dict[int, int], x: int) -> int:
    while (y := up.get(x, x)) != x:
        up[x] = x = up.get(y, y)
    return x


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over a partition's links: each node that isn't the smallest of its set, with the smallest."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    def forest() -> pa.RecordBatch:
        nodes = [x for x in parent if find(x) != x]
        out = pa.RecordBatch.from_arrays([pa.array([find(x) for x in nodes], pa.int64()), pa.array(nodes, pa.int64())], names=["a", "b"])
        parent.clear()
        return out

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
                parent.setdefault(min(x, y), min(x, y))
        if len(parent) > 1_000_000:
            yield forest()
    if parent:
        yield forest()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of `links` (a, b; a < b) that isn't the smallest node of its component: the root.

    Each partition's links are reduced by union-find; then each node with a smaller neighbour hangs itself on the smallest,
    chains are shortened, and links between what is left of the nodes are taken on, until there are none. Minima are
    combined before they are shuffled, so a node of any number of links is as good as another.
    """
    edges = written(links.mapInArrow(_local_forest, "a long, b long").distinct())
    labels = None
    while not edges.isEmpty():
        up = written(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")))
        while True:  # a chain's length halves each time
            above = up.select(F.col("node").alias("at"), F.col("root").alias("higher"))
            longer = written(up.join(above, up["root"] == above["at"], "left").select("node", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")))
            up = longer.select("node", "root")
            if longer.where("moved").isEmpty():
                break
        if labels is None:
            labels = up
        else:
            step = up.select(F.col("node").alias("at"), F.col("root").alias("higher"))
            moved = labels.join(step, labels["root"] == step["at"], "left").select("node", F.coalesce("higher", "root").alias("root"))
            labels = written(moved.unionByName(up))
        at_a, at_b = (up.select(F.col("node").alias(f"n{x}"), F.col("root").alias(f"r{x}")) for x in "ab")
        lifted = edges.join(at_a, edges["a"] == at_a["na"], "left").join(at_b, edges["b"] == at_b["nb"], "left")
        lifted = lifted.select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y")).where("x <> y")
        edges = written(lifted.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")) if labels is None else labels


def _sets(wanted: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(cls, n, shingles) of the wanted classes (cls). Texts are read again for those only."""
    wanted = written(classes.select("cls", F.col("cls_id").alias("w_id"), F.col("text_key").alias("w_key")).join(wanted, "cls", "left_semi"))
    n = wanted.count()
    wanted = F.broadcast(wanted) if n <= FEW_CLASSES else wanted
    texts = docs.join(wanted, docs["id"].eqNullSafe(wanted["w_id"]) & (docs["text_key"] == wanted["w_key"]), "inner").select("cls", "text")
    sets = written(texts.mapInArrow(_sets_of, "cls long, n long, shingles array<long>"))
    return sets if sets.count() == n else written(sets.dropDuplicates(["cls"]))  # rows that repeat id and text bring more


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (a, b) of classes, those whose full sets are similar enough.

    A pair costs its second set: the first is sent once to each group of MEMBERS of the classes that meet it.
    """
    parts = pairs.groupBy(F.col("a").alias("p_a")).agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("parts"))
    dealt = pairs.join(parts, F.col("a") == F.col("p_a")).select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    asked = dealt.select("a", "part", F.lit(1).alias("nth"), F.col("b").alias("who")).unionByName(dealt.select("a", "part", F.lit(0).alias("nth"), F.col("a").alias("who")).distinct())
    rows = asked.join(sets, asked["who"] == sets["cls"]).select("a", "part", "nth", "cls", "shingles")
    return written(rows.repartition("a", "part").sortWithinPartitions("a", "part", "nth").mapInArrow(_against_first, "a long, b long"))


def _open(buckets: DataFrame, least: int) -> DataFrame:
    """Keys of the buckets (key, cls, root) that have `least` members or more and several components, with the smallest member."""
    grouped = buckets.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("cls").alias("first"), F.count(F.lit(1)).alias("members"))
    return grouped.where((F.col("members") >= least) & (F.col("lo") < F.col("hi"))).select(F.col("key").alias("o_key"), "first")


def _searched(buckets: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between components (roots) of classes that meet in a bucket (key, cls, root), all there are, as a forest.

    Buckets of two have been decided when their members met. A link's shingles are all in two components, so only those count.
    """
    open_keys = _open(buckets, 3)
    members = buckets.join(open_keys, buckets["key"] == open_keys["o_key"], "left_semi").select("cls", "root").distinct()
    found = sets.join(members.withColumnRenamed("cls", "m_cls"), F.col("cls") == F.col("m_cls")).select("cls", "root", "n", F.explode("shingles").alias("shingle"))
    shared = found.groupBy(F.col("shingle").alias("s")).agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("s")
    left = found.join(shared, F.col("shingle") == F.col("s"), "left_semi").groupBy("cls", "root", "n").agg(F.collect_list("shingle").alias("shingles"))
    left = written(left.where(F.size("shingles") * 100 >= F.col("n") * PERCENT))
    # groups of what is left, by the buckets in which it still meets
    inside = written(buckets.join(left.select(F.col("cls").alias("l_cls")), F.col("cls") == F.col("l_cls"), "left_semi"))
    met = _open(inside, 2)
    stars = inside.join(met, inside["key"] == met["o_key"]).select(F.col("first").alias("a"), F.col("cls").alias("b"))
    teams = written(components(stars.where("a < b")))
    named = teams.select(F.col("node").alias("t_cls"), F.col("root").alias("team")).unionByName(teams.select(F.col("root").alias("t_cls"), F.col("root").alias("team")).distinct())
    rows = left.join(named, F.col("cls") == F.col("t_cls")).select("team", "cls", "root", "n", "shingles")
    # outside a team's main component a class meets all of the team, within it only those outside
    of_root = rows.groupBy("team", "root").agg(F.count(F.lit(1)).alias("members"), F.sum(F.size("shingles")).alias("weight"))
    main = of_root.groupBy("team").agg(F.max(F.struct("members", "root")).alias("top"), F.sum("weight").alias("all"), F.count(F.lit(1)).alias("roots"))
    outside = of_root.join(main.select(F.col("team").alias("m_team"), F.col("top.root").alias("m_root")), (F.col("team") == F.col("m_team")) & (F.col("root") != F.col("m_root")))
    weights = outside.groupBy(F.col("team").alias("w_team")).agg(F.sum("weight").alias("outer_weight"))
    blocks = lambda w: F.greatest(F.ceil(F.col(w) / BLOCK_SHINGLES), F.lit(1)).cast("int")
    shape = main.join(weights, F.col("team") == F.col("w_team")).where("roots > 1").select(F.col("team").alias("n_team"), F.col("top.root").alias("main"), blocks("outer_weight").alias("outers"), blocks("all").alias("inners"))
    shape = written(shape)
    shape = F.broadcast(shape) if shape.count() <= FEW_CLASSES else shape  # so that a large team's rows stay where they are
    placed = rows.join(shape, F.col("team") == F.col("n_team"))
    at = lambda parts: F.pmod(F.xxhash64("cls"), F.col(parts)).cast("int")
    upto = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    outer = placed.where("root <> main").select("team", at("outers").alias("s"), upto("inners").alias("t"), F.lit(True).alias("outer"), "cls", "root", "n", "shingles")
    inner = placed.select("team", upto("outers").alias("s"), at("inners").alias("t"), F.lit(False).alias("outer"), "cls", "root", "n", "shingles")
    blocked = outer.unionByName(inner).repartition("team", "s", "t").sortWithinPartitions("team", "s", "t")
    return written(blocked.mapInArrow(_block_links, "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id_col, n_shingles, component_id, kept.

    Two documents are linked when 100 times the intersection of their shingle sets is 75 times their union or more.
    component_id is the smallest id of a document's component. A missing text is an empty one; without words a document
    has no set and no links. A missing id is larger than any other. Rows that repeat an id and a text are one another's
    copies; kept says id = component_id, so it holds for all rows with that id. Other columns are ignored.
    """
    return _grouped(docs, id_col, text_col).select(F.col("id").alias(id_col), "n_shingles", "component_id", "kept")


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text_key, n_shingles, component_id, kept: near_duplicates with the hash of the text that each row has."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
    meta = cut(own.withColumn("row_no", F.monotonically_increasing_id()).mapInArrow(_signed, _SIGNED))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row_no", "text_key", "bands", "signature")).alias("first")
    grouped = meta.where("set_key IS NOT NULL").groupBy("set_key").agg(first)
    classes = cut(grouped.select("set_key", F.col("first.row_no").alias("cls"), F.col("first.id").alias("cls_id"), "first.text_key", "first.bands", "first.signature"))
    buckets = classes.select("cls", F.posexplode("bands").alias("band", "value")).select("cls", F.xxhash64("band", "value").alias("key"))
    # each member meets the smallest of its bucket
    firsts = buckets.groupBy(F.col("key").alias("f_key")).agg(F.min("cls").alias("first"), F.count(F.lit(1)).alias("members")).where("members > 1").select("f_key", "first")
    shared = written(buckets.join(firsts, buckets["key"] == firsts["f_key"]).select("key", "cls", "first"))
    met = shared.where("first < cls").select(F.col("first").alias("a"), F.col("cls").alias("b")).distinct()
    sig_a, sig_b = (classes.select(F.col("cls").alias(f"k{x}"), F.col("signature").alias(f"sig_{x}")) for x in "ab")
    signed = met.join(sig_a, met["a"] == sig_a["ka"]).select("a", "b", "sig_a")
    signed = signed.join(sig_b, signed["b"] == sig_b["kb"]).select("a", "b", "sig_a", "sig_b")
    tried = written(signed.mapInArrow(_alike, "a long, b long"))
    sets = _sets(shared.select("cls").distinct(), classes, own)
    links = _confirm(tried, sets)
    roots = written(components(links))
    rooted = written(shared.join(roots, shared["cls"] == roots["node"], "left").select("key", "cls", F.coalesce("root", "cls").alias("root")))
    more = _searched(rooted, sets)
    if not more.isEmpty():
        roots = written(components(links.unionByName(more)))
    # the smallest id of each component, and so of each class that isn't alone
    of_class = classes.join(roots, classes["cls"] == roots["node"], "left").select("set_key", "cls_id", F.coalesce("root", "cls").alias("root"))
    least = of_class.groupBy("root").agg(F.min("cls_id").alias("component_id")).withColumnRenamed("root", "r")
    named = written(of_class.join(least, F.col("root") == F.col("r")).select(F.col("set_key").alias("c_key"), "component_id"))
    out = meta.select("id", "text_key", "n_shingles", "set_key").join(named, F.col("set_key") == F.col("c_key"), "left")
    component = F.when(F.col("set_key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select("id", "text_key", "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one document of each component, that of the smallest id; all columns are kept.

    A row is known by its id, which may be missing, and its text: of rows that share an id, only near copies go. As in
    near_duplicates, rows of a component that share its smallest id all stay.
    """
    gone = _grouped(docs, id_col, text_col).where("NOT kept").select(F.col("id").alias("_gone"), F.col("text_key").alias("_gone_text"))
    return docs.join(gone.distinct(), F.col(id_col).cast("long").eqNullSafe(F.col("_gone")) & (F.xxhash64(text_col) == F.col("_gone_text")), "left_anti")
