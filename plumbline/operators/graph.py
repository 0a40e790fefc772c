"""The column graph as two DataFrames, and what is asked of it.

nodes: key, namespace, table, column. edges: from_key, to_key, transformation, description. Keys are lower-case
`namespace.table.column`; display case lives in the nodes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.storage import cut

#: Level of edges whose far end is a seed itself.
NO_LEVEL = 999999


def node_key(namespace: Column, table: Column, column: Column) -> Column:
    return F.lower(F.concat_ws(".", namespace, table, column))


def nodes_of(edges: DataFrame) -> DataFrame:
    """Every key that an edge names, once."""
    return edges.select(F.explode(F.array("from_key", "to_key")).alias("key")).distinct()


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.dropDuplicates(["from_key", "to_key", "transformation", "description"])


def by_end(edges: DataFrame, end: str) -> DataFrame:
    """The edges, cut once into partitions by one end, so that joins on it move the other side only.

    Planned without AQE: a plan of its own forgets its partitions when it is cut, and each join would move the edges again.
    """
    conf = edges.sparkSession.conf
    adaptive = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut(edges.repartition(int(conf.get("spark.sql.shuffle.partitions")), end))
    finally:
        conf.set("spark.sql.adaptive.enabled", adaptive)


def distances(edges: DataFrame, seeds: DataFrame, max_depth: int = 0, upstream: bool = False) -> DataFrame:
    """(key, level) of all nodes reached from `seeds` (key), the seeds at level 0; max_depth 0: without limit."""
    near, far = ("to_key", "from_key") if upstream else ("from_key", "to_key")
    return _walk(by_end(edges.select(near, far), near), seeds, max_depth, near, far)[1]


def _walk(own: DataFrame, seeds: DataFrame, max_depth: int, near: str, far: str) -> tuple[DataFrame, DataFrame]:
    """The edges whose near ends are within reach, and (key, level) of the nodes reached. own: cut by its near end.

    Frontier by frontier: a level moves its frontier only, to the edges and to what was reached before. The frontier is what is
    hashed, so the edges stream past unsorted, once a level; those that it meets are kept, and looked for no more.
    """
    frontier = cut(seeds.select("key").distinct().withColumn("level", F.lit(0)))
    found, reached, depth = own.limit(0), frontier, 0
    while (max_depth == 0 or depth < max_depth) and not frontier.isEmpty():
        # cutting runs its last stage twice; after a shuffle that isn't the one that reads all edges
        met = cut(own.join(frontier.select(F.col("key").alias(near)).hint("shuffle_hash"), near).select(own.columns).repartition(far))
        found, depth = met if depth == 0 else found.unionByName(met), depth + 1
        frontier = cut(met.select(F.col(far).alias("key")).distinct().join(reached.select("key"), "key", "left_anti").withColumn("level", F.lit(depth)))
        reached = reached.unionByName(frontier)
    return found, reached


def impact(edges: DataFrame, seeds: DataFrame, direction: str = "downstream", max_depth: int = 0) -> DataFrame:
    """from_key, to_key, direction, transformation, description, level of every edge within reach of the seeds.

    An edge belongs to the result when its near end is closer than max_depth. Its level is that of its far end; edges that
    come back to a seed have NO_LEVEL. Parallel edges that differ in nothing else are one.
    """
    if direction == "both":
        return impact(edges, seeds, "upstream", max_depth).unionByName(impact(edges, seeds, "downstream", max_depth))
    return _reached(edges, seeds, direction, max_depth)[0]


def _reached(edges: DataFrame, seeds: DataFrame, direction: str, max_depth: int) -> tuple[DataFrame, DataFrame]:
    """The impact in one direction, and the levels of the nodes it reaches, from one cut of the edges; edges that repeat become one when they are few."""
    near, far = ("to_key", "from_key") if direction == "upstream" else ("from_key", "to_key")
    own = by_end(edges.select("from_key", "to_key", "transformation", "description"), near)
    inside, levels = _walk(own, seeds, max_depth, near, far)
    level = F.coalesce(F.when(F.col("level") > 0, F.col("level")), F.lit(NO_LEVEL))
    first = inside.join(levels.withColumnRenamed("key", far), far, "left").groupBy("from_key", "to_key", "transformation", "description").agg(F.min(level).cast("int").alias("level"))
    return first.select("from_key", "to_key", F.lit(direction).alias("direction"), "transformation", "description", "level"), levels


def traversal_stats(edges: DataFrame, seeds: DataFrame, table_of: Column) -> DataFrame:
    """One row: distinct edges and other tables on either side of the seeds. table_of: the table of the column `key`."""
    parts = []
    for side in ("upstream", "downstream"):
        found, levels = _reached(edges, seeds, side, 0)
        reached = levels.where("level > 0")
        n_edges = found.agg(F.count(F.lit(1)).alias(f"{side}_edges"))
        n_tables = reached.agg(F.count_distinct(table_of).alias(f"{side}_tables"), F.count_distinct("key").alias(f"{side}_columns"))
        parts.append(n_edges.join(n_tables, F.lit(True)))  # two rows of one
    return parts[0].join(parts[1], F.lit(True))


def waves(edges: DataFrame) -> DataFrame:
    """(key, wave): nodes in order of dependency, all that are ready at once in one wave.

    A node keeps the number of its sources that aren't done; a wave takes the edges of its nodes only. Where only cycles are
    left, the smallest key of each weakly connected rest goes next, so every node gets a wave and cycles cost no rounds of their own.
    """
    width = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = cut(edges.select("from_key", "to_key").repartition(width, "from_key").distinct())
    steps = own.where("from_key <> to_key")
    ends = own.select(F.explode(F.array(F.struct(F.col("from_key").alias("key"), F.lit(0).alias("n")), F.struct(F.col("to_key").alias("key"), (F.col("from_key") != F.col("to_key")).cast("int").alias("n")))).alias("e"))
    rest = cut(ends.groupBy("e.key").agg(F.sum("e.n").alias("open")))
    wave, done = 0, None
    ready = cut(rest.where("open <= 0").select("key"))
    rest = rest.where("open > 0")
    while True:
        if ready.isEmpty():
            if rest.isEmpty():
                return done if done is not None else rest.select("key", F.lit(0).alias("wave"))
            ready = cut(_smallest(rest, steps))
            rest = rest.join(ready, "key", "left_anti")
        found = ready.withColumn("wave", F.lit(wave))
        done = found if done is None else done.unionByName(found)
        less = steps.join(ready.select(F.col("key").alias("from_key")), "from_key").groupBy(F.col("to_key").alias("key")).agg(F.count(F.lit(1)).alias("less"))
        counted = cut(rest.join(less, "key", "left").select("key", (F.col("open") - F.coalesce("less", F.lit(0))).alias("open")))
        ready, rest = cut(counted.where("open <= 0").select("key")), counted.where("open > 0")
        wave += 1


def _smallest(rest: DataFrame, steps: DataFrame) -> DataFrame:
    """(key): of nodes (key) left in cycles, the smallest of each connected part, by spreading smallest labels and halving ways."""
    inner = steps.join(rest.select(F.col("key").alias("from_key")), "from_key", "left_semi").join(rest.select(F.col("key").alias("to_key")), "to_key", "left_semi")
    both = cut(inner.select(F.col("from_key").alias("a"), F.col("to_key").alias("b")).unionByName(inner.select(F.col("to_key").alias("a"), F.col("from_key").alias("b"))))
    labels = cut(rest.select("key", F.col("key").alias("label")))
    while True:
        near = both.join(labels.select(F.col("key").alias("b"), "label"), "b").groupBy(F.col("a").alias("key")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "key", "left").select("key", "label", F.least("label", "near").alias("low"))
        further = labels.select(F.col("key").alias("low"), F.col("label").alias("lowest"))  # the label of the label
        moved = cut(lower.join(further, "low", "left").select("key", F.least("low", "lowest").alias("label"), (F.least("low", "lowest") < F.col("label")).alias("moved")))
        labels = moved.select("key", "label")
        if moved.where("moved").isEmpty():
            return labels.where("key = label").select("key")


def degrees(edges: DataFrame) -> DataFrame:
    """(key, out_degree, in_degree) over distinct edges."""
    own = edges.select("from_key", "to_key").distinct()
    ends = own.select(F.col("from_key").alias("key"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(own.select(F.col("to_key").alias("key"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("key").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def colour_index(edges: DataFrame, colours: int) -> DataFrame:
    """Each outgoing edge's place among its source's, modulo the number of colours."""
    order = Window.partitionBy("from_key").orderBy("to_key", "transformation", "description")
    return edges.withColumn("colour", F.pmod(F.row_number().over(order) - 1, F.lit(colours)).cast("int"))


def resolve_temps(edges: DataFrame) -> DataFrame:
    """Edges whose source is a bare temp (`#t.col`) get it by its owner (`owner#t.col`) if a single owner has that temp."""
    named = edges.select(F.col("to_key").alias("full")).where("full LIKE '%_#%'").distinct()
    owners = named.withColumn("short", F.concat(F.lit("#"), F.substring_index("full", "#", -1)))
    single = owners.groupBy("short").agg(F.min("full").alias("full"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    return edges.join(single, edges["from_key"] == single["short"], "left").withColumn("from_key", F.coalesce("full", "from_key")).drop("short", "full")


def bypass_temps(edges: DataFrame, is_temp: Column) -> DataFrame:
    """The edges, and for every way through a temp one from what fills it to what reads it. is_temp: over the column `key`."""
    temp_keys = nodes_of(edges).where(is_temp)
    into = edges.join(temp_keys, edges["to_key"] == temp_keys["key"]).select(F.col("from_key").alias("a"), F.col("to_key").alias("t"))
    out = edges.join(temp_keys, edges["from_key"] == temp_keys["key"]).select(F.col("from_key").alias("t"), F.col("to_key").alias("b"), "transformation", "description")
    across = into.join(out, "t").where("a <> b").select(F.col("a").alias("from_key"), F.col("b").alias("to_key"), "transformation", "description")
    return edges.select("from_key", "to_key", "transformation", "description").unionByName(across).distinct()


def object_graph(dependencies: DataFrame) -> DataFrame:
    """Of (object, input) pairs, those between different objects that are both known."""
    known = dependencies.select(F.col("object").alias("input")).distinct()
    return dependencies.select("object", "input").distinct().where("object <> input").join(known, "input", "left_semi").select("object", "input")


def base_inputs(dependencies: DataFrame, is_temp) -> DataFrame:
    """(object, input) with temps replaced by what they come from, however deep; is_temp: a function from a column to whether it is one.

    A temp that nothing fills stays. Each round takes one step through temps, and goes on with pairs not met before.
    """
    own = cut(dependencies.select("object", "input").distinct())
    through = own.select(F.col("object").alias("t"), F.col("input").alias("source"))
    found = own.where(~is_temp(F.col("object")))
    ahead = cut(found)
    while True:
        more = ahead.where(is_temp(F.col("input"))).join(through, F.col("input") == F.col("t")).select("object", F.col("source").alias("input")).distinct()
        ahead = cut(more.join(found, ["object", "input"], "left_anti"))
        if ahead.isEmpty():
            break
        found = cut(found.unionByName(ahead))
    filled = own.select(F.col("object").alias("input")).distinct()
    return found.where(~is_temp(F.col("input"))).unionByName(found.where(is_temp(F.col("input"))).join(filled, "input", "left_anti").select("object", "input"))


def neighbourhood(edges: DataFrame, seed: str, table_of, max_depth: int = 0, direction: str = "both") -> DataFrame:
    """(table, level) around a table, by edges between tables. table_of: a function from a key column to its table."""
    flat = edges.select(table_of(F.col("from_key")).alias("from_key"), table_of(F.col("to_key")).alias("to_key")).where("from_key <> to_key").distinct()
    seeds = edges.sparkSession.range(1).select(F.lit(seed).alias("key"))
    sides = {"both": (True, False), "upstream": (True,), "downstream": (False,)}[direction]
    found = None
    for side in sides:
        one = distances(flat, seeds, max_depth, side)
        found = one if found is None else found.unionByName(one)
    return found.groupBy(F.col("key").alias("table")).agg(F.min("level").alias("level"))


# selectors


@dataclass(frozen=True)
class Selector:
    """What a selector text asks for; error is set where it can't be read."""

    pattern: str
    direction: str = "downstream"
    error: str | None = None


def parse_selector(text: str) -> Selector:
    """`+x` is upstream, `x+` downstream, `+x+` both, `x` downstream.

    x: `table.column`, `schema.table.column`, `database.schema.table.column`, the URI of a column, `table` forms of two or three
    parts with `.*`, `prefix..text`, or `.text` for `..text`.
    """
    raw = (text or "").strip()
    up, down = raw.startswith("+"), raw.endswith("+") and len(raw) > 1
    pattern = raw[up : len(raw) - down].strip()
    if not pattern or pattern in (".", ".."):
        return Selector("", error=f"empty selector: {text!r}")
    if pattern.startswith(".") and not pattern.startswith(".."):
        pattern = f".{pattern}"
    parts = [p for p in pattern.split(".") if p]
    if "://" not in pattern and ".." not in pattern:
        if pattern.endswith(".*") and len(parts) not in (3, 4):
            return Selector("", error=f"unsupported wildcard selector: {text!r}; give schema.table.* or database.schema.table.*")
        if not pattern.endswith(".*") and len(parts) not in (2, 3, 4):
            return Selector("", error=f"unsupported selector: {text!r}; give table.column, schema.table.column, database.schema.table.column, schema.table.*, ..text or a URI")
    return Selector(pattern, "both" if up and down else "upstream" if up else "downstream")


def glob(pattern: str) -> str:
    """A glob as a regular expression over a whole value."""
    made = {"*": ".*", "?": "."}
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + 1) if c == "[" else -1
        if close > 0:
            inner = pattern[i + 1 : close]
            out += "[" + ("^" + inner[1:] if inner.startswith("!") else inner) + "]"
            i = close
        else:
            out += made.get(c) or re.escape(c)
        i += 1
    return rf"(?s)\A{out}\z"


def matches(pattern: str, namespace: Column, table: Column, column: Column, database: str | None = None) -> Column:
    """Whether a node is meant by a selector's pattern, case aside.

    `table.*`: all columns of the tables whose name ends in those parts; `prefix..text`: columns that contain the text (or
    fit it as a glob), of tables that start with the prefix, or of a namespace if it is a URI; with `*`, `?` or `[` in it: keys that
    fit as a whole; a URI: that key; two parts: the column of that table of schema dbo; three: of that schema; four: of that
    database. database: the one meant where the pattern names none; None: any.
    """
    low = pattern.lower()
    space, name, col = F.lower(namespace), F.lower(table), F.lower(column)
    fits = lambda value, text: value.rlike(glob(text)) if re.search(r"[*?\[\]]", text) else value.contains(text)
    scheme = re.match(r"([a-z]+://[^.]*)\.?(.*)", low)
    prefix, rest = (scheme[1], scheme[2]) if scheme else ("", low)
    in_space = space.startswith(prefix) if prefix else F.lit(True)
    own = F.split(name, r"\.")
    ends = lambda parts: F.slice(own, F.greatest(F.size(own) - len(parts) + 1, F.lit(1)), F.lit(len(parts))) == F.array(*map(F.lit, parts))
    if ".." in low:
        before, _, text = ("." + rest if scheme and rest.startswith(".") else rest).partition("..")
        if not text.strip():
            return F.lit(False)
        before = before.strip(".")
        return in_space & (name.startswith(before) if before else F.lit(True)) & fits(col, text.strip())
    if low.endswith(".*"):
        parts = [p for p in rest[:-2].split(".") if p]
        if not parts:
            return F.lit(False)
        # of a name without its database, the last two parts count
        return in_space & (ends(parts[-3:]) | ((F.size(own) < 3) & ends(parts[-2:])) if len(parts) >= 3 else ends(parts))
    if scheme:
        return F.concat_ws(".", space, name, col) == low
    if re.search(r"[*?\[\]]", low):
        return F.concat_ws(".", space, name, col).rlike(glob(low))
    parts = [p for p in low.split(".") if p]
    told = ["dbo", *parts[:-1]] if len(parts) == 2 else parts[:-1]
    if len(told) == 2 and database:
        named = ends([database.lower(), *told]) | ((F.size(own) < 3) & ends(told) & (F.substring_index(space, "/", -1).isin(database.lower(), "")))
    elif len(told) == 3:
        named = ends(told) | ((F.size(own) < 3) & ends(told[1:]) & (F.substring_index(space, "/", -1) == told[0]))
    else:
        named = ends(told)
    return named & (col == parts[-1])
