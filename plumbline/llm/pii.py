"""Personal data replaced by surrogates, in DataFrame functions only.

One pattern finds the entities of a text; the pieces between them stay as they are. Each entity gets a replacement drawn
from a keyed hash of its type and normalised value, so the same value gets the same replacement everywhere (coreference),
written in the entity's own format: digits for digits, letters of the same case and script for letters, a name of the
same gender behind the same title. Replacements are checked over the corpus: a value whose replacement is taken by
another value, or is itself a value that occurs, draws again with a further salt; those left after ROUNDS get places that
are free, until none is left. Where a format has fewer places than that takes, the run fails.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from functools import reduce
from hashlib import sha256
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import cut, written

#: The key where none is given; whoever knows the key and guesses a value can confirm the guess, so give your own:
#: as an argument, or for the queries and the pipeline in the setting KEY_SETTING.
KEY = "plumbline-surrogates"
KEY_SETTING = "spark.plumbline.surrogates.key"
_key: ContextVar[str] = ContextVar("key", default=KEY)
#: Rounds of drawing again; salts above are places (salt - ROUNDS - 1) in the list of all replacements of a format.
ROUNDS = 6
#: Places that one row lists at a time.
BLOCK = 1 << 16
#: Values drawn again that may be written into the plan; more are joined to their texts.
FEW_SALTS = 500

# What a name is made of: capitalised words (hyphens and apostrophes inside, a genitive's 's outside), initials and particles.
# Words that begin sentences, after a first name word, are none of it.
_GAP = r"[ \u00A0]{1,3}"
_WORD = r"\p{Lu}[\p{L}\p{M}]{0,30}+(?:[-'’](?!s\b)\p{L}[\p{L}\p{M}]{0,30}+){0,3}"
_BEFORE = rf"(?:(?:\p{{Lu}}\.(?:-?\p{{Lu}}\.){{0,3}}|(?:van|von|vom|der|den|de|del|della|di|da|dos|das|du|la|le|ten|ter|zu|zum|zur|bin|ibn|al|el|af|av|y)\b|[dDlL]['’](?=\p{{Lu}}))(?:{_GAP}|(?<=['’.])(?=\p{{Lu}}))){{0,4}}+"
_OTHER = r"(?!(?:I|A|An|The|He|She|It|We|You|They|His|Her|Their|Our|My|This|That|These|Those|There|In|On|At|But|And|Or|When|While|As|If|Is|Was|Who|What|Has|Had|Will|Said|Mrs|Ms|Mr|Mme|Mlle|Frau|Herr|Sra|Srta|Sr|Dr|Er|Sie|Der|Die|Das|Und|Le|La|El|Y)\b)"
_NAME = rf"{_BEFORE}{_WORD}(?:{_GAP}{_OTHER}{_BEFORE}{_OTHER}{_WORD}){{0,5}}"
#: The title of a name, and the words of one that are replaced: each a value of its own, so mentions by any of them corefer.
_TITLE = r"\A\p{Lu}\p{Ll}+\.?[ \u00A0]{1,3}"
_PART = rf"(?<![\p{{L}}\p{{M}}\p{{N}}]){_WORD}"

# The patterns of the entity types, in order of precedence. A match may not continue a word or number.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9][A-Za-z0-9\-]{0,62}(?:\.[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?){1,8}",
    "secret": r"(?i:\b(?:password|passwd|pwd|token|secret|api[_-]?key)\b\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9+/_\-]{12,}={0,2}[\"']?)",
    "access_key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"(?<![\d.])(?:\d{4}[ \-]?){3}\d{1,7}(?![\d])",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "phone": r"(?<![\w+])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .\-]?\d{2,4}){2,4}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}[.\-]\d{4}(?!\d)|(?<![\w.\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\w\-])",
    "name_f": rf"\b(?:Mrs|Ms|Mme|Mlle|Frau|Sra|Srta)\b\.?{_GAP}{_NAME}",
    "name_m": rf"\b(?:Mr|Herr|Sr)\b\.?{_GAP}{_NAME}",
}
# What surrogate names are made of, by gender.
_NAMES = {
    "name_f": "Adler Amsel Ahorn Birke Blume Distel Eiche Elster Erle Falter Fichte Flieder Ginster Hasel Heide Iris Kiefer Lerche Lilie Linde Malve Meise Mohn Nelke Quelle Rose Schwalbe Taube Tulpe Viola Weide Wiese".split(),
    "name_m": "Anker Bach Berg Brunner Damm Dorn Falk Fels Forst Graben Hafen Hagen Hirsch Hof Kamm Kern Lauf Moor Nord Ort Pfeil Rabe Regen Sander Stein Strand Sturm Talbach Turm Wald Winkel Zander".split(),
}
ALL = "|".join(f"(?:{p})" for p in PATTERNS.values())

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HEX = "0123456789abcdef"
_SCRIPTS = (("Cyrillic", "абвгдежзиклмнопрстуфхцчшэюя"), ("Greek", "αβγδεζηθικλμνξοπρστυφχψω"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value being computed once however often it is used, also within a lambda."""
    return F.transform(F.array(value), use)[0]


def kind_of(entity: Column) -> Column:
    """The first type whose pattern the entity is as a whole."""
    found = F.lit("phone")
    for name, pattern in reversed(PATTERNS.items()):
        found = F.when(entity.rlike(rf"\A(?:{pattern})\z"), name).otherwise(found)
    return found


def normal_form(kind: Column, entity: Column) -> Column:
    """What coreferring mentions have in common: letters and digits of numbers, e-mail addresses in small letters."""
    bare = F.regexp_replace(entity, r"[^\p{L}\p{N}]", "")
    return F.when(kind.isin("email"), F.lower(entity)).when(kind.isin("ip", "secret"), entity).when(kind.startswith("name"), entity).otherwise(bare)


def parts_of(entity: Column) -> Column:
    """The words of a name that are replaced."""
    return F.regexp_extract_all(F.regexp_replace(entity, _TITLE, ""), F.lit(_PART), F.lit(0))


def values_of(kind: Column, entity: Column) -> Column:
    """(value, shape) of what is replaced in an entity: each word of a name but initials, or the entity as a whole."""
    return F.when(kind.startswith("name"), F.transform(F.filter(parts_of(entity), lambda p: F.char_length(p) > 1), lambda p: F.struct(p.alias("value"), p.alias("shape")))).otherwise(
        F.array(F.struct(normal_form(kind, entity).alias("value"), entity.alias("shape")))
    )


def _words_given(text: Column, given: Callable[[Column], Column]) -> Column:
    """`text` with each of its name words replaced by given(word), the pieces between them kept."""
    found = F.regexp_extract_all(text, F.lit(_PART), F.lit(0))
    pieces = F.split(text, _PART, -1)
    return let(pieces, lambda p: F.concat(F.array_join(F.flatten(F.zip_with(F.slice(p, 1, F.size(p) - 1), found, lambda x, w: F.array(x, given(w)))), ""), F.element_at(p, -1)))


def _digest(kind: Column, value: Column, salt: Column, block: Column) -> Column:
    """64 hex digits of a keyed hash; block: a number, for longer entities."""
    return hmac(F.concat_ws("\u0001", kind, value, salt.cast("string"), block.cast("string")))


def hmac(message: Column) -> Column:
    """HMAC-SHA-256 of a string under the key, as hex digits."""
    key = _key.get().encode()
    key = (sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(x ^ pad for x in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def _drawn(kind: Column, value: Column, salt: Column, length: Column) -> Column:
    """An array of `length` numbers from 0 to 255, the same for the same value."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(length - 1, F.lit(0)) / 32).cast("int")), lambda b: _digest(kind, value, salt, b))
    return let(F.array_join(blocks, ""), lambda hexes: F.transform(F.sequence(F.lit(1), F.greatest(length, F.lit(1))), lambda i: F.conv(F.substring(hexes, 2 * i - 1, F.lit(2)), 16, 10).cast("int")))


def _like(text: Column, draws: Column) -> Column:
    """`text` with each digit and letter replaced by a drawn one of its kind; other characters stay."""
    return F.array_join(F.transform(F.split(text, ""), lambda c, i: _alike(c, F.element_at(draws, i + 1))), "")


def surrogate(kind: Column, entity: Column, value: Column, salt: Column) -> Column:
    """The replacement of an entity, in its own format."""
    drawn = F.when(salt > ROUNDS, _placed(radices(kind, entity, value), salt)).otherwise(_drawn(kind, value, salt, F.greatest(F.char_length(entity), F.lit(32))))
    return let(drawn, lambda draws: _written(kind, entity, value, salt, draws))


def _secret_parts(entity: Column) -> tuple[Column, Column, Column]:
    head = F.regexp_extract(entity, r"\A(?i:[a-z_\-]+\s*[=:]\s*[\"']?)", 0)
    tail = F.regexp_extract(entity, r"=*[\"']?\z", 0)
    return head, F.substring(entity, F.char_length(head) + 1, F.char_length(entity) - F.char_length(head) - F.char_length(tail)), tail


def _kept(kind: Column, entity: Column) -> Column:
    """A phone keeps its country code, a key and an account their first four characters, so that format and origin stay plain."""
    country = F.char_length(F.regexp_extract(entity, r"\A\+\d{1,3}", 0))
    return F.when(kind == "phone", country).when(kind.isin("access_key", "iban"), 4).otherwise(0)


def _is_latin(value: Column) -> Column:
    return value.rlike(r"\A[\p{IsLatin}\p{M}'’\-]+\z")


def radices(kind: Column, entity: Column, value: Column) -> Column:
    """How many different results each draw of a replacement can have, in order; their product is the room there is."""
    of = lambda text: F.transform(F.split(text, ""), _choices)
    fixed = lambda *n: F.array(*[F.lit(x).cast("long") for x in n])
    body = _secret_parts(entity)[1]
    hexed = F.array_repeat(F.lit(16).cast("long"), F.char_length(body))
    kept = F.char_length(F.regexp_replace(F.substring(entity, F.lit(1), _kept(kind, entity)), r"[^\p{L}\p{N}]", ""))
    return (
        F.when(kind == "email", fixed(1 << 56))
        .when(kind == "ip", fixed(256, 256, 256))
        .when(kind == "secret", F.when(body.rlike(r"\A[0-9a-f]+\z"), hexed).otherwise(of(body)))
        .when(kind.startswith("name") & _is_latin(value), fixed(4, 256, 26, 26, 26, 26))
        .when(kind.startswith("name"), of(value))
        .otherwise(F.transform(of(value), lambda n, i: F.when(i < kept, F.lit(1).cast("long")).otherwise(n)))
    )


def _placed(radix: Column, salt: Column) -> Column:
    """The draws that make the replacement of a place: its digits by the radices."""
    start = F.struct((salt.cast("long") - ROUNDS - 1).alias("rest"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, n: F.struct(F.floor((acc["rest"] - F.pmod(acc["rest"], n)) / n).cast("long").alias("rest"), F.concat(acc["out"], F.array(F.pmod(acc["rest"], n).cast("int"))).alias("out"))
    return F.concat(F.aggregate(radix, start, step)["out"], F.array_repeat(F.lit(0), 32))


def _written(kind: Column, entity: Column, value: Column, salt: Column, draws: Column) -> Column:
    hexed = F.array_join(F.transform(F.slice(draws, 1, F.greatest(F.char_length(value), F.lit(1))), lambda n: F.substring(F.lit(_HEX), F.pmod(n, F.lit(16)) + 1, F.lit(1))), "")
    mailbox = F.when(salt > ROUNDS, F.lpad(F.lower(F.hex(salt.cast("long") - ROUNDS - 1)), 14, "0")).otherwise(F.substring(_digest(kind, value, salt, F.lit(0)), 1, 14))
    local = F.concat(F.lit("user."), mailbox, F.lit("@example.net"))
    octet = lambda i: F.element_at(draws, F.lit(i)).cast("string")
    address = F.concat(F.lit("10."), octet(1), F.lit("."), octet(2), F.lit("."), octet(3))
    head, body, tail = _secret_parts(entity)
    hidden = F.when(body.rlike(r"\A[0-9a-f]+\z"), F.substring(hexed, F.lit(1), F.char_length(body))).otherwise(_like(body, draws))
    number = F.pmod(F.element_at(draws, 1) * 256 + F.element_at(draws, 2), F.lit(32 * 32))
    named = lambda g: F.concat(
        F.element_at(F.array(*map(F.lit, _NAMES[g])), F.pmod(number, F.lit(32)).cast("int") + 1), F.lower(F.element_at(F.array(*map(F.lit, _NAMES[g])), F.floor(number / 32).cast("int") + 1)),
        F.when(salt > 0, F.lower(_like(F.lit("aaaa"), F.slice(draws, 3, 8)))).otherwise(""),
    )
    return (
        F.when(kind == "email", local)
        .when(kind == "ip", address)
        .when(kind == "secret", F.concat(head, hidden, tail))
        .when(kind.startswith("name") & ~_is_latin(value), _like(value, draws))
        .when(kind == "name_f", named("name_f"))
        .when(kind == "name_m", named("name_m"))
        .otherwise(_like_kept(entity, value, draws, _kept(kind, entity)))
    )


def _like_kept(entity: Column, value: Column, draws: Column, first: Column) -> Column:
    """As _like, but draws are used up by letters and digits only, so mentions in other formats get the same ones."""
    drawn_ones = F.transform(F.split(value, ""), lambda c, i: _alike(c, F.element_at(draws, i + 1)))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("used"), F.lit(0).alias("at"))

    def step(drawn: Column, acc: Column, c: Column) -> Column:
        counts = c.rlike(r"[\p{L}\p{N}]")
        made = F.when((acc["at"] < first) | ~counts, c).otherwise(F.coalesce(F.try_element_at(drawn, acc["used"] + 1), c))
        return F.struct(F.concat(acc["out"], made).alias("out"), (acc["used"] + counts.cast("int")).alias("used"), (acc["at"] + 1).alias("at"))

    return let(drawn_ones, lambda drawn: F.aggregate(F.split(entity, ""), start, lambda acc, c: step(drawn, acc, c))["out"])


def _choices(c: Column) -> Column:
    """How many characters _alike may give for `c`."""
    made = F.when(c.rlike(r"\A\p{N}\z"), 10).when(c.rlike(r"\A[a-zA-Z]\z"), 26)
    for script, letters in _SCRIPTS:
        made = made.when(c.rlike(rf"\A\p{{Is{script}}}\z"), len(letters))
    return made.when(c.rlike(r"\A\p{L}\z"), 26).otherwise(1).cast("long")


def _alike(c: Column, n: Column) -> Column:
    """A drawn character of the kind of `c`: digit, or letter of the same script and case."""
    pick = lambda letters: F.substring(F.lit(letters), F.pmod(n, F.lit(len(letters))) + 1, F.lit(1))
    made = F.when(c.rlike(r"\A\p{N}\z"), pick("0123456789")).when(c.rlike(r"\A[a-z]\z"), pick(_LOWER)).when(c.rlike(r"\A[A-Z]\z"), pick(_UPPER))
    for script, letters in _SCRIPTS:
        made = made.when(c.rlike(rf"\A[\p{{Is{script}}}&&\p{{Lu}}]\z"), pick(letters.upper())).when(c.rlike(rf"\A\p{{Is{script}}}\z"), pick(letters))
    return made.when(c.rlike(r"\A\p{Lu}\z"), pick(_UPPER)).when(c.rlike(r"\A\p{L}\z"), pick(_LOWER)).otherwise(c)


def may_hold(text: Column) -> Column:
    """Whether a text has what each pattern needs, found by plain searches: most texts have nothing of it and meet no pattern."""
    has = lambda *parts: reduce(or_, (text.contains(p) for p in parts))
    secret = has("=", ":") & text.rlike(r"(?i)passw|pwd|token|secret|api[_-]?key")
    return has("@", "AKIA", "ASIA", "Mr", "Ms", "Mme", "Mlle", "Frau", "Sr", "Herr") | text.rlike("[0-9]") | secret


def entities(text: Column) -> Column:
    """The entities of a text in order; NULL for a missing text."""
    none = F.array().cast("array<string>")
    return F.when(text.isNull(), None).when(may_hold(text), F.regexp_extract_all(text, F.lit(ALL), F.lit(0))).otherwise(none)


def _settled(found: DataFrame) -> DataFrame:
    """kind, value, salt of the values that must draw again: a few, as replacements are long. `found`: distinct kind, value, shape.

    Ends when no replacement is another value's or a value that occurs. What has no character to replace stays as it is.
    """
    at = lambda salt: surrogate(F.col("kind"), F.col("shape"), F.col("value"), salt)
    taken = lambda given: normal_form(F.col("kind"), given)
    room = F.aggregate(radices(F.col("kind"), F.col("shape"), F.col("value")), F.lit(1.0), lambda a, n: a * n)
    drawn = found.select("kind", "value", "shape", F.lit(0).cast("long").alias("salt"), at(F.lit(0)).alias("given"))
    drawn = written(drawn.withColumn("norm", taken(F.col("given"))).drop("given"))
    held = drawn.select("kind", F.col("value").alias("norm"))
    salt = 0
    while True:
        # among values of one replacement the smallest keeps it; one that occurs as a value is kept by nobody
        firsts = drawn.groupBy("kind", "norm").agg(F.min("value").alias("owner"), F.count(F.lit(1)).alias("n"))
        real = drawn.select("kind", "norm").distinct().join(held, ["kind", "norm"], "left_semi").withColumn("real", F.lit(True))
        bad = firsts.join(real, ["kind", "norm"], "left").where("n > 1 OR real").withColumnRenamed("kind", "b_kind").withColumnRenamed("norm", "b_norm")
        marked = drawn.join(bad, (F.col("kind") == F.col("b_kind")) & (F.col("norm") == F.col("b_norm")), "left")
        again = F.col("b_kind").isNotNull() & (F.coalesce("real", F.lit(False)) | (F.col("value") != F.col("owner")))
        marked = written(marked.select("kind", "value", "shape", "salt", "norm", again.alias("again")))
        left = marked.where("again").withColumn("room", room).where("room > 1")
        if left.isEmpty():
            return drawn.where("salt > 0").select("kind", "value", "salt")
        salt += 1
        if salt <= ROUNDS:
            moved = left.select("kind", "value", "shape", F.lit(salt).cast("long").alias("salt"))
        else:
            moved = _free_places(left, marked.where("NOT again").select("kind", "norm").unionByName(held).distinct(), at, taken)
        moved = moved.withColumn("given", at(F.col("salt"))).withColumn("norm", taken(F.col("given"))).drop("given")
        rest = marked.join(left.select("kind", "value"), ["kind", "value"], "left_anti").select("kind", "value", "shape", "salt", "norm")
        drawn = written(rest.unionByName(moved))


def _free_places(left: DataFrame, forbidden: DataFrame, at: Callable[[Column], Column], taken: Callable[[Column], Column]) -> DataFrame:
    """kind, value, shape, salt of the values `left`, each with a place of its format that isn't forbidden; raises if there are too few.

    Values are of one format if place 0 reads the same. Of as many places as are forbidden and wanted, enough are free.
    """
    own = written(left.withColumn("format", taken(at(F.lit(ROUNDS + 1).cast("long")))))
    sizes = forbidden.groupBy("kind").agg(F.count(F.lit(1)).alias("closed"))
    formats = own.groupBy("kind", "format").agg(F.count(F.lit(1)).alias("wanted"), F.min(F.struct("value", "shape")).alias("any"), F.max("room").alias("room")).join(sizes, "kind")
    listed = formats.withColumn("most", F.least(F.col("room"), (F.col("closed") + F.col("wanted")).cast("double")).cast("long"))
    blocks = listed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("most") - 1) / BLOCK)))).repartition("kind", "format", "block")
    places = blocks.withColumn("place", F.explode(F.sequence(F.col("block") * BLOCK, F.least((F.col("block") + 1) * BLOCK, F.col("most")) - 1)))
    places = places.select("kind", "format", "wanted", F.col("any.value").alias("value"), F.col("any.shape").alias("shape"), (F.col("place") + ROUNDS + 1).alias("salt"))
    free = places.withColumn("norm", taken(at(F.col("salt")))).join(forbidden, ["kind", "norm"], "left_anti")
    by_format = Window.partitionBy("kind", "format")
    free = free.withColumn("rank", F.row_number().over(by_format.orderBy("salt"))).where("rank <= wanted").select("kind", "format", "rank", "salt")
    ranked = own.select("kind", "value", "shape", "format", F.row_number().over(by_format.orderBy(hmac(F.col("value")))).alias("rank"))
    moved = written(ranked.join(free, ["kind", "format", "rank"], "left").select("kind", "value", "shape", "format", "salt"))
    short = moved.where("salt IS NULL").select("kind", "format").first()
    if short:
        raise ValueError(f"more values than places: {short['kind']} of the format {short['format']!r}")
    return moved.drop("format")


def surrogates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False, key: str | None = None) -> DataFrame:
    """`docs` with replaced entities: id_col, text, n_entities and kinds (of the entities, in order); or, with keep_columns, the
    columns of `docs` alone.

    Texts without entities, missing and empty ones stay as they are. The same value gets the same replacement in every row
    (repeated rows stay equal), different values of a type different ones. Other columns are passed on unread, whatever their
    names; an empty table gives an empty result. key: of the keyed hash; None: what KEY_SETTING says, or else KEY.
    """
    token = _key.set(key or docs.sparkSession.conf.get(KEY_SETTING, KEY))
    try:
        return _surrogates(docs, id_col, text_col, keep_columns)
    finally:
        _key.reset(token)


def _surrogates(docs: DataFrame, id_col: str, text_col: str, keep_columns: bool) -> DataFrame:
    quoted = lambda name: F.col("`" + name.replace("`", "``") + "`")
    own = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), quoted(text_col).alias("text"), entities(quoted(text_col)).alias("found"))
    mentions = own.select(F.explode("found").alias("entity")).groupBy("entity").count().select("entity")
    typed = mentions.withColumn("kind", kind_of(F.col("entity"))).select("kind", F.inline(values_of(F.col("kind"), F.col("entity"))))
    found = cut(typed.groupBy("kind", "value").agg(F.min("shape").alias("shape")))
    again = _settled(found).select(F.concat_ws("\u0001", "kind", "value").alias("name"), "salt")
    few = again.limit(FEW_SALTS + 1).collect()
    if len(few) <= FEW_SALTS:
        salts = F.create_map(*[F.lit(x) for r in few for x in r]) if few else None
        return _replaced(own, docs, salts, id_col, text_col, keep_columns)
    # too many to be part of the plan: each text that has such values gets their salts beside it
    keyed = own.withColumn("text_key", F.sha2("text", 256))
    named = keyed.select("text_key", F.explode("found").alias("e")).distinct().withColumn("kind", kind_of(F.col("e")))
    named = named.select("text_key", F.inline(values_of(F.col("kind"), F.col("e"))), "kind").select("text_key", F.concat_ws("\u0001", "kind", "value").alias("name")).distinct()
    maps = named.join(again, "name").groupBy("text_key").agg(F.map_from_entries(F.collect_list(F.struct("name", "salt"))).alias("salts"))
    beside = keyed.join(maps, "text_key", "left")
    return _replaced(beside, docs, F.coalesce("salts", F.create_map().cast("map<string,bigint>")), id_col, text_col, keep_columns)


def _replaced(own: DataFrame, docs: DataFrame, salts: Column | None, id_col: str, text_col: str, keep_columns: bool) -> DataFrame:
    salt = lambda kind, value: F.lit(0) if salts is None else F.coalesce(F.try_element_at(salts, F.concat_ws("\u0001", kind, value)), F.lit(0))

    def word(kind: Column, w: Column) -> Column:
        initial = _alike(w, F.element_at(_drawn(kind, w, F.lit(0), F.lit(1)), 1))  # 26 of them can't be kept apart
        return F.when(F.char_length(w) == 1, initial).otherwise(let(salt(kind, w), lambda s: surrogate(kind, w, w, s)))

    def titled(kind: Column, e: Column) -> Column:
        return F.concat(F.regexp_extract(e, _TITLE, 0), _words_given(F.regexp_replace(e, _TITLE, ""), lambda w: word(kind, w)))

    def given(e: Column) -> Column:
        whole = lambda kind: let(normal_form(kind, e), lambda value: let(salt(kind, value), lambda s: surrogate(kind, e, value, s)))
        return let(kind_of(e), lambda kind: F.when(kind.startswith("name"), titled(kind, e)).otherwise(whole(kind)))

    # words of a titled name are replaced wherever else the text has them; the first title with a word tells its kind
    people = F.flatten(F.transform("found", lambda e: let(kind_of(e), lambda kind: F.when(kind.startswith("name"), F.transform(F.filter(parts_of(e), lambda p: F.char_length(p) > 1), lambda p: F.struct(p.alias("word"), word(kind, p).alias("given")))).otherwise(F.array().cast("array<struct<word:string,given:string>>")))))
    mentioned = lambda text, known: _words_given(text, lambda w: let(F.array_position(known["word"], w), lambda n: F.when(n > 0, F.try_element_at(known["given"], n.cast("int"))).otherwise(w)))
    pieces = F.split(F.col("text"), ALL, -1)
    titles = F.exists("found", lambda e: kind_of(e).startswith("name"))
    between = F.when(titles, let(people, lambda known: F.transform(pieces, lambda p: mentioned(p, known)))).otherwise(pieces)
    joined = let(between, lambda left: F.concat(F.array_join(F.flatten(F.zip_with(F.slice(left, 1, F.size("found")), F.transform(F.col("found"), given), lambda p, e: F.array(p, e))), ""), F.element_at(left, -1)))
    text = F.when(F.size("found") > 0, joined).otherwise(F.col("text"))
    row = F.col("row")
    if keep_columns:
        return own.select(*[text.alias(c) if c == text_col else row[c].alias(c) for c in docs.columns])
    return own.select(row[id_col].alias(id_col), text.alias("text"), F.greatest(F.size("found"), F.lit(0)).cast("long").alias("n_entities"), F.coalesce(F.transform("found", kind_of), F.array().cast("array<string>")).alias("kinds"))
