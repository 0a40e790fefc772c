"""Surrogates of names, and formats with few places."""

import re

import pytest

from plumbline.llm import near_dedup, pii


def short_names(spark, n):
    letters = pii._SCRIPTS[0][1]
    names = [a.upper() + b for a in letters for b in letters][:n]
    return names, spark.createDataFrame([(k, f"Herr {name} kam") for k, name in enumerate(names)], "doc_id long, text string")


def test_a_dense_format_keeps_values_distinct(spark):
    names, frame = short_names(spark, 340)  # of 729 places, 340 are taken by the names themselves
    given = [r["text"].split()[1] for r in pii.surrogates(frame).collect()]
    assert len(set(given)) == len(names) and not set(given) & set(names)


def test_a_format_with_too_few_places_raises(spark):
    with pytest.raises(ValueError, match="more values than places"):
        pii.surrogates(short_names(spark, 400)[1]).collect()


def test_whole_names_and_their_later_mentions(spark):
    texts = [
        "Mr. John Smith came. Smith said that John's car was Mr. Smith's.", "Mr. O'Brien and Mr. J. Harper met Mrs.  Mary-Ann Jones; O'Brien left.",
        "Frau von der Leyenberg spoke. Later Leyenberg left.", "Mr. Smith The end, Smithson stays", "Smith without a title",
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.surrogates(frame).collect()}
    for n, gone in ((0, ("John", "Smith")), (1, ("Brien", "Harper", "Mary", "Ann", "Jones")), (2, ("Leyenberg",))):
        assert not [w for w in gone if w in got[n]], got[n]
    first, last = got[0].split()[1:3]
    assert got[0] == f"Mr. {first} {last} came. {last} said that {first}'s car was Mr. {last}'s."
    assert got[1].split()[1] == got[1].split()[-2] and "Mrs.  " in got[1]
    assert re.fullmatch(r"[A-Z]\.", got[1].split()[4])
    assert got[2].startswith("Frau von der ") and got[2].split()[3] == got[2].split()[-2]
    assert got[3] == f"Mr. {last} The end, Smithson stays" and got[4] == texts[4]


def test_near_copies_go_by_id_and_text(spark):
    text = " ".join(f"word{i}" for i in range(200))
    rows = [(1, text), (2, text + " tail"), (2, "a clean text of other words that no row has"), (None, text + " end"), (None, "one more text of words by itself"), (3, None), (4, "")]
    frame = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, row_no long")
    # by brute force: of word sets that meet in three quarters of their union, the one of the smallest id stays
    words = [set((t or "").split()) for _, t in rows]
    alike = lambda a, b: bool(words[a]) and 4 * len(words[a] & words[b]) >= 3 * len(words[a] | words[b])
    order = lambda n: (rows[n][0] is None, rows[n][0] or 0)
    want = [n for n in range(len(rows)) if all(order(n) <= order(m) for m in range(len(rows)) if alike(n, m))]
    got = near_dedup.drop_near_duplicates(frame)
    assert got.columns == frame.columns and sorted(r["row_no"] for r in got.collect()) == want == [0, 2, 4, 5, 6]
