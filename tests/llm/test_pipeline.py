"""Each stage of the corpus pipeline, and all of them, against plain versions on small tables."""

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_groups import brute
from test_rows import LONG, labelled

import corpus_pipeline
from plumbline.llm import common, exact_dedup, near_dedup, packing, pii, toxicity

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, digest string, id long, row string, text_sha256 string, found string, nth long"


def rows_of_all_kinds():
    rng = np.random.default_rng(3)
    base = " ".join(f"w{x}" for x in rng.integers(0, 500, 90))
    texts = [(1, base), (2, base), (2, base), (3, base + " tail"), (4, "lead " + base), (5, ""), (6, None), (7, None), (None, "no id"), (None, "no id"), (8, LONG), (9, LONG + " end"), (10, "mail a@b.org or 10.1.2.3 now"), (11, "Mrs. Miller"), (11, "another text of id eleven"), (12, "ünï")]
    return [(i, t, "en" if n % 3 else None, "s", len(t or ""), "d", 9, "r", "x", "f", n) for n, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of_all_kinds(), SHAPE).repartition(3)


def told(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in df.collect())


def test_exact(spark, docs):
    rows, want = rows_of_all_kinds(), {}
    for r in rows:
        key = r[1] or ""
        if key not in want or (r[0] if r[0] is not None else -1) > (want[key] if want[key] is not None else -1):
            want[key] = r[0]
    for few in (exact_dedup.FEW_GONE, 0):  # by broadcasts, and by shuffles
        before, exact_dedup.FEW_GONE = exact_dedup.FEW_GONE, few
        try:
            got = exact_dedup.drop_exact_duplicates(docs)
            assert got.columns == docs.columns and {(r["text"] or "", r["doc_id"]) for r in got.collect()} == set(want.items()) and got.count() == len(want)
        finally:
            exact_dedup.FEW_GONE = before
    hot = docs.unionByName(docs.sparkSession.range(3000).selectExpr("id AS doc_id", "'hot' AS text", "'l' AS lang", "'s' AS source", "id AS n_chars", "'d' AS digest", "id", "'r' AS row", "'x' AS text_sha256", "'f' AS found", "id AS nth"))
    assert exact_dedup.drop_exact_duplicates(hot).where("text = 'hot'").select("doc_id").collect()[0][0] == 2999 and exact_dedup.drop_exact_duplicates(hot).count() == len(want) + 1


def test_empty_tables(spark, docs):
    empty, labels = docs.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert exact_dedup.drop_exact_duplicates(empty).count() == 0 and near_dedup.drop_near_duplicates(empty).count() == 0
    assert pii.surrogates(empty, keep_columns=True).count() == 0 and packing.pack_documents(empty).count() == 0
    assert toxicity.drop_toxic(empty, labels).count() == 0 and told(toxicity.drop_toxic(docs, labels)) == told(docs)


def test_toxic_rows_go(spark):
    texts, labels, rows = labelled(spark)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(texts, labels).collect()}
    kept = {r["doc_id"] for r in toxicity.drop_toxic(texts, labels).collect()}
    assert kept == {i for i, s in scores.items() if s < toxicity.THRESHOLD}


def test_a_labelled_id_that_repeats(spark):
    texts, labels, _ = labelled(spark)
    many = texts.unionByName(texts.where("doc_id < 40").crossJoin(spark.range(50).select()).select("doc_id", F.concat("text", F.lit(" ")).alias("text")))
    assert toxicity.score_toxicity(many, labels).count() == many.count()


def test_whole_pipeline(spark, tmp_path):
    texts, labels, _ = labelled(spark)
    rng = np.random.default_rng(8)
    clean = [(1000 + k, " ".join(f"{a}{b}" for a, b in zip(rng.choice(["river", "barn", "fox", "box"], 70), rng.integers(0, 50, 70)))) for k in range(30)]
    more = [(2000 + k, t) for k, (_, t) in enumerate(clean[:5])] + [(3000 + k, t + " tail") for k, (_, t) in enumerate(clean[5:10])] + [(4000, clean[0][1] + " write to someone@example.org"), (4001, None), (4002, "")]
    own = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in clean + more], "doc_id long, text string, lang string, source string, n_chars long")
    docs = texts.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "length(text) + 0L AS n_chars").unionByName(own)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stages, seen = dict(corpus_pipeline.STAGES), {}
    got = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    # stage by stage, by plain means
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, labels).collect()}
    left = [(r["doc_id"], r["text"]) for r in docs.collect() if scores[r["doc_id"]] < 0.5]
    for i, t in left:
        seen[t or ""] = max(i, seen.get(t or "", i))
    left = [(i, t) for i, t in left if seen[t or ""] == i]
    roots = dict(brute(left))
    left = [(i, t) for i, t in left if roots[i] == i]
    frame = spark.createDataFrame([(i, t) for i, t in left], "doc_id long, text string")
    hidden = {r["doc_id"]: r["text"] for r in pii.surrogates(frame).collect()}
    assert not any("someone@" in (t or "") for t in hidden.values())
    from public_tokenizers import path
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path("word_bpe_49k.json"))
    lengths = {i: len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in hidden.items()}
    assert {r[0] for r in got} == set(lengths)
    assert {i: sum(r[3] for r in got if r[0] == i) for i in lengths} == lengths
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "pii", "packing"] and len(stages) == 5


def test_the_folder_must_be_named_on_a_cluster():
    unset = SimpleNamespace(get=lambda *_: None)
    for master in ("spark://host:7077", "local-cluster[3,2,1000]"):
        context = SimpleNamespace(getConf=lambda: unset, getCheckpointDir=lambda: None, master=master)
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            common.shared_dir(SimpleNamespace(conf=unset, sparkContext=context))
