"""The pipeline's stages against plain Python, and on odd tables."""

import random

import corpus_pipeline
import pytest
from test_llm import bags, lines

from tideline.llm import _state, minhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STAGE = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Benchmark and labels as the stages read them."""
    at = str(tmp_path_factory.mktemp("tables"))
    item = lines(1, 51, low=30, high=30)[0]
    spark.createDataFrame([("a", item), ("b", None)], "item_id string, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(k, int(k % 2), 0) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at, item


def rows(spark, texts):
    return spark.createDataFrame([(k, t, "en", None, None) for k, t in enumerate(texts)], SCHEMA)


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "MinHash near-dedup", "benchmark decontamination", "PII", "best-fit packing"]


def test_stages_keep_clean_documents(spark, folder):
    at, item = folder
    clean = lines(20, 52, low=60, high=80)
    near = [t + " more" for t in clean[:5]]
    assert all(sum((a & b).values()) >= 0.8 * sum((a | b).values()) for a, b in zip(bags(clean[:5]), bags(near), strict=True))
    texts = clean + near + [clean[0], f"{clean[1][:200]} {item} {clean[2][:200]}", "write to ann@corp.example soon", None, ""]
    docs = rows(spark, texts)
    once = STAGE["MinHash near-dedup"](spark, docs, at)
    assert once.columns == docs.columns
    assert sorted(r.doc_id for r in once.collect()) == [*range(20), 26, 27, 28]  # null is an empty text
    free = {r.doc_id: r.text for r in STAGE["benchmark decontamination"](spark, docs, at).collect()}
    assert item not in free[26]
    assert all(free[k] == t for k, t in enumerate(texts) if k != 26)
    masked = {r.doc_id: r.text for r in STAGE["PII"](spark, docs, at).collect()}
    assert masked[27] == "write to [EMAIL] soon"
    assert all(masked[k] == t for k, t in enumerate(texts) if k != 27)


def test_quality_filter(spark, folder):
    """Even ids are junk and labelled so."""
    r = random.Random(53)
    good = lines(60, 54, low=60, high=90)
    texts = [t if k % 2 else " ".join(r.choice(["###", "$$$", "click", "buy"]) for _ in range(70)) for k, t in enumerate(good)]
    kept = {x.doc_id for x in STAGE["quality classifier"](spark, rows(spark, texts), folder[0]).collect()}
    assert kept == {k for k in range(60) if k % 2}


def test_empty_tables(spark, folder):
    docs = rows(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder[0])
        assert out.isEmpty(), name
        if name != "best-fit packing":
            assert out.columns == docs.columns


def test_near_dedup_moves_few_texts_and_leaves_few_files(spark, folder, monkeypatch, tmp_path):
    """With joins that may not broadcast, as on large inputs: texts alone in their classes are not shuffled, and tables that are spent go."""
    r = random.Random(55)
    texts = [" ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=9)) for _ in range(3000)) for _ in range(60)]
    texts += [texts[0], texts[1] + " more", texts[2] + " more"]
    docs = rows(spark, texts).repartition(3)
    docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    monkeypatch.setattr(minhash, "small_side", lambda df, *_: df)
    monkeypatch.setattr(_state, "shared_dir", lambda _: str(tmp_path))
    shuffled = lambda: (spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(), spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite())[1]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled()
        kept = sorted(x.doc_id for x in STAGE["MinHash near-dedup"](spark, docs, folder[0]).select("doc_id", "text").collect())
        moved = shuffled() - before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert kept == list(range(60))
    assert moved < 0.5 * sum(map(len, texts))
    left = {x.name.rsplit("-", 1)[0] for x in tmp_path.iterdir()}
    assert not left & {f"tideline-minhash-{n}" for n in ("signed", "nodes", "rows", "sets", "few", "classes")}


def test_marks(spark):
    """Every key that is there is found; few others are, and each row is on one side."""
    keys = spark.range(0, 40_000, 2).selectExpr("id * 7919 AS k")
    rows = spark.range(0, 40_000).selectExpr("id * 7919 AS k", "id")
    marks = _state.Marks(keys, "k", 20_000, "test-marks")
    there = {x.id for x in marks.split(rows, "k", True).collect()}
    rest = {x.id for x in marks.split(rows, "k", False).collect()}
    assert set(range(0, 40_000, 2)) <= there and len(there) < 21_000
    assert not there & rest and len(there) + len(rest) == 40_000
    none = _state.Marks(keys.limit(0), "k", 0, "test-marks")
    assert none.split(rows, "k", True).isEmpty() and none.split(rows, "k", False).count() == 40_000
