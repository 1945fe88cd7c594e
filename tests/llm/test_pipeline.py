"""The pipeline's stages, one after the other, on a small corpus with planted cases."""

import random

import pytest

import corpus_pipeline
from millrace.llm import near_dedup

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choices(vocab, k=n))
    passage, original = text(70), text(200)
    rows, labels = [], []
    for i in range(300):
        words = text(rng.randint(30, 120))
        junk, toxic = i % 5 == 0, i % 5 == 1
        if junk:
            words = " ".join(w + "$$$" for w in words.split())
        if toxic:
            words += " scum moron idiot loser trash"
        if i in (52, 53, 54):
            words = f"{words} {passage} {text(20)}"
        if i in (102, 103, 104):
            words = original if i < 104 else original.replace(original.split()[50], "changed", 1)
        rows.append((i, words, "en", "s", len(words)))
        labels.append((i, int(not junk), int(toxic)))
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, passage


def test_stages(spark, corpus, tmp_path):
    folder, passage = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
        assert name == "pack" or docs.columns == columns
    ids = {k: {r.doc_id for r in v} for k, v in seen.items()}
    assert len(ids["quality"] & {i for i in range(300) if i % 5 == 0}) <= 3
    assert len(ids["quality"] & {i for i in range(300) if i % 5}) >= 237
    assert ids["near_duplicates"] == ids["quality"] - {103, 104}
    held = [r.doc_id for r in seen["repeated_passages"] if passage[3:-3] in r.text]
    assert held == [52]
    assert len([i for i in ids["source_mixing"] if i % 5 == 1]) < len([i for i in ids["quality"] if i % 5 == 1]) / 2
    assert ids["pack"] == ids["source_mixing"]


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_duplicate_stage_keeps_rows_without_id(spark):
    rows = [(None, "a b c d e f", "en", "s", 1), (None, None, "en", "s", 1), (1, "x y z", "en", "s", 1), (1, "x y z", "en", "s", 1), (1, "other words", "en", "s", 1)]
    got = near_dedup.without_near_duplicates(spark.createDataFrame(rows, COLUMNS)).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == [(0, ""), (0, "a b c d e f"), (1, "other words"), (1, "x y z")]
