"""Shards of the language model: their number follows the input, the scores do not."""

from millrace.llm import language_model


def test_shards_of_a_large_input_stay_small():
    for gb in (1, 6, 30, 1000):
        bits, words = language_model.shard_bits(gb << 30, 8)
        assert (gb << 30) / 2**bits <= language_model.GRAM_BYTES and (gb << 30) / 2**words <= language_model.WORD_BYTES and words <= bits
    assert language_model.shard_bits(0, 3) == (3, 2)


def test_scores_do_not_depend_on_the_shards(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i % 7} and the word{i % 11} again") for i in range(60)] + [(99, None)], "doc_id long, text string")
    score = lambda: sorted((r.doc_id, r.n_known, round(r.base_score, 9), round(r.score, 9)) for r in language_model.score_texts(docs, language_model.count_model(docs)).collect())
    want = score()
    monkeypatch.setattr(language_model, "GRAM_BYTES", 50)
    monkeypatch.setattr(language_model, "WORD_BYTES", 50)
    assert score() == want
