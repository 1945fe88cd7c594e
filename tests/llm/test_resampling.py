"""op 11: gains, scores and the external merge, against a plain form."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import resampling

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, score double, rank string"


def plain_features(text, order=1):
    words = WORD.findall((text or "").translate(LOWER))
    return words, [" ".join(words[i : i + n]) for n in range(1, order + 1) for i in range(len(words) - n + 1)]


def plain(rows, target, order=1, share=(10, 100), min_words=20):
    """What the contract says, row by row."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s = Counter(bucket(f) for _, t in rows for f in plain_features(t, order)[1])
    t = Counter(bucket(f) for x in target for f in plain_features(x, order)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000))))
    out = []
    for i, text in rows:
        words, features = plain_features(text, order)
        weight = sum(gain(bucket(f)) for f in features)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= min_words])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    ranks = {id(r): n for n, r in enumerate(able[: share[0] * len(able) // share[1]], 1)}
    return sorted((tuple(r[:4]) + (ranks.get(id(r)),) for r in out), key=repr)


def odd_rows(n=400):
    rng = random.Random(5)
    vocab = [f"Word{i}" for i in range(50)] + ["é", "x-y", "a_b", "İ", "7th"]
    text = lambda k: " ".join(rng.choices(vocab, k=k))
    same = text(40)
    rows = [(1, None), (2, ""), (3, " .,;"), (None, same), (None, same), (7, same), (7, same), (7, same + " more"), (8, text(60_000))]
    return rows + [(i, same if i % 3 == 0 else text(rng.randint(1, 60))) for i in range(10, n)]


@pytest.mark.parametrize("slice_rows,block", [(1 << 14, 256), (7, 3), (1, 1)])
def test_equals_the_plain_form(spark, monkeypatch, slice_rows, block):
    monkeypatch.setattr(resampling, "SLICE_ROWS", slice_rows)
    monkeypatch.setattr(resampling, "BLOCK", block)
    rows, target = odd_rows(), ["word1 word2 word3 é", None, "", "7th word1 word1"]
    docs = spark.createDataFrame([(i, t, 1.0, "r") for i, t in rows], SCHEMA).repartition(5)
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    for share in ((10, 100), (37, 100), (100, 100)):
        got = resampling.with_ranks(resampling.importance(docs, bench), F.col("n_words") >= 20, share)
        assert sorted(map(tuple, got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr) == plain(rows, target, share=share)


def test_runs_of_words(spark):
    rows, target = odd_rows(60), ["word1 word2 word3", "word1 word2"]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.importance(docs, bench, order=3).select("doc_id", "n_features", "weight", "score")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((r[:4] for r in plain(rows, target, 3)), key=repr)


def test_whole_rows_come_back(spark):
    rows = odd_rows(200)
    docs = spark.createDataFrame([(i, t, 1.0, "r") for i, t in rows], SCHEMA)
    got = resampling.resampled(docs, docs.limit(5)).collect()
    assert sorted(r._rank for r in got) == [*range(1, sum(len(plain_features(t)[0]) >= 20 for _, t in rows) // 10 + 1)]
    assert {(r.doc_id, r.text) for r in got} <= set(rows) and set(got[0].asDict()) == {"doc_id", "text", "score", "rank", "_score", "_rank"}


def test_empty_tables(spark):
    docs, none = spark.createDataFrame(odd_rows(50), "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    assert resampling.with_ranks(resampling.importance(none, docs), F.col("n_words") >= 20).count() == 0
    got = resampling.with_ranks(resampling.importance(docs, none), F.col("n_words") >= 20).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted(map(tuple, got.collect()), key=repr) == plain(odd_rows(50), [])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 5)), max_size=12), max_size=9), st.integers(1, 4), st.integers(0, 40))
def test_merge_of_any_runs(runs, size, draw):
    rows = lambda run: [{"score": s, "doc_id": d, "n_features": 0} for s, d in sorted(run, key=lambda x: (-x[0], x[1]))]
    cut = [own[i : i + size] for own in map(rows, runs) for i in range(0, len(own), size)]
    blocks = sorted(cut, key=lambda b: resampling._key(b[0]))
    got = [*resampling.merged(iter(blocks), 3, 3 + draw)]
    every = sorted((resampling._key(r) for own in runs for r in rows(own)))
    assert [resampling._key(r) for r, n in got if n] == every[:draw] and [n for _, n in got if n] == [*range(4, 4 + min(draw, len(every)))]
    assert sorted(resampling._key(r) for r, _ in got) == every
