"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text's features are its hashed words (log counts, normed), one bin of each structure statistic, and a
bin of the ``n_chars`` column.  The score is the logistic of ``w0 + sum(w x) + sum of pairwise
interactions``, the latter through ``((sum v x)^2 - sum (v x)^2) / 2`` per factor, so in linear time.

The model is fitted on at most about ``TRAIN_ROWS`` labelled documents, chosen by hash, in one task of
bounded input; it has a fixed size and is broadcast.  Every document is scored.

Defined cases: a null or empty text is scored by its statistics; a null ``n_chars`` is a bin of its own,
and so is a missing column; labels that repeat count once per document (the least quality), null
labels not at all; without labels of both kinds every score is 0.5; repeated rows and null ids are
scored like any others; an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CACHED_WORDS, crc_mod, slices, small_batches, table

TRAIN_ROWS = 12_000
WORD_BITS, FACTORS, BINS = 15, 8, 16
EPOCHS, BATCH, RATE, RIDGE = 5, 64, 0.05, 1e-5
# Bytes that statistics count the share of.
_SYMBOLS, _DIGITS, _CAPITALS = b"#*$%&|<>!?@~^_={}[]\\/+", string.digits.encode(), string.ascii_uppercase.encode()
N_STATISTICS = 12
SIZE = (1 << WORD_BITS) + N_STATISTICS * BINS


class _Buckets(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > CACHED_WORDS:
            self.clear()
        plain = word.strip(string.punctuation).lower()
        self[word] = b = xxhash.xxh3_64_intdigest(plain.encode()) & (1 << WORD_BITS) - 1
        return b


_BUCKETS = _Buckets()


def statistics(text: str, words: list[str], counts: np.ndarray, n_chars: int | None) -> list[int]:
    """The bin of every structure statistic, shares on a root scale and sizes on a log scale.

    ``counts`` are of the words' buckets.
    """
    n, chars, raw = max(1, len(words)), max(1, len(text)), text.encode()
    lines = [s for s in text.split("\n") if s and not s.isspace()]
    share = lambda a, b: min(BINS - 1, int(BINS * min(1.0, a / max(1, b)) ** 0.5))
    log = lambda x: min(BINS - 1, int(x + 1).bit_length() - 1)
    of = lambda kind: share(len(raw) - len(raw.translate(None, kind)), chars)
    return [
        log(len(words)), min(BINS - 1, (chars - len(words)) // n), of(_SYMBOLS), of(_DIGITS), of(_CAPITALS), share(len(counts), n), share(int(counts.max(initial=0)), n),
        share(len(lines) - len(set(lines)), len(lines)), log(chars // max(1, len(lines))), share(raw.count(b"|"), n), share(sum(map((1).__eq__, map(len, words))), n), 0 if n_chars is None else max(1, log(max(0, n_chars))),
    ]


def features(text: str, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the features of one text."""
    words = text.split()
    index, count = np.unique(np.fromiter(map(_BUCKETS.__getitem__, words), np.int32, len(words)), return_counts=True)
    value = np.log1p(count).astype(np.float32)
    value /= max(1.0, float(np.sqrt((value**2).sum())))
    bins = np.arange(N_STATISTICS, dtype=np.int32) * BINS + np.array(statistics(text, words, count, n_chars), np.int32) + (1 << WORD_BITS)
    return np.concatenate([index, bins]), np.concatenate([value, np.full(N_STATISTICS, 0.5, np.float32)])


def _sums(index: np.ndarray, value: np.ndarray, starts: np.ndarray, w: np.ndarray, v: np.ndarray):
    """Per row: the raw score and the factors' sums; rows have a feature at least."""
    vx = v[index] * value[:, None]
    total = np.add.reduceat(vx, starts)
    pairs = 0.5 * (total**2 - np.add.reduceat(vx**2, starts)).sum(1)
    return np.add.reduceat(w[index] * value, starts) + pairs, total


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors by AdaGrad over shuffled batches."""
    rng = np.random.default_rng(seed)
    w, v = np.zeros(SIZE, np.float32), rng.normal(0, 0.02, (SIZE, FACTORS)).astype(np.float32)
    gw, gv = np.full(SIZE, 1e-4, np.float32), np.full((SIZE, FACTORS), 1e-4, np.float32)
    rate = labels.mean()
    bias = float(np.log(rate / (1 - rate)))
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            index, value = np.concatenate([rows[i][0] for i in pick]), np.concatenate([rows[i][1] for i in pick])
            sizes = np.array([len(rows[i][0]) for i in pick])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            raw, total = _sums(index, value, starts, w, v)
            error = (logistic(bias + raw) - labels[pick]).astype(np.float32)
            each = np.repeat(error, sizes) * value
            step = each[:, None] * (np.repeat(total, sizes, axis=0) - v[index] * value[:, None])
            used, place = np.unique(index, return_inverse=True)
            dw = np.bincount(place, each, len(used)).astype(np.float32) + RIDGE * w[used]
            dv = np.stack([np.bincount(place, step[:, f], len(used)) for f in range(FACTORS)], 1).astype(np.float32) + RIDGE * v[used]
            gw[used] += dw**2
            gv[used] += dv**2
            w[used] -= RATE * dw / np.sqrt(gw[used])
            v[used] -= RATE * dv / np.sqrt(gv[used])
            bias -= RATE * float(error.mean())
    return bias, w, v


def _inputs(docs: DataFrame, *carry: str) -> DataFrame:
    n_chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return small_batches(docs).select(*carry, "text", n_chars.alias("n_chars"))


def train_classes(docs: DataFrame, labelled: DataFrame, n_classes: int, train_rows: int = TRAIN_ROWS) -> list:
    """One model per class of ``labelled(doc_id, class)``, each against the rest; None for a class that all rows or none have."""
    n = labelled.count()
    drawn = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(n, train_rows))) < train_rows)
    rows = _inputs(docs, "doc_id").join(F.broadcast(drawn), "doc_id").select("class", "text", "n_chars")  # bounded by train_rows

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            made = [features(t or "", c) for t, c in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
            yield pa.record_batch([part.column(0).cast(pa.int32()), pa.array([i.tobytes() for i, _ in made], pa.binary()), pa.array([x.tobytes() for _, x in made], pa.binary())], names=["class", "i", "x"])

    def learn(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["i", "x", "class"])  # so that the fit does not hang on the rows' order
        y = (pdf["class"] == key[0]).to_numpy().astype(np.float32)
        if not 0 < y.mean() < 1:
            return pd.DataFrame({"class": [], "bias": [], "w": [], "v": []})
        made = [(np.frombuffer(i, np.int32), np.frombuffer(x, np.float32)) for i, x in zip(pdf.i, pdf.x, strict=True)]
        bias, w, v = fit(made, y)
        return pd.DataFrame({"class": [key[0]], "bias": [bias], "w": [w.tobytes()], "v": [v.tobytes()]})

    made = rows.mapInArrow(featurise, "class int, i binary, x binary")
    wanted = F.array(*(F.lit(c) for c in range(n_classes))) if n_classes > 2 else F.array(F.lit(1))
    got = made.withColumn("target", F.explode(wanted)).groupBy("target").applyInPandas(learn, "class int, bias double, w binary, v binary").collect()
    by = {r["class"]: (r.bias, np.frombuffer(r.w, np.float32), np.frombuffer(r.v, np.float32).reshape(SIZE, FACTORS)) for r in got}
    return [by.get(c) for c in range(n_classes)]


def least_label(labels: DataFrame, column: str) -> DataFrame:
    """One label per document: the least of those that are not null."""
    return labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(column).alias(column))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS):
    """Fit on labelled documents ``labels(doc_id, quality)``; None without both kinds of label."""
    known = least_label(labels, "quality").select("doc_id", (F.col("quality") > 0).cast("int").alias("class"))
    return train_classes(docs, known, 2, train_rows)[1]


def score_batch(part: pa.RecordBatch, models: list) -> list[np.ndarray]:
    """Per model the scores of a batch with ``text`` and ``n_chars``; the features are made once."""
    made = [features(t or "", c) for t, c in zip(part.column("text").to_pylist(), part.column("n_chars").to_pylist(), strict=True)]
    starts = np.concatenate([[0], np.cumsum([len(i) for i, _ in made])[:-1]])
    index, value = np.concatenate([i for i, _ in made]), np.concatenate([x for _, x in made])
    return [logistic(bias + _sums(index, value, starts, w, v)[0]).astype(np.float64) for bias, w, v in models]


def score(docs: DataFrame, model, *carry: str) -> DataFrame:
    """``carry`` columns and ``score`` of every document, 0 to 1."""
    inputs = _inputs(docs, *carry)
    schema = T.StructType([*inputs.select(*carry).schema, T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out = np.full(part.num_rows, 0.5) if shared.value is None else score_batch(part, [shared.value])[0]
            yield pa.record_batch([*(part.column(c) for c in carry), pa.array(out)], names=[*carry, "score"])

    return inputs.mapInArrow(run, schema)


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, in their own columns, that the classifier does not reject."""
    model = train(docs, labels)
    rows = docs.withColumn("_row", F.struct(*docs.columns))
    return score(rows, model, "_row").where("score >= 0.5").select("_row.*")


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(crc_mod("doc_id", 3) != 1))
    scored = score(docs, model, "doc_id")
    held_out = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
