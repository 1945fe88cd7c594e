"""Importance resampling towards a target distribution.

Features are hashed runs of words, counted over all documents and over all texts of the target.  The logarithm of
how much commoner a bucket is in the target is its gain; the gains, an array of fixed size, score every text, and
Gumbel noise by the document's id turns "the highest scores" into a draw without replacement.

The draw is an external merge.  Eligible rows, sorted, are written as runs: each partition's run is cut into blocks at
set scores (the slices' bounds, quantiles of the scores drawn) and every ``BLOCK`` rows.  A task merges the runs of a
slice: blocks come to it in the order of their first rows, are opened when the merge reaches them and closed when used
up, and a tournament tree over the open ones names the next row.  A slice's first rank is the number of rows in the
slices above it, and the merge stops after the exact count of the draw.  Nothing below the last slice is written or sorted.
A slice is about ``SLICE_ROWS`` rows at any size of the input, unless more rows share one score; it streams then.

Defined cases: a null or empty text has no feature and the weight 0; a null id counts as an empty one in the noise and
comes first among equal scores; rows of equal score and id are in the order of their number of features; repeated rows
are drawn each for itself; an empty table gives no row, an empty target a gain for every bucket all the same; other
columns are carried if named and ignored otherwise.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CACHED_WORDS, keep, slices, small_batches, table

BUCKETS, ORDER, SEED = 10_000, 1, 2024
#: A document is eligible from so many words on; so many in so many of the eligible are drawn.
MIN_WORDS, SHARE = 20, (10, 100)
SLICE_ROWS, BLOCK, ACCURACY = 1 << 14, 1 << 8, 1 << 16

#: Bytes that are in words stay, A-Z in lower case; all others become blanks.
_WORDS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


class _Buckets(dict):
    """Feature to bucket; a worker remembers the first ``CACHED_WORDS``."""

    def __missing__(self, feature: bytes) -> int:
        bucket = zlib.crc32(feature) % BUCKETS
        if len(self) < CACHED_WORDS:
            self[feature] = bucket
        return bucket


_BUCKET = _Buckets()


def feature_buckets(text: bytes, order: int = ORDER) -> tuple[int, np.ndarray]:
    """The number of words, and the bucket of every run of 1 to ``order`` words."""
    words = text.translate(_WORDS).split()
    features, runs = [*words], words
    for _ in range(1, min(order, len(words))):
        runs = [b" ".join(pair) for pair in zip(runs, words[len(words) - len(runs) + 1 :])]  # noqa: B905
        features += runs
    return len(words), np.fromiter(map(_BUCKET.__getitem__, features), np.int64, len(features))


def bucket_counts(texts: DataFrame, text: str = "text", order: int = ORDER) -> np.ndarray:
    """Features per bucket over all rows; each task sends its sums, and what comes back is of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for part in slices(batches):
            for t in part.column(0).to_pylist():
                total += np.bincount(feature_buckets(t, order)[1], minlength=BUCKETS) if t else 0
        there = np.flatnonzero(total)
        yield pa.record_batch([pa.array(there), pa.array(total[there])], names=["bucket", "n"])

    counted = small_batches(texts).select(F.encode(text, "UTF-8").alias("t")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for row in counted.collect():  # BUCKETS rows at most
        out[row.bucket] = row.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed share in the target to that in the source."""
    s, t = float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((y + 1.0) * (s + BUCKETS) / ((x + 1.0) * (t + BUCKETS)))) for x, y in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Thousandths of a Gumbel variate that hangs on the id alone."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, gain: np.ndarray, *carry: str, order: int = ORDER, seed: int = SEED) -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score)`` and ``carry`` of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # of fixed size
    inputs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "UTF-8").alias("text"), *carry)
    names = ["doc_id", "n_words", "n_features", "weight", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            ids, made = part.column(0).to_pylist(), []
            for doc_id, t in zip(ids, part.column(1).to_pylist(), strict=True):
                n, found = feature_buckets(t or b"", order)
                weight = int(shared.value[found].sum())
                made.append((n, len(found), weight, weight + noise(doc_id, seed)))
            columns = zip(*made, strict=True) if made else [()] * 4
            yield pa.record_batch([part.column(0), *(pa.array(c, pa.int64()) for c in columns), *(part.column(c) for c in carry)], names=[*names, *carry])

    return inputs.mapInArrow(run, T.StructType([*(T.StructField(n, T.LongType()) for n in names), *inputs.select(*carry).schema]))


class Tournament:
    """A winner tree over open blocks: ``win()`` is the leaf with the least key, found by one walk up per change."""

    LAST = (2,)  # after every key of an open leaf

    def __init__(self) -> None:
        self.size, self.keys, self.free = 1, [self.LAST], [0]
        self.tree = [0, 0]

    def _play(self, node: int) -> None:
        a, b = self.tree[2 * node], self.tree[2 * node + 1]
        self.tree[node] = a if self.keys[a] <= self.keys[b] else b

    def put(self, leaf: int, key: tuple | None) -> None:
        """Change a leaf's key; without one it is free again."""
        self.keys[leaf] = key or self.LAST
        if key is None:
            self.free.append(leaf)
        node = (self.size + leaf) // 2
        while node:
            self._play(node)
            node //= 2

    def add(self, key: tuple) -> int:
        if not self.free:  # twice the leaves, all games anew
            self.free = [*range(2 * self.size - 1, self.size - 1, -1)]
            self.keys += [self.LAST] * self.size
            self.size *= 2
            self.tree = [0] * self.size + [*range(self.size)]
            for node in range(self.size - 1, 0, -1):
                self._play(node)
        leaf = self.free.pop()
        self.put(leaf, key)
        return leaf

    def win(self) -> int | None:
        leaf = self.tree[1]
        return None if self.keys[leaf] is self.LAST else leaf


def _key(row: dict) -> tuple:
    return (1, -row["score"], row["doc_id"] is not None, row["doc_id"] or 0, row["n_features"])


def merged(blocks: Iterator[list[dict]], rank: int, draw: int) -> Iterator[tuple[dict, int | None]]:
    """The rows of sorted blocks, which come in the order of their first rows, merged and numbered from ``rank`` + 1.

    A block per run at most is open at a time.  The merge stops at ``draw``; rows beyond it have no number and are in no order.
    """
    tree, opened, place = Tournament(), {}, {}
    coming = next(blocks, None)
    while rank < draw:
        leaf = tree.win()
        while coming is not None and (leaf is None or _key(coming[0]) <= tree.keys[leaf]):
            new = tree.add(_key(coming[0]))
            opened[new], place[new] = coming, 0
            coming, leaf = next(blocks, None), tree.win()
        if leaf is None:
            return
        own, rank = opened[leaf], rank + 1
        yield own[place[leaf]], rank
        place[leaf] += 1
        done = place[leaf] == len(own)
        tree.put(leaf, None if done else _key(own[place[leaf]]))
        if done:
            del opened[leaf], place[leaf]
    for leaf, own in opened.items():
        yield from ((row, None) for row in own[place[leaf] :])
    while coming is not None:
        yield from ((row, None) for row in coming)
        coming = next(blocks, None)


def _runs(ordered: DataFrame, bounds: np.ndarray) -> DataFrame:
    """``(slice, head, rows)``: every partition's sorted rows as blocks that no slice's bound cuts; ``bounds`` fall."""
    entry = T.StructType(ordered.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.searchsorted(-bounds, -batch.column("score").to_numpy(), side="left")
            begins = np.union1d(np.flatnonzero(np.diff(own)) + 1, np.arange(0, batch.num_rows, BLOCK))
            rows = pa.StructArray.from_arrays(batch.columns, names=batch.schema.names)
            heads = [batch.column(c).take(pa.array(begins)) for c in ("score", "doc_id", "n_features")]
            lists = pa.ListArray.from_arrays(pa.array([*begins, batch.num_rows], pa.int32()), rows)
            yield pa.record_batch([pa.array(own[begins].astype(np.int64)), *heads, lists], names=["slice", "score", "doc_id", "n_features", "rows"])

    schema = T.StructType([*(T.StructField(n, T.LongType()) for n in ("slice", "score", "doc_id", "n_features")), T.StructField("rows", T.ArrayType(entry))])
    return ordered.mapInArrow(run, schema)


def _merge(runs: DataFrame, first: dict[int, int], draw: int) -> DataFrame:
    """The rows of all runs, those drawn with their rank; ``first`` is the number of rows above a slice."""
    by_slice = runs.repartition("slice").sortWithinPartitions("slice", F.desc("score"), F.asc_nulls_first("doc_id"), "n_features")
    entry = runs.schema["rows"].dataType.elementType
    out = T.StructType([*entry.fields, T.StructField("rank", T.LongType())])
    shared = runs.sparkSession.sparkContext.broadcast(first)  # a number per slice of those drawn

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, made = None, []

        def blocks() -> Iterator[tuple[int, list[dict]]]:
            nonlocal kind
            for batch in batches:
                lists = batch.column("rows")
                kind = lists.type.value_type
                for at, own in enumerate(batch.column("slice").to_pylist()):
                    yield own, lists[at].as_py()

        def packed() -> pa.RecordBatch:
            whole, ranks = pa.array([r for r, _ in made], kind), pa.array([n for _, n in made], pa.int64())
            made.clear()
            return pa.record_batch([*whole.flatten(), ranks], names=[*(kind.field(i).name for i in range(kind.num_fields)), "rank"])

        for own, group in itertools.groupby(blocks(), key=lambda b: b[0]):
            for pair in merged((rows for _, rows in group), shared.value[own], draw):
                made.append(pair)
                if len(made) == 1 << 12:
                    yield packed()
        if made:
            yield packed()

    return by_slice.mapInArrow(run, out)


def with_ranks(scored: DataFrame, eligible: Column, share: tuple[int, int] = SHARE) -> DataFrame:
    """``scored`` (a table that can be read again) with ``rank``: 1, 2, 3 ... for the highest scores of the eligible, else null.

    ``share`` (of the eligible, rounded down) are drawn: equal scores by id.
    """
    able, none = scored.where(eligible), F.lit(None).cast("long")
    n = able.count()
    draw = share[0] * n // share[1]
    if not draw:
        return scored.withColumn("rank", none)
    # bounds of the slices from above; the last one lies so far below the draw that the quantiles' error does not matter
    least = (draw + SLICE_ROWS / 4) / n + 4 / ACCURACY
    shares = [1 - x for x in (*(SLICE_ROWS * k / n for k in range(1, draw // SLICE_ROWS + 1)), least) if x < 1]
    found = able.agg(F.percentile_approx("score", F.array(*map(F.lit, shares)), ACCURACY)).first()[0] if shares else []
    bounds = np.array(sorted(set(found), reverse=True), np.int64)
    for floor in ([int(bounds[-1])] if least < 1 else []) + [None]:
        there = eligible if floor is None else eligible & (F.col("score") >= floor)
        ordered = scored.where(there).sortWithinPartitions(F.desc("score"), F.asc_nulls_first("doc_id"), "n_features")
        runs = keep(_runs(ordered, bounds), "runs")
        sizes = {r.slice: r.n for r in runs.groupBy("slice").agg(F.sum(F.size("rows")).alias("n")).collect()}  # a row per slice
        if sum(sizes.values()) >= draw:
            break
    order = sorted(sizes)
    first = dict(zip(order, np.cumsum([0, *(sizes[k] for k in order)]).tolist(), strict=False))
    return _merge(runs, first, draw).unionByName(scored.where(~there).withColumn("rank", none))


def importance(docs: DataFrame, target: DataFrame, *carry: str, order: int = ORDER, seed: int = SEED) -> DataFrame:
    """Every document with ``n_words``, ``n_features``, ``weight`` and ``score`` against the texts of ``target``, as a kept table."""
    gain = gains(bucket_counts(docs, order=order), bucket_counts(target, order=order))
    return keep(scores(docs, gain, *carry, order=order, seed=seed), "scores")


def resampled(docs: DataFrame, target: DataFrame, share: tuple[int, int] = SHARE, min_words: int = MIN_WORDS, order: int = ORDER, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that are drawn, in their own columns, with ``_score`` and ``_rank``."""
    rows = docs.withColumn("_row", F.struct(*docs.columns))
    ranked = with_ranks(importance(rows, target, "_row", order=order, seed=seed), F.col("n_words") >= min_words, share)
    return ranked.where("rank IS NOT NULL").select("_row.*", F.col("score").alias("_score"), F.col("rank").alias("_rank"))


def op11_resampling(spark, sf_dir: str) -> DataFrame:
    scored = importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return with_ranks(scored, F.col("n_words") >= MIN_WORDS).select("doc_id", "n_features", "weight", "score", "rank")
