"""LM scoring: an interpolated modified Kneser-Ney n-gram model, counted in Spark, memory-mapped by workers.

Counting: tasks sort their n-grams and send them by the hash range ("shard") of the word before the last.  The
contexts of all orders end in that word, so one shard has all it takes for its contexts: it becomes, per order,
one sorted hash array of n-grams with counts (of the highest order occurrences, of the others distinct words to
the left) and one of contexts with their sums.  What each word contributes as a continuation (occurrences,
distinct predecessors) goes to the word's own shard, where the sorted array of words is made.  Shards are files
in the folder that driver and executors share; workers map them and look up sorted queries, so memory does
not grow with the model.  If that folder is not a local mount, a worker fetches a shard to its own disk, maps
it and unlinks it.

Modified Kneser-Ney: three discounts per order from the counts of counts; each order is interpolated with the
one below, the lowest is that of continuations, and those are interpolated with the uniform distribution over
the known words and one unknown.  Words are 56-bit hashes (the shard's bits above them come from the same
hash); of ``V`` distinct words about ``V * V / 2**57`` pairs collide and count as one (under 1e-5 for a
million).  N-grams are 48-bit keys within a shard: one that was never seen is taken for one of the shard's ``G``
with a probability of ``G / 2**48`` (under 1e-8 for a million).

Defined cases: a null or empty text is one end token; repeated rows train and are scored as often as they
occur; a null id trains (it has no remainder); without training rows every probability is uniform over
one unknown word; counts of counts that are zero give the discounts 0.5, 1, 1.5; ties do not arise; an
empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, keep, shared_dir, shuffle_partitions, slices, table
from .near_dedup import mix, word_hashes

ORDER, FLUSH_TOKENS = 2, 2_000_000
#: Shards a shuffle partition, so that partitions come out even.
SHARDS = 2
#: Bytes of training text that a shard may come from, of n-grams and of words: a task holds one, so their number grows with the input.
GRAM_BYTES, WORD_BYTES = 16 << 20, 32 << 20


def shard_bits(n_bytes: int, partitions: int) -> tuple[int, int]:
    """Bits that tell the shards of n-grams, and those of words.

    Words are few beside n-grams and have fewer shards, so that what shards of n-grams send to them stays few rows.
    """
    least = lambda n: max(1, math.ceil(math.log2(max(1, n))))
    bits = max(least(SHARDS * partitions), least(n_bytes / GRAM_BYTES))
    return bits, min(bits, max(bits // 2 + 1, least(n_bytes / WORD_BYTES)))


BEGIN, END = np.uint64(0x0123456789ABCDEF << 8 & (1 << 64) - 1), np.uint64(0xFEDCBA9876543210)
_LOW = np.uint64(8)
_JOIN = np.uint64(0x9E3779B97F4A7C15)
GRAMS = "shard int, before binary, runs binary, others array<binary>, counts binary"
WORDS = "shard int, kind int, words binary, numbers binary, totals array<long>"
TOTALS = "kind int, totals array<long>"


def context_hash(words: list[np.ndarray]) -> np.ndarray:
    """The hash of a context, nearest word first."""
    h = words[0]
    for w in words[1:]:
        h = mix(h * _JOIN + w)
    return h


def joint(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The key of an n-gram inside the shard of the word before its last: 48 bits."""
    return mix(context * _JOIN + word) >> np.uint64(16)


def token_hashes(text: str) -> np.ndarray:
    """Words of a text, then the end; the low bits are cut."""
    words = np.append(word_hashes(text), END)
    return words >> _LOW << _LOW


def _pack(a: np.ndarray) -> bytes:
    """56-bit hashes in seven bytes each."""
    return a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 1:].tobytes()


def _unpack(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 7, 8), np.uint8)
    out[:, 1:] = np.frombuffer(b, np.uint8).reshape(-1, 7)
    return out.reshape(-1).view("<u8")


def _put(folder: str, name: str, parts: list[np.ndarray]) -> None:
    """Write arrays as one file, whole or not at all: a retried task replaces it by the same."""
    store, path = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    store.create_dir(path, recursive=True)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        f.write(np.array([len(parts), *(x for p in parts for x in (len(p), p.dtype.itemsize))], "<i8").tobytes())
        for p in parts:
            f.write(p.tobytes())
    store.move(part, f"{path}/{name}")


@lru_cache(maxsize=4096)
def _get(folder: str, name: str) -> list[np.ndarray] | None:
    """Map the arrays of a file; None if no word or bigram fell into the shard."""
    store, path = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    path = f"{path}/{name}"
    if store.get_file_info(path).type == fs.FileType.NotFound:
        return None
    if isinstance(store, fs.LocalFileSystem):
        data = np.memmap(path, np.uint8, "r")
    else:
        with tempfile.NamedTemporaryFile() as local:
            fs.copy_files(path, local.name, source_filesystem=store, destination_filesystem=fs.LocalFileSystem())
            data = np.memmap(local.name, np.uint8, "r")
    n = int(data[:8].view("<i8")[0])
    sizes = data[8 : 8 + 16 * n].view("<i8").reshape(n, 2)
    out, at = [], 8 + 16 * n
    for length, width in sizes.tolist():
        out.append(data[at : at + length * width].view(f"<u{width}"))
        at += length * width
    return out


def _group(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct keys in order, values summed."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])]) if len(order) else np.empty(0, bool)
    at = np.flatnonzero(new)
    return [k[at] for k in keys], [np.add.reduceat(v[order], at) if len(at) else v[:0] for v in values]


def _of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def _smallest(a: np.ndarray) -> np.ndarray:
    return a.astype(next(f"<u{w}" for w in (1, 2, 4, 8) if not len(a) or int(a.max()) < 1 << 8 * w))


class Counts:
    """The whole model: where its files are, and the sums over all of them."""

    def __init__(self, folder: str, bits: int, word_bits: int, order: int, totals: dict[int, list[int]]):
        #: Bits of a hash that tell its shard: of n-grams by the word before the last, of words by the word.
        self.folder, self.bits, self.word_bits, self.order = folder, bits, word_bits, order
        grams, words = totals.get(0, [0] * 4 * (order - 1)), totals.get(1, [0] * 7)
        #: By order, from 2 on.
        self.discounts = {k: discounts(grams[4 * (k - 2) : 4 * (k - 1)]) for k in range(2, order + 1)}
        self.tokens, self.known, self.continuations = words[:3]
        self.lower = discounts(words[3:7])
        n1, n2, _, _ = words[3:7]
        spread = self.lower[1] * n1 + self.lower[2] * n2 + self.lower[3] * (self.known - n1 - n2)
        self.uniform = (spread / self.continuations if self.continuations else 1.0) / (self.known + 1)


def discounts(of_counts: list[int]) -> np.ndarray:
    """What counts 0, 1, 2 and more lose, by Chen and Goodman's estimates."""
    n1, n2, n3, n4 = of_counts[:4]
    if not (n1 and n2 and n3 and n4):
        return np.array([0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0, *(min(max(d, 0.05 * (k + 1)), k + 1) for k, d in enumerate(raw))])


def _coded(key: np.ndarray, columns: list[np.ndarray]) -> list[np.ndarray]:
    """Sorted keys, and per key the place of its row among the distinct rows of the columns, which come last."""
    rows, code = np.unique(np.stack(columns, 1), axis=0, return_inverse=True)
    return [key, _smallest(code.reshape(-1)), rows.astype("<u4").reshape(-1)]


def _stats(n: np.ndarray) -> list[np.ndarray]:
    """What n-grams of these counts add to their context."""
    return [n, (n == 1).astype(np.int64), (n == 2).astype(np.int64), (n > 2).astype(np.int64)]


def count_model(docs: DataFrame, order: int = ORDER) -> Counts:
    """Count the n-grams of all rows and store the model in the shared folder."""
    if order < 2:
        raise ValueError("an order of 2 at least")
    spark = docs.sparkSession
    bits, word_bits = shard_bits(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0, shuffle_partitions(spark))
    shift, word_shift = np.uint64(64 - bits), np.uint64(64 - word_bits)
    folder = f"{shared_dir(spark)}/millrace-lm-{uuid.uuid4().hex}"

    def flush(columns: list[list[np.ndarray]]) -> pa.RecordBatch:
        """Columns: the word before, the last, and then the older ones, nearest first."""
        keys = [np.concatenate(c) for c in columns]
        keys, (n,) = _group(keys, [np.ones(len(keys[0]), np.int64)])
        shard = (keys[0] >> shift).astype(np.int64)
        rows = []
        for s in np.unique(shard).tolist():
            a, b = np.searchsorted(shard, (s, s + 1))
            before, runs = np.unique(keys[0][a:b], return_counts=True)
            rows.append((s, _pack(before), runs.astype("<u4").tobytes(), [_pack(k[a:b]) for k in keys[1:]], n[a:b].astype("<u4").tobytes()))
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.binary())
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["shard", "before", "runs", "others", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, n = [[] for _ in range(order)], 0
        for batch in batches:
            for text in batch.column(0):
                tokens = token_hashes(text.as_py() or "")
                padded = np.concatenate([np.full(order - 1, BEGIN), tokens])
                # the word before, the last, and what stands 2, 3 ... before the last
                for column, back in zip(columns, (1, 0, *range(2, order)), strict=True):
                    column.append(padded[order - 1 - back : len(padded) - back])
                n += len(tokens)
                if n >= FLUSH_TOKENS:
                    yield flush(columns)
                    columns, n = [[] for _ in range(order)], 0
        if n:
            yield flush(columns)

    def contexts(group: pa.Table) -> pa.Table:
        """One shard of n-grams: its file, and rows for the shards of words."""
        read = lambda c: group.column(c).to_pylist()
        v = np.concatenate([np.repeat(_unpack(f), np.frombuffer(r, "<u4")) for f, r in zip(read("before"), read("runs"), strict=True)])
        others = read("others")
        w, *older = (np.concatenate([_unpack(o[k]) for o in others]) for k in range(order - 1))
        n = np.concatenate([np.frombuffer(c, "<u4").astype(np.int64) for c in read("counts")])
        (v, w, *older), (raw,) = _group([v, w, *older], [n])
        count, files, of_counts = raw, [], []
        for k in range(order, 1, -1):
            context = context_hash([v, *older])
            key = joint(context, w)
            place = np.argsort(key)
            own = [(key[place] >> np.uint64(16)).astype("<u4"), (key[place] & np.uint64(0xFFFF)).astype("<u2"), _smallest(count[place])]
            if k > 2:
                (context,), sums = _group([context >> np.uint64(16)], _stats(count))
                own += _coded(context, sums)
                files = own + files
                of_counts = _of_counts(count) + of_counts
                # the order below counts distinct words to the left
                (v, w, *older), (raw, count) = _group([v, w, *older[:-1]], [raw, np.ones(len(raw), np.int64)])
        number = group.column("shard")[0].as_py()
        _put(folder, f"grams-{number}", own + files)
        (first,), stats = _group([v], _stats(count))
        (second,), more = _group([w], [raw, np.ones(len(raw), np.int64)])
        rows = [(number >> bits - word_bits, 0, _pack(first), np.stack(stats, 1).astype("<u4").tobytes(), _of_counts(count) + of_counts)]
        shard = (second >> word_shift).astype(np.int64)
        for s in np.unique(shard).tolist():
            a, b = np.searchsorted(shard, (s, s + 1))
            rows.append((s, 1, _pack(second[a:b]), np.stack([x[a:b] for x in more], 1).astype("<u4").tobytes(), None))
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["shard", "kind", "words", "numbers", "totals"])

    def words(group: pa.Table) -> pa.Table:
        """One shard of words: occurrences, predecessors, and the sums and counts of counts as a context."""
        rows = list(zip(*(group.column(c).to_pylist() for c in ("kind", "words", "numbers", "totals")), strict=True))
        keys, numbers = [], []
        for kind, own, given, _ in rows:
            keys.append(_unpack(own))
            wide = np.zeros((len(keys[-1]), 6), np.int64)
            wide[:, slice(2, 6) if kind == 0 else slice(0, 2)] = np.frombuffer(given, "<u4").reshape(len(wide), -1)
            numbers.append(wide)
        wide = np.concatenate(numbers)
        (key,), columns = _group([np.concatenate(keys)], [wide[:, k] for k in range(6)])
        _put(folder, f"words-{group.column('shard')[0].as_py()}", _coded(key, columns))
        seen, before = columns[0], columns[1]
        totals = [[0, t] for kind, _, _, t in rows if kind == 0]
        totals.append([1, [int(seen.sum()), int((seen > 0).sum()), int(before.sum()), *_of_counts(before)]])
        return pa.table([pa.array([t[0] for t in totals], pa.int32()), pa.array([t[1] for t in totals], pa.list_(pa.int64()))], names=["kind", "totals"])

    grams = docs.select("text").mapInArrow(count, GRAMS)
    made = grams.groupBy("shard").applyInArrow(contexts, WORDS).groupBy("shard").applyInArrow(words, TOTALS)
    places = F.posexplode("totals").alias("place", "n")
    sums = keep(made, "lm-totals").select("kind", places).groupBy("kind", "place").agg(F.sum("n").alias("n")).orderBy("kind", "place").collect()
    return Counts(folder, bits, word_bits, order, {k: [r.n for r in sums if r.kind == k] for k in {r.kind for r in sums}})


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted key, and whether it is there."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Scorer:
    """Look up words and bigrams of a batch in the mapped shards."""

    def __init__(self, model: Counts):
        self.m = model

    def _by_shard(self, hashes: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
        """Runs of sorted hashes that share a shard."""
        shard = (hashes >> np.uint64(64 - bits)).astype(np.int64)
        for s in np.unique(shard).tolist():
            yield s, slice(*np.searchsorted(shard, (s, s + 1)))

    def words(self, hashes: np.ndarray) -> np.ndarray:
        """Per sorted distinct word: occurrences, predecessors, context total, and distinct followers found once, twice, more."""
        out = np.zeros((len(hashes), 6), np.int64)
        for s, part in self._by_shard(hashes, self.m.word_bits):
            if got := _get(self.m.folder, f"words-{s}"):
                keys, code, rows = got
                at, there = _find(keys, hashes[part])
                out[part][there] = rows.reshape(-1, 6)[code[at[there]]]
        return out

    def grams(self, k: int, before: np.ndarray, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of n-grams of order ``k``, sorted by the word before the last: the counts and, above 2, the sums of their contexts."""
        out, sums = np.zeros(len(before), np.int64), np.zeros((len(before), 4 if k > 2 else 0), np.int64)
        at_file = 0 if k == 2 else 3 + 6 * (k - 3)
        for s, part in self._by_shard(before, self.m.bits):
            if got := _get(self.m.folder, f"grams-{s}"):
                high, low, counts = got[at_file : at_file + 3]
                key = joint(context[part], word[part])
                order = np.argsort(key)
                top, rest = (key[order] >> np.uint64(16)).astype(np.uint32), (key[order] & np.uint64(0xFFFF)).astype(np.uint16)
                at, stop = np.searchsorted(high, top), np.searchsorted(high, top, side="right")
                found = np.zeros(len(at), np.int64)
                while (open_ := at < stop).any():  # equal high halves are few
                    i = np.flatnonzero(open_)
                    hit = low[at[i]] == rest[i]
                    found[i[hit]] = counts[at[i[hit]]]
                    at[i] += 1
                back = np.empty_like(found)
                back[order] = found
                out[part] = back
                if k > 2:
                    keys, code, rows = got[at_file + 3 : at_file + 6]
                    at, there = _find(keys, context[part] >> np.uint64(16))
                    sums[part][there] = rows.reshape(-1, 4)[code[at[there]]]
        return out, sums

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per text: tokens, known tokens, base score and the model's score (log10)."""
        m = self.m
        tokens = [token_hashes(t) for t in texts]
        sizes = np.array([len(t) for t in tokens])
        starts = np.cumsum(sizes) - sizes
        last = np.concatenate(tokens)
        place_in_text = np.arange(len(last)) - np.repeat(starts, sizes)
        older = []  # what stands 1, 2 ... before each token
        for back in range(1, m.order):
            own = np.concatenate([np.full(back, BEGIN), last[:-back]])
            older.append(np.where(place_in_text >= back, own, BEGIN))
        word, place = np.unique(np.concatenate([last, [BEGIN]]), return_inverse=True)
        known = self.words(word)
        w, v = place[:-1], np.searchsorted(word, older[0])
        pair, of_pair = np.unique(v.astype(np.int64) * len(word) + w, return_inverse=True)
        v, w = pair // len(word), pair % len(word)
        count, _ = self.grams(2, word[v], word[v], word[w])
        lower = np.maximum(known[:, 1] - m.lower[np.minimum(known[:, 1], 3)], 0) / max(1, m.continuations) + m.uniform
        p = _interpolated(count, known[v, 2:], m.discounts[2], lower[w])[of_pair]
        for k in range(3, m.order + 1):
            order = np.argsort(older[0], kind="stable")
            context = context_hash([o[order] for o in older[: k - 1]])
            count, sums = self.grams(k, older[0][order], context, last[order])
            p[order] = _interpolated(count, sums, m.discounts[k], p[order])
        seen = known[place[:-1], 0]
        base = np.log10((seen + 0.1) / (m.tokens + 0.1 * (m.known + 1)))
        return sizes, np.add.reduceat((seen > 0).astype(np.int64), starts), np.add.reduceat(base, starts), np.add.reduceat(np.log10(p), starts)


def _interpolated(count: np.ndarray, sums: np.ndarray, discount: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """The probability of an order from its counts, its contexts' sums (total, found once, twice, more) and the order below."""
    total = sums[:, 0]
    weight = np.where(total > 0, (sums[:, 1:] * discount[1:]).sum(1) / np.maximum(total, 1), 1.0)
    return np.where(total > 0, np.maximum(count - discount[np.minimum(count, 3)], 0) / np.maximum(total, 1), 0.0) + weight * lower


SCORES = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def score_texts(docs: DataFrame, model: Counts) -> DataFrame:
    """Every text under the model; perplexity is per token, the end included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for part in slices(batches, 1024):
            n, known, base, score = scorer.score([t or "" for t in part.column(1).to_pylist()])
            yield pa.record_batch([part.column(0), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(n), model.tokens), pa.int64()), pa.array(base), pa.array(score), pa.array(10 ** (-score / n))], names=[f.split()[0] for f in SCORES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCORES)


def op4_scores(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod("doc_id", 10) == 0, F.lit(False))
    model = count_model(docs.where(~held_out))
    scored = score_texts(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
