"""Token counts: pieces counted once per distinct pre-token, joined to per-document frequencies, summed.

Pre-tokens are the tokenizer's own: what its normaliser and pre-tokenizer make of a text.  Texts are taken in
blocks.  A block's texts are first cut at ASCII white space, which no pre-token of a supported tokenizer spans,
and each distinct run is split by the library once.  Per block and hash bucket of pre-tokens, one row holds the
distinct pre-tokens and their (document, frequency) postings.  Rows meet by bucket and stream through it:
every distinct pre-token is counted once, whatever the number of blocks that have it, and only the
distinct ones of the bucket are held.  What goes back is one partial sum per document, added up by block.
No ids are materialised and no key is hotter than one row per block.

A run that holds an added token (a special string) is a unit of its own, counted by the whole tokenizer.
Tokenizers whose pre-tokens may span white space, or that truncate or pad, are refused (``check_splits``).

Defined cases: null or empty text counts 0 tokens and 0 bytes; repeated rows and null ids are rows of
their own; ties do not arise; an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, table
from .tokenizers_io import load_json

BLOCK_DOCS, BLOCK_CHARS = 4096, 1 << 23
POSTINGS = "bucket int, block long, n_docs int, doc_ids array<long>, n_bytes array<long>, tokens array<string>, counts binary, docs binary, freqs binary"
PARTIALS = "block long, n_docs int, doc_ids array<long>, n_bytes array<long>, sums binary"
#: White space that str.split() knows besides the ASCII kind.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_ASCII_SPACE = re.compile("[ \t\n\r\x0b\x0c]+")


class _Ids(dict):
    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


#: Before the text of a run that is counted whole; no byte-level pre-token has a blank.
_WHOLE = " "


def runs(text: str) -> list[str]:
    """What stands between ASCII white space."""
    return [x for x in _ASCII_SPACE.split(text) if x] if _ODD_SPACE.search(text) else text.split()


def check_splits(tokenizer: str) -> None:
    """Refuse a tokenizer whose counts are not sums over runs between white space."""
    told = json.loads(load_json(tokenizer).to_str())
    steps = (told["pre_tokenizer"] or {}).get("pretokenizers") or [told["pre_tokenizer"] or {}]
    normal = told["normalizer"] or {}
    plain = {"NFC", "Lowercase", "Replace"} >= {n["type"] for n in normal.get("normalizers", [normal] if normal else [])}
    drops = steps[0].get("type") == "Split" and steps[0]["behavior"] == "Removed" and steps[0]["invert"]
    kinds = drops and steps[0]["pattern"].get("Regex", "").split("|")[-1].startswith("[^\\s")
    if not (plain and drops and kinds) or told["truncation"] or told["padding"]:
        raise ValueError(f"{tokenizer}: its pre-tokens may span white space, or it truncates or pads")


class Pretokens:
    """The library's pre-tokens of runs, many runs at a time."""

    def __init__(self, tokenizer: str, at_once: int = 4096):
        self.tok, self.at_once = load_json(tokenizer), at_once
        added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None

    def _of(self, text: str) -> tuple[str, list[tuple[str, tuple[int, int]]]]:
        normal = self.tok.normalizer.normalize_str(text)
        return normal, self.tok.pre_tokenizer.pre_tokenize_str(normal)

    def __call__(self, own: list[str]) -> list[list[str]]:
        out: list[list[str]] = [[] for _ in own]
        special = {i for i, r in enumerate(own) if self.added and self.added.search(r)}
        alone = [i for i, r in enumerate(own) if i not in special and _ODD_SPACE.search(r)]
        single = special.union(alone)
        together = [i for i in range(len(own)) if i not in single] if single else list(range(len(own)))
        for i in special:
            out[i] = [_WHOLE + own[i]]
        for at in range(0, len(together), self.at_once):
            part = together[at : at + self.at_once]
            normal, found = self._of("\n".join(own[i] for i in part))
            begins = np.cumsum([0, *(len(x) + 1 for x in normal.split(" "))])[:-1]
            if len(begins) != len(part):  # the normaliser made white space: each by itself
                alone += part
                continue
            for (token, _), k in zip(found, np.searchsorted(begins, [o[0] for _, o in found], side="right").tolist(), strict=True):
                out[part[k - 1]].append(token)
        for i in alone:
            out[i] = [t for t, _ in self._of(own[i])[1]]
        return out


class Pieces(dict):
    """How many pieces each pre-token has, counted once."""

    def __init__(self, tokenizer: str):
        super().__init__()
        self.tok = load_json(tokenizer)

    def __missing__(self, pretoken: str) -> int:
        if pretoken.startswith(_WHOLE):
            n = len(self.tok.encode(pretoken[len(_WHOLE) :], add_special_tokens=False).ids)
        else:
            n = len(self.tok.model.tokenize(pretoken))
        self[pretoken] = n
        return n


def _smallest(a: np.ndarray) -> bytes:
    """An unsigned array in as few bytes as its maximum needs, the width first."""
    width = next(w for w in (1, 2, 4, 8) if not len(a) or int(a.max()) < 1 << 8 * w)
    return bytes((width,)) + a.astype(f"<u{width}").tobytes()


def _unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"<u{b[0]}", offset=1).astype(np.int64)


def _block_rows(block: int, ids: list, texts: list[str], buckets: int, split: Pretokens) -> pa.RecordBatch:
    """The postings of one block of texts, a row per bucket in use; the first also has the documents."""
    run_ids, owner, chunks = _Ids(), [], []
    for text in texts:
        own = runs(text)
        owner.append(len(own))
        chunks.append(np.fromiter(map(run_ids.__getitem__, own), np.int64, len(own)))
    word = np.concatenate(chunks)
    # postings of runs, then of the pre-tokens that each run is made of
    pairs, freq = np.unique(word << 32 | np.repeat(np.arange(len(texts)), owner), return_counts=True)
    vocab = _Ids()
    made = [[vocab[t] for t in tokens] for tokens in split(list(run_ids))]
    n_made = np.fromiter(map(len, made), np.int64, len(made))
    flat, first = np.fromiter((t for own in made for t in own), np.int64, int(n_made.sum())), np.cumsum(n_made) - n_made
    each = n_made[pairs >> 32]
    place = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    token, doc = flat[np.repeat(first[pairs >> 32], each) + place], np.repeat(pairs & 0xFFFFFFFF, each)
    tokens = np.array(list(vocab), dtype=object)
    bucket = np.fromiter((zlib.crc32(t.encode()) % buckets for t in vocab), np.int64, len(vocab))
    order = np.argsort(bucket, kind="stable")
    rank = np.empty(len(vocab), np.int64)
    rank[order] = np.arange(len(vocab))
    pairs, at = np.unique(rank[token] << 32 | doc, return_inverse=True)
    freq = np.bincount(at, np.repeat(freq, each), len(pairs)).astype(np.int64)
    token_of, doc_of = pairs >> 32, pairs & 0xFFFFFFFF
    used, start = np.unique(bucket[order], return_index=True)
    stop = np.append(start[1:], len(vocab))
    sizes = [len(t.encode()) for t in texts]
    rows = []
    for b, lo, hi in zip(used.tolist(), start.tolist(), stop.tolist(), strict=True):
        i, j = np.searchsorted(token_of, (lo, hi))
        counts = np.bincount(token_of[i:j] - lo, minlength=hi - lo)
        rows.append((b, tokens[order[lo:hi]].tolist(), _smallest(counts), _smallest(doc_of[i:j]), _smallest(freq[i:j])))
    rows = rows or [(0, [], _smallest(word), _smallest(word), _smallest(word))]
    n = len(rows)
    return pa.record_batch([
        pa.array([r[0] for r in rows], pa.int32()), pa.array([block] * n, pa.int64()), pa.array([len(texts)] * n, pa.int32()),
        pa.array([ids] + [None] * (n - 1), pa.list_(pa.int64())), pa.array([sizes] + [None] * (n - 1), pa.list_(pa.int64())),
        pa.array([r[1] for r in rows], pa.list_(pa.string())), *(pa.array([r[k] for r in rows], pa.binary()) for k in (2, 3, 4)),
    ], names=[f.split()[0] for f in POSTINGS.split(", ")])


def pretoken_postings(docs: DataFrame, buckets: int, tokenizer: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Pretokens(tokenizer)
        block, chars, ids, texts = TaskContext.get().partitionId() << 32, 0, [], []
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                ids.append(i)
                texts.append(text)
                chars += len(text)
                if len(texts) >= BLOCK_DOCS or chars >= BLOCK_CHARS:
                    yield _block_rows(block, ids, texts, buckets, split)
                    block, chars, ids, texts = block + 1, 0, [], []
        if texts:
            yield _block_rows(block, ids, texts, buckets, split)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, POSTINGS)


def token_counts(docs: DataFrame, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """``(doc_id, text)`` to ``(doc_id, n_bytes, n_tokens)``, as the whole tokenizer would count each whole text."""

    check_splits(tokenizer)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(tokenizer)
        for batch in batches:
            tokens = batch.column("tokens").flatten().dictionary_encode()
            each = np.fromiter(map(pieces.__getitem__, tokens.dictionary.to_pylist()), np.int64, len(tokens.dictionary))
            per_token, sums, at = each[tokens.indices.to_numpy()], [], 0
            for n_docs, counts, who, freq in zip(*(batch.column(c).to_pylist() for c in ("n_docs", "counts", "docs", "freqs")), strict=True):
                counts = _unpack(counts)
                weights = np.repeat(per_token[at : at + len(counts)], counts) * _unpack(freq)
                at += len(counts)
                sums.append(_smallest(np.bincount(_unpack(who), weights, n_docs).astype(np.int64)))
            yield pa.record_batch([*(batch.column(c) for c in ("block", "n_docs", "doc_ids", "n_bytes")), pa.array(sums, pa.binary())], names=["block", "n_docs", "doc_ids", "n_bytes", "sums"])

    def add_up(group: pa.Table) -> pa.Table:
        total = sum(_unpack(s) for s in group.column("sums").to_pylist())
        at = next(i for i, v in enumerate(group.column("doc_ids")) if v.is_valid)
        return pa.table([group.column("doc_ids")[at].values, group.column("n_bytes")[at].values, pa.array(total, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    # several buckets a partition, so that partitions come out even
    postings = pretoken_postings(docs, 4 * shuffle_partitions(docs.sparkSession), tokenizer)
    partial = postings.groupBy("bucket").applyInArrow(weigh, PARTIALS)
    return partial.groupBy("block").applyInArrow(add_up, "doc_id long, n_bytes long, n_tokens long")


def op2_counts(spark, sf_dir: str) -> DataFrame:
    counts = token_counts(table(spark, sf_dir, "documents"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)
