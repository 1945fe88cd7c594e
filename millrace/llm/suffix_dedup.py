"""Suffix-array dedup by bucket-pointer refinement: drop bytes covered by strings that an earlier document has.

Which suffixes can share ``LENGTH`` bytes is found first.  Of the q-gram hashes in every window of
``LENGTH`` bytes the least is the window's anchor; equal windows have equal anchors, so only windows whose
anchor occurs in two documents can repeat.  Anchors travel as sorted hashes, one list per block of
documents and hash range; the answer is which of them are shared.  Hashes only bound what is sorted: every
verdict below comes from the bytes.

Around shared anchors, a zone is the run of windows with that anchor.  Within a block equal zones are one
unit with its least document, so a string copied a million times costs a row per block.  Units meet by anchor, with
their bytes.  There, equal ones become one string, and the suffixes of all strings are put into a suffix
array to depth ``LENGTH`` by bucket-pointer refinement (see ``refine``).  Neighbours in it with ``LENGTH`` bytes in
common, compared as bytes, are one class; the least document of a class keeps its bytes.  Units of anchors
with very many zones are cut into single windows and meet by the window's own hash, so no anchor fills a task:
what meets by one window is at most ``LENGTH`` and some bytes per block.

A bit per window goes back to the block, which cuts the bytes.  Only anchors, units and these answers are
shuffled, besides the texts, once.

Defined cases: a null or empty text has no bytes; texts shorter than ``LENGTH`` lose nothing; rows that
repeat an id do not make each other's bytes removable; rows with a null id come after all others and lose
nothing to each other; strings that repeat within one document only stay; an empty table gives no row;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shuffle_partitions, small_batches, table, text_or_empty

LENGTH, GRAM = 50, 24
WIDTH = LENGTH - GRAM + 1
#: Zones of an anchor from which on they are cut into windows.
COMMON = 1 << 16
BLOCK_BYTES, SEGMENT = 8 << 20, 1 << 18
#: Bytes that initial buckets are made of, and parts that are refined one after the other.
DIGIT, PARTS = 8, 8
NO_ID = np.iinfo(np.int64).max
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a ^ a >> np.uint64(31)) * _A + b * _B
    return h ^ h >> np.uint64(29)


def _eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from every offset on, as one number."""
    n = len(raw) - 7
    out = np.empty(n, np.uint64)
    for k in range(min(8, n)):
        own = raw[k : k + (n - k + 7) // 8 * 8]
        out[k::8] = np.frombuffer(own.tobytes(), "<u8")
    return out


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours."""
    span = 1
    while 2 * span <= width:
        h, span = np.minimum(h[:-span], h[span:]), 2 * span
    return np.minimum(h[: len(h) - (width - span)], h[width - span :]) if width > span else h


def zones(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a text with the first and last window start of each one's zone; long texts go in segments.

    A zone may be cut where segments meet and by its length; equal windows still have equal anchors.
    """
    parts = []
    n_windows = len(raw) - LENGTH + 1
    for at in range(0, n_windows, SEGMENT):
        own = raw[at : min(len(raw), at + SEGMENT + LENGTH - 1)]
        e = _eights(own)
        h = _mix(_mix(e[:-16], e[8:-8]), e[16:])
        least = _least(h, WIDTH)
        new = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        last = np.append(new[1:], len(least)) - 1
        if (last - new).max() >= WIDTH:  # periodic texts: cut runs of one anchor into zones of WIDTH windows
            runs = (last - new) // WIDTH + 1
            step = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
            ends = np.repeat(last, runs)
            new = np.repeat(new, runs) + step * WIDTH
            last = np.minimum(ends, new + WIDTH - 1)
        parts.append((least[new], new + at, last + at))
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def refine(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """The class of each suffix of ``text`` at ``starts``: equal exactly where ``length`` bytes are equal.

    The text ends in ``length`` bytes at least that belong to no suffix asked for.  Initial buckets are those of
    DIGIT bytes; a position's pointer is its bucket's place in the order of all positions.  Buckets of several
    suffixes are refined: sorted on the pointers at a later offset, which makes smaller buckets, whose pointers
    are updated at once and refined recursively at offsets further on.  One part of the buckets goes after
    another, so that a bucket whose later offsets have all been refined takes over their depth: if those are done,
    so is what they leave together.  Where not all of them are suffixes asked for, the initial pointers serve.
    """
    if not len(starts):
        return starts
    grams = _eights(np.concatenate([text, np.zeros(DIGIT - 1, np.uint8)])).byteswap()  # in the order of the strings
    order = np.argsort(grams, kind="stable")
    new = np.concatenate([[True], grams[order][1:] != grams[order][:-1]])
    initial = np.empty(len(text), np.int64)
    initial[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    pointer, asked, done = initial.copy(), np.zeros(len(text), bool), np.zeros(len(text), bool)
    asked[starts] = True
    array = np.unique(starts)
    array = array[np.argsort(initial[array], kind="stable")]
    edges = np.flatnonzero(np.concatenate([[True], initial[array][1:] != initial[array][:-1], [True]]))
    for part in np.array_split(np.arange(len(edges) - 1), min(PARTS, len(edges) - 1)):
        active, offset = array[edges[part[0]] : edges[part[-1] + 1]], 0
        while True:
            # what stands alone is done, and so is what has been compared to the whole depth
            own = pointer[active]
            first = np.concatenate([[True], own[1:] != own[:-1]])
            size = np.diff(np.append(np.flatnonzero(first), len(active)))
            alone = np.repeat(size, size) == 1
            done[active[alone]] = True
            active = active[~done[active]]
            if offset + DIGIT >= length or not len(active):
                break
            offset = min(offset + DIGIT, length - DIGIT)
            own, later = pointer[active], active + offset
            bounds = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            size = np.diff(np.append(bounds, len(active)))
            deep = np.repeat(np.logical_and.reduceat(asked[later], bounds), size)
            closed = np.repeat(np.logical_and.reduceat(asked[later] & done[later], bounds), size)
            key = np.where(deep, pointer[later], initial[later])
            order = np.argsort((np.repeat(np.arange(len(bounds)), size) << 32) | key, kind="stable")
            active, key, own, closed = active[order], key[order], own[order], closed[order]
            new = np.concatenate([[True], (own[1:] != own[:-1]) | (key[1:] != key[:-1])])
            at = np.flatnonzero(new)[np.cumsum(new) - 1]
            pointer[active] = own + at - np.repeat(bounds, size)
            done[active] = closed
        done[array[edges[part[0]] : edges[part[-1] + 1]]] = True
    # the suffix array; neighbours are compared byte by byte
    array = array[np.argsort(pointer[array], kind="stable")]
    differ = np.zeros(max(0, len(array) - 1), bool)
    for at in [*range(0, length - DIGIT, DIGIT), length - DIGIT]:
        own = grams[array + at]
        differ |= own[1:] != own[:-1]
    out = np.empty(len(text), np.int64)
    out[array] = np.cumsum(np.concatenate([[False], differ]))
    return out[starts]


class _Block:
    """The texts of a block, in a fixed order, with their zones."""

    def __init__(self, group: pa.Table):
        ids = np.array([NO_ID if i is None else i for i in group.column("doc_id").to_pylist()], np.int64)
        raw = [t.as_buffer() if t.is_valid else b"" for t in group.column("raw")]
        raw = [np.frombuffer(r, np.uint8) if r is not None and len(r) else np.empty(0, np.uint8) for r in raw]
        order = sorted(range(len(ids)), key=lambda i: (ids[i], raw[i].tobytes()))
        self.order, self.ids, self.raw = order, ids[order], [raw[i] for i in order]
        made = [zones(r) for r in self.raw]
        self.anchor = np.concatenate([m[0] for m in made])
        self.first, self.last = (np.concatenate([m[k] for m in made]) for k in (1, 2))
        self.owner = np.repeat(np.arange(len(made)), [len(m[0]) for m in made])

        self.key, self.of_zone = np.unique(self.anchor, return_inverse=True)

    def units(self, told: dict) -> None:
        """The zones at shared anchors (``pick``), and the distinct strings among them with their least document."""
        cuts = _bounds(self.key, told["ranges"])
        flags = np.concatenate([told[0][r] if b > a else np.empty(0, np.uint8) for r, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))])
        self.pick = np.flatnonzero(flags[self.of_zone])
        spans = zip(self.owner[self.pick].tolist(), self.first[self.pick].tolist(), self.last[self.pick].tolist(), strict=True)
        strings: dict[bytes, int] = {}
        raw = [r.tobytes() for r in self.raw]
        self.unit = np.fromiter((strings.setdefault(raw[d][a : b + LENGTH], len(strings)) for d, a, b in spans), np.int64, len(self.pick))
        self.strings = list(strings)
        zone = np.empty(len(strings), np.int64)
        zone[self.unit[::-1]] = self.pick[::-1]
        self.unit_anchor, self.common = self.anchor[zone], flags[self.of_zone[zone]] == 2
        self.least = np.full(len(strings), NO_ID)
        np.minimum.at(self.least, self.unit, self.ids[self.owner[self.pick]])


def _bounds(key: np.ndarray, ranges: int) -> list[int]:
    """Where sorted hashes are cut into equal ranges of values."""
    return [*np.searchsorted(key, np.array([(r << 64) // ranges for r in range(ranges)], np.uint64)).tolist(), len(key)]


def _six(a: np.ndarray) -> bytes:
    """The upper 48 bits of hashes, in six bytes each."""
    return (a >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _of_six(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def _texts_by_block(docs: DataFrame, carry: list[str]) -> DataFrame:
    """Texts as bytes, with the columns to carry as one, dealt by hash into blocks of about BLOCK_BYTES."""
    row = F.struct(*carry) if carry else F.lit(None).cast("int")
    raw = small_batches(docs).select(F.col("doc_id").cast("long"), text_or_empty().cast("binary").alias("raw"), row.alias("row"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // BLOCK_BYTES))
    # a large document's hash differs with its text, so that rows of one id are not one block
    return raw.withColumn("block", F.pmod(F.xxhash64("doc_id", F.octet_length("raw")), F.lit(n)))


ANCHORS = "range int, block long, hashes binary, zones binary"
TOLD = "block long, kind int, range int, a binary, b binary"
UNITS = "meet int, block long, units binary, shifts binary, sizes binary, least binary, raw binary"
anchors_schema = pa.schema([("range", pa.int32()), ("block", pa.int64()), ("hashes", pa.binary()), ("zones", pa.binary())])
units_schema = pa.schema([("meet", pa.int32()), ("block", pa.int64()), *((c, pa.binary()) for c in ("units", "shifts", "sizes", "least", "raw"))])
told_schema = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("range", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _told(rows: pa.Table, ranges: int) -> dict:
    """Answers on anchors by range (0 not shared, 1 shared, 2 by many zones), and those on windows as a list."""
    out = {"ranges": ranges, 0: {}, 1: []}
    for kind, r, a, b in zip(*(rows.column(c).to_pylist() for c in ("kind", "range", "a", "b")), strict=True):
        if kind == 1:
            out[1].append((np.frombuffer(a, "<i4"), np.frombuffer(b, "<i8")))
        else:
            out[0][r] = np.frombuffer(a, np.uint8)
    return out


def remove_repeats(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Every document with what is left of its bytes (``kept``) and the spans removed from it.

    Columns named in ``carry`` come along as the fields of ``row``.
    """
    ranges = meets = 4 * shuffle_partitions(docs.sparkSession)  # several a partition, so that partitions come out even
    texts = _texts_by_block(docs, carry or [])
    spans = T.StructType([*SPANS, texts.schema["row"]])

    def send_anchors(group: pa.Table) -> pa.Table:
        block = _Block(group)
        lowest, highest = np.full(len(block.key), NO_ID), np.full(len(block.key), np.iinfo(np.int64).min)
        ids = block.ids[block.owner]
        np.minimum.at(lowest, block.of_zone, ids)
        np.maximum.at(highest, block.of_zone, ids)
        # a byte per anchor: how many zones, and whether of several documents
        n_zones = (np.minimum(np.bincount(block.of_zone, minlength=len(block.key)), 127) | (lowest != highest).astype(np.int64) << 7).astype(np.uint8)
        cuts, number = _bounds(block.key, ranges), group.column("block")[0].as_py()
        return _rows([(r, number, _six(block.key[a:b]), n_zones[a:b].tobytes()) for r, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a], anchors_schema)

    def find_shared(group: pa.Table) -> pa.Table:
        lists = [_of_six(h) for h in group.column("hashes").to_pylist()]
        every, n_zones = np.concatenate(lists), np.frombuffer(b"".join(group.column("zones").to_pylist()), np.uint8)
        key, place = np.unique(every, return_inverse=True)
        blocks, zones_of = np.bincount(place, minlength=len(key)), np.bincount(place, n_zones & 127, len(key))
        shared = (blocks > 1) | (np.bincount(place, n_zones >> 7, len(key)) > 0)
        flags = np.where(shared, np.where(zones_of > COMMON, 2, 1), 0).astype(np.uint8)[place]
        r, ends = group.column("range")[0].as_py(), np.cumsum([len(x) for x in lists])
        return _rows([(n, 0, r, f.tobytes(), None) for n, f in zip(group.column("block").to_pylist(), np.split(flags, ends[:-1]), strict=True)], told_schema)

    def send_units(group: pa.Table, told: pa.Table) -> pa.Table:
        if not group.num_rows:
            return units_schema.empty_table()
        block = _Block(group)
        block.units(_told(told, ranges))
        number, by = group.column("block")[0].as_py(), defaultdict(list)
        for u, (raw, meet, common) in enumerate(zip(block.strings, (block.unit_anchor % np.uint64(meets)).tolist(), block.common.tolist(), strict=True)):
            if common:
                for k in range(len(raw) - LENGTH + 1):
                    by[xxhash.xxh3_64_intdigest(raw[k : k + LENGTH]) % meets].append((u, k, raw[k : k + LENGTH]))
            else:
                by[meet].append((u, 0, raw))
        rows = []
        for meet, own in by.items():
            unit, shift, raw = zip(*own, strict=True)
            rows.append((meet, number, np.array(unit, "<i4").tobytes(), bytes(shift), bytes(map(len, raw)), block.least[list(unit)].tobytes(), b"".join(raw)))
        return _rows(rows, units_schema)

    def compare(group: pa.Table) -> pa.Table:
        """Which windows of each unit an earlier document has."""
        read = lambda c, kind: np.frombuffer(b"".join(group.column(c).to_pylist()), kind)
        size, least, shift, unit = read("sizes", np.uint8).astype(np.int64), read("least", "<i8"), read("shifts", np.uint8), read("units", "<i4")
        raw = b"".join(group.column("raw").to_pylist())
        offsets = np.concatenate([[0], np.cumsum(size)])
        strings = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)]).dictionary_encode()
        of, distinct = strings.indices.to_numpy(), strings.dictionary.to_pylist()
        text = np.frombuffer(b"".join(distinct) + bytes(LENGTH), np.uint8)
        length = np.array([len(x) for x in distinct])
        n, begin = length - LENGTH + 1, np.cumsum(length) - length
        window = np.cumsum(n) - n
        place = np.arange(n.sum()) - np.repeat(window, n)
        classes = refine(text, np.repeat(begin, n) + place, LENGTH)
        of_string = np.full(len(distinct), NO_ID)
        np.minimum.at(of_string, of, least)
        first = np.full(int(classes.max()) + 1, NO_ID)
        np.minimum.at(first, classes, np.repeat(of_string, n))
        each = n[of]
        k = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        gone = first[classes[np.repeat(window[of], each) + k]] < np.repeat(least, each)
        bits = np.bitwise_or.reduceat(gone.astype(np.int64) << k, np.cumsum(each) - each) << shift
        block = np.repeat(group.column("block").to_numpy(), [len(x) // 4 for x in group.column("units").to_pylist()])
        own = np.flatnonzero(bits)
        own = own[np.argsort(block[own], kind="stable")]
        heads = np.flatnonzero(np.concatenate([[True], block[own][1:] != block[own][:-1]])) if len(own) else own
        return _rows([(int(block[i[0]]), 1, 0, unit[i].tobytes(), bits[i].tobytes()) for i in np.split(own, heads[1:]) if len(i)], told_schema)

    def cut(group: pa.Table, told: pa.Table) -> pa.Table:
        row = group.column("row").combine_chunks()
        fields = pa.schema([*spans_schema, ("row", row.type)])
        if not group.num_rows:
            return fields.empty_table()
        block, answers = _Block(group), _told(told, ranges)
        block.units(answers)
        bits = np.zeros(len(block.strings), np.int64)
        for u, b in answers[1]:
            np.bitwise_or.at(bits, u, b)
        owner, out = block.owner[block.pick], []
        bounds = np.searchsorted(owner, np.arange(len(block.ids) + 1))
        for d, (doc, raw) in enumerate(zip(block.ids.tolist(), block.raw, strict=True)):
            part = slice(bounds[d], bounds[d + 1])
            u, a = block.unit[part], block.first[block.pick[part]]
            n = block.last[block.pick[part]] - a + 1
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start = np.repeat(a, n) + place
            # a later document of the block loses the whole unit, the least one what others have before it
            own = np.repeat(block.least[u] < doc, n) | (np.repeat(bits[u], n) >> place & 1).astype(bool)
            start = start[own]
            edge = np.zeros(len(raw) + 1, np.int32)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + LENGTH, -1)
            gone = np.cumsum(edge)[:-1] > 0
            turn = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
            kept = raw[~gone].tobytes()
            out.append((None if doc == NO_ID else doc, len(raw), int(gone.sum()), int((turn > 0).sum()), kept, hashlib.sha256(kept).hexdigest(), np.flatnonzero(turn > 0), np.flatnonzero(turn < 0)))
        columns = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), spans_schema, strict=True)]
        return pa.table([*columns, row.take(pa.array(block.order, pa.int64()))], schema=fields)

    by_block = texts.groupBy("block")
    shared = by_block.applyInArrow(send_anchors, ANCHORS).groupBy("range").applyInArrow(find_shared, TOLD)
    verdicts = by_block.cogroup(shared.groupBy("block")).applyInArrow(send_units, UNITS).groupBy("meet").applyInArrow(compare, TOLD)
    return by_block.cogroup(shared.unionByName(verdicts).groupBy("block")).applyInArrow(cut, spans)


spans_schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("kept_sha256", pa.string()), ("span_starts", pa.list_(pa.int64())), ("span_ends", pa.list_(pa.int64()))])


_KINDS = {pa.int64(): T.LongType(), pa.binary(): T.BinaryType(), pa.string(): T.StringType(), pa.list_(pa.int64()): T.ArrayType(T.LongType())}
SPANS = [T.StructField(f.name, _KINDS[f.type]) for f in spans_schema]


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with their texts cut, ``n_chars`` following if there is such a column.

    Bytes of a character that a span's end cuts through go with it; a text of which nothing is left is empty.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b.decode("utf-8", "ignore") for b in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["row", "left"])

    others = [c for c in docs.columns if c != "text"]
    cut = remove_repeats(docs, others).select("row", "kept")
    decoded = cut.mapInArrow(decode, T.StructType([cut.schema["row"], T.StructField("left", T.StringType())]))
    columns = {c: F.col("left") if c == "text" else F.length("left").cast("long") if c == "n_chars" else F.col("row").getField(c) for c in docs.columns}
    return decoded.select(*(v.alias(c) for c, v in columns.items()))


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
