"""Best-fit packing by a grouping genetic algorithm, evolved on islands with elite migration.

Texts become token ids and an end id; only what is longer than a sequence is cut, the first piece
being the shorter one.  Full pieces are sequences as they stand.  The rest is dealt by hash into shards
of a bounded number of pieces.  Each shard is one packing problem, worked on by several islands (rows
of their own, so tasks of their own): an island starts from best-fit-decreasing and shuffled best-fit
packings; crossover injects whole well-filled sequences of one parent into the other, drops the
sequences that now hold a piece twice and best-fits the displaced pieces; mutation empties the least
filled sequences.  Between epochs each island's elite moves to the next island.  What no shard could
fill well is gathered, dealt into new shards and packed again, so that the loss does not grow with
their number.

Defined cases: a null or empty text is one piece, the end id; repeated rows are packed as often as
they occur; null ids pass through; ties go to the fuller, then earlier sequence; an empty table packs
into no sequence; further columns are ignored.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, slices, small_batches, table
from .tokenizers_io import byte_level_ids

CAPACITY, END_ID = 1024, 2
SHARD_PIECES, ISLANDS, EPOCHS, GENERATIONS, POPULATION = 2048, 3, 2, 8, 5
#: A sequence filled less than this is packed again in the next round.
WELL_FILLED, ROUNDS = 0.998, 3
#: Islands that one task evolves, about.
TASK_ISLANDS = 16
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``(doc_id, text)`` to pieces of at most ``capacity`` ids: their place, length and checksum."""
    end = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for doc, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                ids = np.concatenate([byte_level_ids(text.as_py() or "", tokenizer), end])
                n = len(ids)
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                rows += [(doc, k, a, b - a, zlib.crc32(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in PIECES.split(", ")])

    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def best_fit(bins: list[list], items: list[int], sizes: list[int], capacity: int) -> None:
    """Put items, in the order given, each where it leaves the least room; what fits nowhere opens a sequence.

    A sequence is ``[filled, items]``.
    """
    room = sorted((capacity - own[0], b) for b, own in enumerate(bins) if own[0] < capacity)
    for i in items:
        size = sizes[i]
        at = bisect_left(room, (size, -1))
        if at < len(room):
            left, b = room.pop(at)
            own = bins[b]
            own[0] += size
            own[1].append(i)
        else:
            left, b = capacity, len(bins)
            bins.append([size, [i]])
        if left > size:
            insort(room, (left - size, b))


def fitness(bins: list[list], capacity: int) -> tuple[int, int]:
    """Fewer sequences first, then fill gathered in few of them."""
    return -len(bins), sum(own[0] * own[0] for own in bins)


def crossover(one: list[list], other: list[list], sizes: list[int], capacity: int, rng: random.Random) -> list[list]:
    """Whole well-filled sequences of ``other`` into ``one``: those drawn from its fuller half."""
    fuller = sorted(other, key=lambda own: -own[0])[: max(1, len(other) // 2)]
    injected = rng.sample(fuller, max(1, len(fuller) // 4))
    taken = {i for own in injected for i in own[1]}
    kept, displaced = [[own[0], own[1][:]] for own in injected], []
    for own in one:
        if taken.isdisjoint(own[1]):
            kept.append([own[0], own[1][:]])
        else:
            displaced += [i for i in own[1] if i not in taken]
    displaced.sort(key=sizes.__getitem__, reverse=True)
    best_fit(kept, displaced, sizes, capacity)
    return kept


def mutate(bins: list[list], sizes: list[int], capacity: int, rng: random.Random) -> list[list]:
    """Empty the least filled sequences and some others, and best-fit their pieces anew."""
    ranked = sorted(bins, key=lambda own: own[0])
    n = max(1, len(ranked) // 50)
    loose, rest = ranked[:n], ranked[n:]
    chosen = set(rng.sample(range(len(rest)), min(n, len(rest))))
    loose += [rest[k] for k in chosen]
    kept = [own for k, own in enumerate(rest) if k not in chosen]
    best_fit(kept, sorted((i for own in loose for i in own[1]), key=sizes.__getitem__, reverse=True), sizes, capacity)
    return kept


def evolve(sizes: list[int], immigrants: list[np.ndarray], seed: int, capacity: int) -> np.ndarray:
    """One epoch of one island; the elite comes back as the sequence number of every piece."""
    rng = random.Random(seed)
    order = sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True)
    population = []
    for given in immigrants:
        bins: list[list] = [[0, []] for _ in range(int(given.max()) + 1)]
        for i, b in enumerate(given.tolist()):
            bins[b][0] += sizes[i]
            bins[b][1].append(i)
        population.append(bins)
    floor = -(-sum(sizes) // capacity)
    while len(population) < POPULATION:
        start: list[list] = []
        if population:  # the first is best-fit decreasing, the others follow a shaken order
            order = sorted(order, key=lambda i: -sizes[i] - rng.random() * (capacity / 16))
        best_fit(start, order, sizes, capacity)
        population.append(start)
    ranked = sorted(((fitness(p, capacity), k, p) for k, p in enumerate(population)), reverse=True)
    for born in range(GENERATIONS * POPULATION // 2):
        if -ranked[0][0][0] == floor:
            break
        one, other = rng.sample(ranked, 2)
        child = mutate(crossover(one[2], other[2], sizes, capacity, rng), sizes, capacity, rng)
        ranked = sorted([*ranked[:-1], (fitness(child, capacity), POPULATION + born, child)], reverse=True)
    out = np.empty(len(sizes), "<i4")
    for b, own in enumerate(ranked[0][2]):
        out[own[1]] = b
    return out


def evolve_islands(shards: DataFrame, capacity: int, n_shards: int) -> DataFrame:
    """``(shard, lengths)`` to ``(shard, elite)``: the best packing that any island found.

    Rows are few bytes and much work, so their number of tasks is set, not left to their size.
    """

    def epoch(number: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for shard, island, lengths, elites in zip(pdf.shard, pdf.island, pdf.lengths, pdf.elites, strict=True):
                    sizes = [int(x) for x in lengths]
                    given = [np.frombuffer(e, "<i4") for e in elites]
                    best = evolve(sizes, given, hash((int(shard), int(island), number)), capacity)
                    out.append((shard, island, lengths, [best.tobytes()], -(int(best.max()) + 1)))
                yield pd.DataFrame(out, columns=["shard", "island", "lengths", "elites", "score"])

        return run

    schema = "shard long, island int, lengths array<int>, elites array<binary>, score int"
    state = shards.select("shard", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "lengths", F.array().cast("array<binary>").alias("elites"))
    n_tasks = -(-n_shards * ISLANDS // TASK_ISLANDS)
    state = state.repartition(n_tasks, "shard", "island")
    for number in range(EPOCHS):
        state = keep(state.select("shard", "island", "lengths", "elites").mapInPandas(epoch(number), schema), "islands")
        if number + 1 < EPOCHS:  # the elite of each island also goes to the next one
            moved = state.select("shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("elites").alias("arrived"))
            state = state.join(moved, ["shard", "island"]).withColumn("elites", F.concat("elites", "arrived")).repartition(n_tasks, "shard", "island")
    return state.groupBy("shard").agg(F.max_by(F.element_at("elites", 1), "score").alias("elite"))


def _pack_round(pieces: DataFrame, capacity: int, seed: int, n_pieces: int) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``, packed within shards of about SHARD_PIECES."""
    n_shards = max(1, round(n_pieces / SHARD_PIECES))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("row_no", F.lit(seed)), F.lit(n_shards)))
    row = F.struct("length", "row_no", "doc_id", "piece", "start", "ids_crc32")
    shards = keep(dealt.groupBy("shard").agg(F.sort_array(F.collect_list(row)).alias("rows")), "shards")
    best = evolve_islands(shards.select("shard", F.transform("rows", lambda r: r["length"].cast("int")).alias("lengths")), capacity, n_shards)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for shard, rows, elite in zip(pdf.shard, pdf.rows, pdf.elite, strict=True):
                out = pd.DataFrame([r if isinstance(r, dict) else r.asDict() for r in rows])
                out["bin"] = np.frombuffer(elite, "<i4").astype(np.int64)
                out["offset"] = out.groupby("bin").length.cumsum() - out.length
                out["filled"] = out.groupby("bin").length.transform("sum")
                out["sequence_id"] = (np.int64(seed) << 58) + (np.int64(shard) << 20) + out.bin
                out["doc_id"] = out.doc_id.astype("Int64")
                yield out[["row_no", "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "filled"]]

    schema = f"row_no long, {PIECES}, sequence_id long, offset long, filled long"
    return keep(shards.join(best, "shard").mapInPandas(place, schema), "packed")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (see ``token_pieces``) with the sequence that each is in and its place there."""
    columns = [f.split()[0] for f in PIECES.split(", ")]
    given = keep(pieces.select(*columns), "pieces").withColumn("row_no", F.monotonically_increasing_id())
    full = given.where(F.col("length") >= capacity).select(*columns, (-1 - F.col("row_no")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    out, rest = full, given.where(F.col("length") < capacity)
    for seed in range(1, ROUNDS + 1):
        n = rest.count()
        if not n:
            break
        packed = _pack_round(rest, capacity, seed, n)
        last = n <= SHARD_PIECES or seed == ROUNDS
        done = packed if last else packed.where(F.col("filled") >= int(WELL_FILLED * capacity))
        out = out.unionByName(done.select(*columns, "sequence_id", "offset"))
        if last:
            break
        rest = packed.where(F.col("filled") < int(WELL_FILLED * capacity)).select(*columns, "row_no")
    return out


def op1_packing(spark, sf_dir: str) -> DataFrame:
    return pack(token_pieces(table(spark, sf_dir, "documents")))
