"""MinHash near-dedup with bottom-k sketches from one hash function.

A document's set is its distinct word shingles, hashed to 64 bits; its sketch is the k least values of
one mixing of those hashes.  Inverted lists of retained values generate candidates; the sketch of the
union estimates their similarity and filters; exact Jaccard on the whole sets confirms.

Equal sets form one class first, so copies cost nothing further.  Values that many classes retain come
last in an order by frequency, and only a prefix of each sketch in that order is listed: two sketches
that overlap in at least ``need`` values must meet in the first ``k - need + 1``.  For sets that fit in
their sketch ``need`` follows from the similarity and nothing can be missed; for larger ones it is
``(similarity - SLACK) * k``, over six standard deviations below the expected overlap at the bound, and
estimates are allowed the same.

Links are found in rounds so that no list is expanded into all its pairs.  In the first round each
class meets only its neighbour and the earliest document in each of its lists; the confirmed links are
contracted to components.  Later rounds join, within a list, only classes whose components still differ.
Lists that are long even so hold many classes that are alike but not similar enough, which sketches cannot
tell apart.  These classes alone are listed anew by their whole sets: rarest shingles first, as many as
the similarity leaves open, and two meet only if what follows in both lists can still be overlap enough.
That prefix and that bound are exact, so nothing is missed there either.

Defined cases: a null or empty text (or one without words) has an empty set and links with nothing; fewer
words than a shingle make one shingle; documents with a null id stand alone with a null component; rows
that repeat an id are rows of their own; of equal sets the smallest id leads; an empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import CACHED_WORDS, keep, slices, small_batches, table

SHINGLE, SIMILARITY = 5, 0.8
K, SLACK, COMMON = 64, 0.32, 32
#: Members of a list from which on their whole sets are compared by exact prefixes.
LONG = 32
_BREAKS = re.compile(r"[\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SIGN = np.uint64(1 << 63)
SKETCHES = "doc_id long, n_shingles long, cls long, sketch array<long>"


class _WordHash(dict):
    """64-bit hashes of words; emptied when it holds too many."""

    def __missing__(self, word: str) -> int:
        if len(self) > CACHED_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode())
        return h


_HASH = _WordHash()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them."""
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def word_hashes(text: str) -> np.ndarray:
    words = [w for w in _BREAKS.split(text.translate(_LOWER)) if w]
    return np.fromiter(map(_HASH.__getitem__, words), np.uint64, len(words))


def shingle_set(text: str, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of a text; of the whole sequence if it is shorter."""
    words = word_hashes(text)
    if not len(words):
        return words
    width = min(n, len(words))
    rows = len(words) - width + 1
    h = np.full(rows, width, np.uint64)
    for k in range(width):
        h = mix(h * _MIX + words[k : k + rows])
    return np.unique(h)


def set_class(own: np.ndarray) -> int:
    """A 64-bit digest of a whole set."""
    return int(np.frombuffer(xxhash.xxh3_64(own.tobytes()).digest(), ">i8")[0])


def sketches(docs: DataFrame, shingle: int, k: int) -> DataFrame:
    """``(doc_id, text)`` to set size, class (equal for equal sets) and bottom-k sketch, whose order as longs is the one it was cut by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for text in part.column(1):
                own = shingle_set(text.as_py() or "", shingle)
                low = (np.sort(mix(own + _MIX))[:k] ^ _SIGN).view(np.int64)
                rows.append((len(own), set_class(own), low))
            n, cls, low = zip(*rows, strict=True)
            yield pa.record_batch([part.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(low, pa.list_(pa.int64()))], names=[f.split()[0] for f in SKETCHES.split(", ")])

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, SKETCHES)


def overlap_needed(n: Column, k: int, similarity: float) -> Column:
    """Sketch values that a document of ``n`` shingles shares with any similar one."""
    return F.when(n <= int(k * similarity), F.ceil(n * similarity)).otherwise(F.ceil(F.least(n, F.lit(k)) * (similarity - SLACK))).cast("int")


def union_estimate(a: Column, b: Column, k: int) -> Column:
    """Share of the union's k least values that both sketches hold."""
    least = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    return F.size(F.array_intersect(least, F.array_intersect(a, b))) / F.size(least)


def _ratio(similarity: float) -> tuple[int, int]:
    return round(similarity * 1000), 1000


def whole_sets(wanted: DataFrame, classes: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """``(cls, own)``: the whole sets of the classes in ``wanted(cls)``, made from one text each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            own = [shingle_set(t.as_py() or "", shingle) for t in part.column(1)]
            yield pa.record_batch([pa.array([set_class(o) for o in own], pa.int64()), pa.array([o.view(np.int64) for o in own], pa.list_(pa.int64()))], names=["cls", "own"])

    docs = wanted.distinct().join(classes.select("cls", "rep"), "cls").select(F.col("rep").alias("doc_id")).distinct()
    made = texts.join(docs, "doc_id", "left_semi").mapInArrow(run, "cls long, own array<long>")
    return made.groupBy("cls").agg(F.first("own").alias("own"))


def exact_links(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of the pairs ``(a, b)`` of classes, those whose whole sets are similar."""
    num, den = _ratio(similarity)

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 256):
            yes = []
            for x, y in zip(part.column(2), part.column(3), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                yes.append(den * both >= num * (len(x) + len(y) - both))
            yield part.select([0, 1]).filter(pa.array(yes, pa.bool_()))

    first, second = sets.select(F.col("cls").alias("a"), F.col("own").alias("x")), sets.select(F.col("cls").alias("b"), F.col("own").alias("y"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y").mapInArrow(similar, "a long, b long")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select("a").union(pairs.select("b")).toDF("cls")


def first_meetings(lists: DataFrame, similarity: float) -> DataFrame:
    """``(a, b)``: every class of ``lists(v, cls, n, rep)`` with its neighbour by size and the earliest of each list."""
    num, den = _ratio(similarity)
    # common values are dealt out by salt; later rounds join what that keeps apart
    neighbours = Window.partitionBy("v", F.pmod(F.hash("cls"), F.lit(16))).orderBy("n", "cls")
    chain = lists.select("cls", "n", F.lead("cls").over(neighbours).alias("other"), F.lead("n").over(neighbours).alias("m"))
    hubs = lists.groupBy("v").agg(F.min_by(F.struct("cls", "n"), "rep").alias("h"))
    star = lists.join(hubs, "v").select("cls", "n", F.col("h.cls").alias("other"), F.col("h.n").alias("m"))
    met = chain.unionByName(star).where((F.col("cls") != F.col("other")) & (den * F.col("n") >= num * F.col("m")) & (den * F.col("m") >= num * F.col("n")))
    return met.select(F.least("cls", "other").alias("a"), F.greatest("cls", "other").alias("b")).distinct()


def apart(lists: DataFrame, found: DataFrame) -> DataFrame:
    """``lists`` with components, only those lists that hold several."""
    placed = lists.join(found, "cls")
    mixed = placed.groupBy("v").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("long")).where("lo <> hi").select("v", "long")
    return placed.join(mixed, "v")


def crossings(lists: DataFrame, similarity: float, feasible: Column | None = None) -> DataFrame:
    """``(a, b)``: classes of one list whose components differ and whose sizes allow a link."""
    num, den = _ratio(similarity)
    on = (F.col("x.v") == F.col("y.v")) & (F.col("x.component") < F.col("y.component")) & (den * F.col("x.n") >= num * F.col("y.n")) & (den * F.col("y.n") >= num * F.col("x.n"))
    both = lists.alias("x").join(lists.alias("y"), on if feasible is None else on & feasible)
    return both.select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b")).distinct()


def rare_first(sets: DataFrame, similarity: float) -> DataFrame:
    """``(v, cls, n, rest)``: the exact prefix of every set, rarest shingles first; ``rest`` counts from there to the end."""
    num, den = _ratio(similarity)
    each = sets.select("cls", F.size("own").alias("n"), F.explode("own").alias("v"))
    often = each.groupBy("v").agg(F.count("*").alias("count")).where("count > 1")
    ranked = each.join(often, "v", "left").groupBy("cls", "n").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("count", F.lit(1)).alias("count"), "v"))).alias("rs"))
    length = F.col("n") - F.ceil(F.col("n") * num / den).cast("int") + 1
    prefix = ranked.select("cls", "n", F.posexplode(F.slice("rs", F.lit(1), length)).alias("p", "r"))
    return prefix.where("r.count > 1").select(F.col("r.v").alias("v"), "cls", "n", (F.col("n") - F.col("p")).alias("rest"))


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``(cls, component)`` for every node ``cls``; the component is named by one of its nodes.

    Each round every node joins its neighbour (or itself) of least random rank and the links are
    contracted; ranks change with the round, so that long chains shrink by a share of their nodes.
    """
    edges, mapping, number = links.select("a", "b").where("a <> b").distinct(), None, 0
    edges = keep(edges, "links")
    while edges.limit(1).count():
        both = edges.union(edges.select("b", "a"))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(number)).alias("r"), F.col(c).alias("node"))  # noqa: B023, E731
        least = both.groupBy("a").agg(F.min(F.least(rank("a"), rank("b"))).alias("m"))
        moved = keep(least.select(F.col("a").alias("node"), F.col("m.node").alias("head")), "heads")
        if mapping is None:
            mapping = moved.select(F.col("node").alias("cls"), "head")
        else:
            again = moved.select(F.col("node").alias("head"), F.col("head").alias("next"))
            mapping = mapping.join(again, "head", "left").select("cls", F.coalesce("next", "head").alias("head"))
        mapping = keep(mapping, "mapping")
        to = lambda c: moved.select(F.col("node").alias(c), F.col("head").alias(f"_{c}"))  # noqa: B023, E731
        edges = edges.join(to("a"), "a").join(to("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
        edges = keep(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        number += 1
    if mapping is None:
        return nodes.select("cls", F.col("cls").alias("component"))
    return nodes.select("cls").join(mapping, "cls", "left").select("cls", F.coalesce("head", "cls").alias("component"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, k: int = K) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every document."""
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    all_sets = keep(sketches(texts, shingle, k), "sketches")
    known = all_sets.where(F.col("doc_id").isNotNull())
    # one class per distinct set, known by its least id; copies go no further
    classes = known.where("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    classes = keep(classes, "classes")

    values = classes.select("cls", "n", "rep", F.explode("sketch").alias("v"))
    common = keep(values.groupBy("v").count().where(F.col("count") > COMMON), "common")
    ranked = values.join(common, "v", "left").select("cls", "n", "rep", F.struct(F.coalesce("count", F.lit(0)).alias("count"), "v").alias("r"))
    prefix = ranked.groupBy("cls", "n", "rep").agg(F.sort_array(F.collect_list("r")).alias("rs"))
    size = F.least("n", F.lit(k)) - overlap_needed(F.col("n"), k, similarity) + 1
    lists = prefix.select("cls", "n", "rep", F.explode(F.transform(F.slice("rs", F.lit(1), size.cast("int")), lambda r: r["v"])).alias("v"))
    shared = lists.groupBy("v").count().where("count > 1").select("v")
    lists = keep(lists.join(shared, "v", "left_semi"), "lists")

    sketch_of = classes.select("cls", "sketch")

    def estimated(pairs: DataFrame) -> DataFrame:
        """Pairs whose union sketch does not rule them out."""
        pairs = pairs.join(sketch_of.withColumnsRenamed({"cls": "a", "sketch": "s"}), "a").join(sketch_of.withColumnsRenamed({"cls": "b", "sketch": "t"}), "b")
        return keep(pairs.where(union_estimate(F.col("s"), F.col("t"), k) >= similarity - SLACK).select("a", "b"), "estimated")

    nodes = classes.select("cls")
    met = estimated(first_meetings(lists, similarity))
    links = keep(exact_links(met, whole_sets(_ends(met), classes, texts, shingle), similarity), "links")
    open_lists = keep(apart(lists, components(nodes, links)), "open")

    short = estimated(crossings(open_lists.where(F.col("long") <= LONG), similarity))
    links = keep(links.union(exact_links(short, whole_sets(_ends(short), classes, texts, shingle), similarity)), "links")

    # what long lists hold, by whole sets
    sets = keep(whole_sets(open_lists.where(F.col("long") > LONG).select("cls"), classes, texts, shingle), "sets")
    listed = keep(rare_first(sets, similarity).join(classes.select("cls", "rep"), "cls"), "rare")
    num, den = _ratio(similarity)
    enough = F.least("x.rest", "y.rest") * (den + num) >= num * (F.col("x.n") + F.col("y.n"))
    links = keep(links.union(exact_links(first_meetings(listed, similarity), sets, similarity)), "links")
    late = crossings(keep(apart(listed, components(nodes, links)), "open"), similarity, enough)
    links = keep(links.union(exact_links(late, sets, similarity)), "links")
    final = keep(components(nodes, links), "final")

    members = keep(known.select("doc_id", "n_shingles", "cls").join(final, "cls", "left"), "members")
    # as a table, so that the join by component stands alone and a large component's rows can be split
    least = keep(members.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("first_id")), "least")
    joined = members.join(least, "component", "left").select("doc_id", "n_shingles", F.coalesce("first_id", "doc_id").alias("component_id"))
    alone = all_sets.where(F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The documents, one of each group of near duplicates; rows of one id stay if their texts differ."""
    judged = near_duplicates(docs, shingle, similarity).where("doc_id IS NOT NULL")
    kept = keep(judged.where("kept").groupBy("doc_id").count(), "kept")
    stay = docs.join(kept.where("count = 1").select("doc_id"), "doc_id", "left_semi")
    repeated = docs.join(kept.where("count > 1").select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return stay.unionByName(repeated).unionByName(docs.where("doc_id IS NULL")).select(*docs.columns)


def op8_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, similarity=0.85)
