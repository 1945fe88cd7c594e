"""Phrases of a rule table of any size in lines: an Aho-Corasick automaton, one pass per line whatever the number of rules.

The rules are folded, measured, and sent once to every worker, which builds the automaton.  Rules of more than ``MAX_RULE_BYTES`` are
not collected: lines and rules then meet by their q-grams: a rule goes by its rarest gram, so an equi join finds candidates and the phrase
itself decides.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rows import exploded
from ..functions.text import collapse_space, match_forms

MAX_RULE_BYTES, GRAM = 16 << 20, 6


def folded_phrase(text: Column) -> Column:
    """The form in which a line holds a phrase: entities and forms resolved, case folded, white space collapsed."""
    return collapse_space(F.coalesce(match_forms(text)["cased"], F.lower(text)))


def _automaton(phrases: list[tuple[int, str]]) -> ahocorasick.Automaton:
    by_text: dict[str, list[int]] = {}
    for rule, phrase in phrases:
        by_text.setdefault(phrase, []).append(rule)
    made = ahocorasick.Automaton()
    for phrase, rules in by_text.items():
        made.add_word(phrase, rules)
    made.make_automaton()
    return made


_BUILT: dict[str, ahocorasick.Automaton] = {}


def _by_automaton(lines: DataFrame, phrases: list[tuple[int, str]]) -> DataFrame:
    shared = lines.sparkSession.sparkContext.broadcast(phrases)  # at most MAX_RULE_BYTES
    carried, key = [c for c in lines.columns if c != "_text"], uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # built once a worker, and only the newest is kept
        own = _BUILT.get(key)
        if own is None:
            _BUILT.clear()
            own = _BUILT[key] = _automaton(shared.value)
        for batch in batches:
            owner, rules = [], []
            for i, text in enumerate(batch.column("_text").to_pylist()):
                hits = {rule for _, found in own.iter(text or "") for rule in found} if len(own) else ()
                owner += [i] * len(hits)
                rules += sorted(hits)
            at = pa.array(owner, pa.int64())
            yield pa.record_batch([*(batch.column(c).take(at) for c in carried), pa.array(rules, pa.int64())], names=[*carried, "rule_id"])

    return lines.mapInArrow(run, T.StructType([*lines.select(*carried).schema, T.StructField("rule_id", T.LongType())]))


def grams(text: Column, size: int = GRAM) -> Column:
    """The distinct runs of ``size`` characters of a text, by one pass of look-ahead."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), 1))


def candidates(texts: DataFrame, needles: DataFrame, size: int = GRAM) -> DataFrame:
    """``(_row, rule_id)`` of ``texts(_row, _text)`` and ``needles(rule_id, phrase)`` that may hold one another.

    A needle goes by one gram, its rarest among needles, so it meets few texts; needles shorter than ``size`` go by grams of their own
    length.  Only rows' keys and digests of grams meet, not texts.
    """
    short = F.least(F.length("phrase"), F.lit(size))
    parts = None
    for (n,) in sorted(needles.select(short).distinct().collect()):  # ``size`` values at most
        own = exploded(needles.where(short == n), "rule_id", gram=grams(F.col("phrase"), n)).select("rule_id", F.xxhash64("gram").alias("gram"))
        rarest = own.join(own.groupBy("gram").agg(F.count("*").alias("n")), "gram").groupBy("rule_id").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
        met = exploded(texts, "_row", gram=F.transform(grams(F.col("_text"), n), lambda g: F.xxhash64(g))).join(rarest, "gram").select("_row", "rule_id")
        parts = met if parts is None else parts.unionByName(met)
    return parts.distinct() if parts is not None else texts.select("_row").join(needles.select("rule_id"), F.lit(False))


def substring_hits(texts: DataFrame, needles: DataFrame, max_bytes: int = MAX_RULE_BYTES) -> DataFrame:
    """``(_row, rule_id)`` of every needle of ``needles(rule_id, phrase)`` that a text of ``texts(_row, _text)`` holds, once a row; rows are told apart by ``_row``."""
    size = needles.agg(F.coalesce(F.sum(F.octet_length("phrase") + 16), F.lit(0))).first()[0]
    if size <= max_bytes:
        return _by_automaton(texts, [(r.rule_id, r.phrase) for r in needles.orderBy("rule_id", "phrase").collect()])
    met = candidates(texts, needles).join(needles, "rule_id").join(texts, "_row")
    return met.where(F.col("_text").contains(F.col("phrase"))).select("_row", "rule_id").distinct()


def phrase_hits(lines: DataFrame, rules: DataFrame, max_rule_bytes: int = MAX_RULE_BYTES) -> DataFrame:
    """``(path, line_number, rule_id)`` of every rule of ``rules(rule_id, phrase)`` that a line of ``lines(path, line_number, line)`` holds, once a line.

    Lines and phrases are compared as ``folded_phrase`` has them.  An empty phrase is no rule.
    """
    plain = rules.select(F.col("rule_id").cast("long").alias("rule_id"), folded_phrase(F.col("phrase")).alias("phrase")).where("phrase <> ''").distinct()
    texts = lines.select(F.struct("path", "line_number").alias("_row"), folded_phrase(F.col("line")).alias("_text"))
    return substring_hits(texts, plain, max_rule_bytes).select("_row.path", "_row.line_number", "rule_id")
