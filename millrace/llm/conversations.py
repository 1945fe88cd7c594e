"""Repair of conversations: the cheapest edits after which the roles alternate and nothing is blank, twice or cut off for free.

Rows of a conversation are kept, given another role, deleted, or preceded by an inserted empty turn so that the roles'
initials read ``(s?(ua)+)?``.  The cheapest edits come from dynamic programming backwards over rows and states of that
grammar (the cost to go); a walk forwards then takes, of the edits that keep to the least cost, the one whose letter is
least in ASCII.  Costs to go, less their least one, take few values over the four states, so both passes are table
look-ups by row, and the tables fill themselves (``costs_to_go``, ``step``).

What a row is to the grammar is one character (``code``).  Rows without their texts, but with digests of these, are ordered by
range over conversation and place, so that a long conversation is spread over tasks; each task makes one piece of
codes per conversation, and a conversation's pieces together are as long as its audit, which is a cell of the result.  Texts
travel once, to the task that hashes a conversation: sorted, and streamed row by row beside the audit.

Rows of a conversation stand in the order of turn (nulls first), role and digest of the text.  The first row of a
role and text is no duplicate, all later ones are.

Defined cases: null ids, turns, roles and texts count as one space (a null id is a conversation of its own and null in
the result; a null turn takes part in no gap); a row whose role has another initial than ``s u a``, or none, can be
deleted or given a role but not kept; repeated rows are duplicates; an empty text is blank; a conversation
without rows left has zeros, an empty audit and the hash of an empty string; an empty table gives no row; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table

#: What edits cost; a truncated row that is not deleted adds LEFT.
KEEP, REROLE, DELETE, INSERT, LEFT = 0, 2, 3, 2, 1
#: States of the grammar: nothing yet, after s, after u, after a.  Which role leads where, and where the one that can be made leads.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
MADE = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
ENDS = (0, 3)
FAR = 1 << 30

#: A row's code: its initial (or ``?``), as a capital (or ``!``) if it is truncated; or what it must be deleted for.
BLANK, DUPLICATE, TRUNCATED = "b", "d", "SUA!"
_SCHEMA = "conv_id {}, n_rows long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _inserted(costs: list[int]) -> tuple[int, ...]:
    """Costs to go with inserts before what comes next; two at most can help."""
    for _ in range(2):
        costs = [min(costs[s], INSERT + costs[MADE[s][1]]) for s in range(4)]
    return tuple(costs)


#: The costs to go after the last row.
END = _inserted([0 if s in ENDS else FAR for s in range(4)])


def _row_costs(code: str, after: tuple[int, ...]) -> list[dict[str, tuple[int, int]]]:
    """Per state, what each edit of one row comes to: letter to (cost with all that follows, next state)."""
    out = []
    for s in range(4):
        options = {"D": (DELETE + after[s], s)}
        if code not in (BLANK, DUPLICATE):
            left = LEFT if code in TRUNCATED else 0
            made = MADE[s][1]
            options["R"] = (REROLE + left + after[made], made)
            kept = NEXT.get((s, code.lower()))
            if kept is not None:
                options["K"] = (KEEP + left + after[kept], kept)
        out.append(options)
    return out


@lru_cache(maxsize=1 << 14)
def costs_to_go(code: str, after: tuple[int, ...]) -> tuple[int, tuple[int, ...]]:
    """The costs to go before a row, from those after it: their least one, and each one's excess over that."""
    costs = _inserted([min(c for c, _ in options.values()) for options in _row_costs(code, after)])
    least = min(costs)
    return least, tuple(c - least for c in costs)


@lru_cache(maxsize=1 << 14)
def step(code: str | None, after: tuple[int, ...], state: int) -> tuple[str, int]:
    """The letters of the edits up to and with one row (up to the end without one), and the state after them."""
    rows = _row_costs(code, after) if code else [{"": (0 if s in ENDS else FAR, s)} for s in range(4)]
    before = _inserted([min(c for c, _ in options.values()) for options in rows])
    letters = ""
    while True:
        tight = {letter: to for letter, (c, to) in rows[state].items() if c == before[state]}
        made = MADE[state][1]
        if INSERT + before[made] == before[state]:
            tight["I"] = made
        letter = min(tight)
        letters += letter
        state = tight[letter]
        if letter != "I":
            return letters, state


def audit_of(codes: str) -> tuple[int, str]:
    """The least cost of a conversation's edits and their letters."""
    afters, cost = [END], 0
    for code in reversed(codes):
        least, before = costs_to_go(code, afters[-1])
        cost += least
        afters.append(before)
    cost += afters[-1][0]
    letters, state = [], 0
    for code, after in zip(codes, reversed(afters[:-1]), strict=True):
        own, state = step(code, after, state)
        letters.append(own)
    letters.append(step(None, END, state)[0])
    return cost, "".join(letters)


def repaired(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """``(role, text)`` of a conversation after the edits of its audit."""
    state = 0
    for letter in audit:
        role, text = (None, "") if letter == "I" else next(rows)
        if letter != "D":
            made, to = MADE[state]
            state = NEXT[state, role[0]] if letter == "K" else to
            yield (role if letter == "K" else made), text


# --- rows ------------------------------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, copies)``: rows by the crc32 of ``conv_id:turn``, modulo 20, with the damage it names done."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    given = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20).alias("_k"))
    k = F.col("_k")
    text = F.when(k == 1, "").when(k == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return given.select("conv_id", "turn", F.when(k == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(k == 0, 0).when(k == 3, 2).otherwise(1).alias("copies"))


_PLACE = ("conv_id", "turn", "role", "digest")  # ascending, nulls first


def _with_digest(rows: DataFrame) -> DataFrame:
    return rows.where("copies > 0").withColumn("digest", F.unhex(F.sha2("text", 256)))


def _code(text: Column, role: Column) -> Column:
    """The code of a row that is no duplicate."""
    bare = F.rtrim(F.translate(text, "\t\n\x0b\x0c\r", "     "))
    initial = F.substring(role, 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("?")
    cut = ~bare.rlike("[.!?]\\z")
    return F.when(bare == "", BLANK).when(cut, F.when(known == "?", "!").otherwise(F.upper(known))).otherwise(known)


def _light(rows: DataFrame) -> DataFrame:
    """Distinct rows without their texts, but with ``n`` copies, ``code``, ``initial`` and ``later`` (the role and text stood earlier).

    A row that the damage drops leaves one of no copies, so that its conversation is known.
    """
    there = F.col("copies") > 0
    digest = F.unhex(F.sha2("text", 256))
    own = rows.select("conv_id", *(F.when(there, c).alias(a) for c, a in ((F.col("turn"), "turn"), (F.col("role"), "role"), (digest, "digest"), (_code(F.col("text"), F.col("role")), "code"))), "copies")
    once = own.groupBy("conv_id", "turn", "role", "digest", "code").agg(F.sum("copies").alias("n"))
    # the least turn by partial aggregation: no task sees all copies of a text
    first = once.groupBy(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d")).agg(F.min(F.struct("turn")).alias("_first"))
    joined = once.join(first, F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("role").eqNullSafe(F.col("_r")) & F.col("digest").eqNullSafe(F.col("_d")))
    later = F.col("turn").isNotNull() & (F.col("_first.turn").isNull() | (F.col("turn") > F.col("_first.turn")))
    return joined.select("conv_id", "turn", "role", "digest", "code", F.substring("role", 1, 1).alias("initial"), "n", later.alias("later"))


_PIECE = "struct<turn:bigint,role:string,digest:binary,codes:string,first:string,last:string,illegal:bigint,low:bigint,high:bigint,turns:bigint>"
LEGAL = ("su", "ua", "au")


def _pieces(light: DataFrame) -> DataFrame:
    """``(conv_id, piece)``: what each task has of a conversation, as one string of codes; ordered by their first rows."""
    ordered = light.repartitionByRange(*_PLACE).sortWithinPartitions(*_PLACE)

    def piece(rows: Iterator[tuple]) -> dict:
        out = None
        codes, illegal, last, low, high, turns = [], 0, None, None, None, 0
        for _, turn, role, digest, code, initial, n, later in rows:
            out = out or {"turn": turn, "role": role, "digest": digest, "first": initial if n else None}
            if not n:
                continue
            if out["first"] is None:
                out["first"] = initial
            codes.append((DUPLICATE if later and code != BLANK else code) + (BLANK if code == BLANK else DUPLICATE) * (n - 1))
            illegal += (last is not None and last + initial not in LEGAL) + n - 1
            last = initial
            if turn is not None:
                turns += turn != high
                low, high = turn if low is None else low, turn
        return out | {"codes": "".join(codes), "last": last, "illegal": illegal, "low": low, "high": high, "turns": turns}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("digest", pa.binary()), ("codes", pa.string()), ("first", pa.string()), ("last", pa.string()), *((c, pa.int64()) for c in ("illegal", "low", "high", "turns"))])
        batches = iter(batches)
        ahead = next(batches, None)
        if ahead is None:
            return
        schema, made = pa.schema([("conv_id", ahead.schema.field("conv_id").type), ("piece", kind)]), []
        rows = (row for batch in itertools.chain([ahead], batches) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for conv, group in itertools.groupby(rows, key=lambda r: r[0]):
            made.append({"conv_id": conv, "piece": piece(group)})
            if len(made) == 1 << 10:
                yield pa.RecordBatch.from_pylist(made, schema)
                made = []
        if made:
            yield pa.RecordBatch.from_pylist(made, schema)

    return ordered.mapInArrow(run, f"conv_id {light.schema['conv_id'].dataType.simpleString()}, piece {_PIECE}")


def _judged(pieces: DataFrame) -> DataFrame:
    """Per conversation its counts, the least cost and the audit."""
    whole = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))

    def judge(parts: list[dict]) -> tuple:
        codes, illegal, last, low, high, turns = [], 0, None, None, None, 0
        for p in parts:
            codes.append(p["codes"])
            if p["last"] is not None:
                illegal += p["illegal"] + (last is not None and last + p["first"] not in LEGAL)
                last = p["last"]
            if p["low"] is not None:
                turns += p["turns"] - (p["low"] == high)
                low, high = p["low"] if low is None else low, p["high"]
        codes = "".join(codes)
        cost, audit = audit_of(codes)
        gaps = 0 if low is None else high - low + 1 - turns
        cut = sum(codes.count(c) for c in TRUNCATED)
        return len(codes), gaps, codes.count(BLANK), codes.count(DUPLICATE), cut, illegal, cost, audit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [*zip(*map(judge, batch.column(1).to_pylist()), strict=True)] or [()] * 8
            yield pa.record_batch([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:7]), pa.array(columns[7], pa.string())], names=["conv_id", "n_rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

    return whole.mapInArrow(run, _SCHEMA.format(pieces.schema["conv_id"].dataType.simpleString()))


def audits(rows: DataFrame) -> DataFrame:
    """Counts of faults, cost and audit of every conversation of ``rows(conv_id, turn, role, text, copies)``."""
    return _judged(_pieces(_light(rows)))


def _beside(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """All rows in their conversations' order, behind the conversation's audit."""
    facts = [c for c in judged.columns if c != "conv_id"]
    heads = judged.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(b"").alias("digest"), F.lit("").alias("text"), F.lit(0).alias("copies"), F.struct(*facts).alias("facts"))
    texts = _with_digest(rows).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "digest", "text", "copies", F.lit(None).cast(heads.schema["facts"].dataType).alias("facts"))
    return small_batches(heads.unionByName(texts)).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *_PLACE[1:])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[tuple[str, str]]]]:
    """Every conversation's facts, and its rows as they come."""
    columns = ("conv_id", "role", "text", "copies", "facts")
    rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True))
    for conv, group in itertools.groupby(rows, key=lambda r: r[0]):
        facts = next(group)[4]
        yield {"conv_id": conv} | facts, ((role, text) for _, role, text, copies, _ in group for _ in range(copies))


def repair_digests(rows: DataFrame) -> DataFrame:
    """``audits`` with ``repaired_sha256``, of the repaired ``role:text`` joined by newlines."""
    judged = audits(rows)
    beside = _beside(rows, judged)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        ahead = next(batches, None)
        if ahead is None:
            return
        made = []
        schema = pa.schema([("conv_id", ahead.schema.field("conv_id").type), *((c, pa.int64()) for c in ("n_rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])
        for facts, own in _groups(itertools.chain([ahead], batches)):
            digest, between = hashlib.sha256(), b""
            for role, text in repaired(facts["audit"], own):
                digest.update(between + f"{role}:{text}".encode())
                between = b"\n"
            made.append(facts | {"repaired_sha256": digest.hexdigest()})
            if len(made) == 1 << 10:
                yield pa.RecordBatch.from_pylist(made, schema)
                made = []
        if made:
            yield pa.RecordBatch.from_pylist(made, schema)

    return beside.mapInArrow(run, f"{_SCHEMA.format(rows.schema['conv_id'].dataType.simpleString())}, repaired_sha256 string")


def repair(conversations: DataFrame) -> DataFrame:
    """``(conv_id, place, role, text)`` of repaired conversations, numbered from 0; what is inserted has an empty text."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text"), F.lit(1).alias("copies"))
    beside = _beside(rows, audits(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        ahead = next(batches, None)
        if ahead is None:
            return
        schema, made = pa.schema([("conv_id", ahead.schema.field("conv_id").type), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())]), []
        for facts, own in _groups(itertools.chain([ahead], batches)):
            for place, (role, text) in enumerate(repaired(facts["audit"], own)):
                made.append({"conv_id": facts["conv_id"], "place": place, "role": role, "text": text})
                if len(made) == 1 << 10:
                    yield pa.RecordBatch.from_pylist(made, schema)
                    made = []
        if made:
            yield pa.RecordBatch.from_pylist(made, schema)

    return beside.mapInArrow(run, f"conv_id {conversations.schema['conv_id'].dataType.simpleString()}, place long, role string, text string")


def op12_repair(spark, sf_dir: str) -> DataFrame:
    return repair_digests(damaged(table(spark, sf_dir, "conversations"))).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
