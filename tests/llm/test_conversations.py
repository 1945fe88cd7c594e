"""op 12: audits against all possible edits, digests and counts against a plain form, long conversations over many tasks."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, cost string"
BARE = re.compile(r"[^\x20\x09-\x0D]")
GRAMMAR = re.compile("(s?(ua)+)?")


def plain_rows(rows):
    """Rows by conversation after damage, in order."""
    space = lambda v: " " if v is None else str(v)
    out = {}
    for conv, turn, role, text, *_ in rows:
        own = out.setdefault(conv, [])
        k = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = "user" if k == 4 else space(role), "" if k == 1 else re.sub("[.!?]", "", space(text)) if k == 2 else space(text)
        own += [(turn, role, text)] * {0: 0, 3: 2}.get(k, 1)
    return {c: sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest())) for c, own in out.items()}


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = BARE.findall(text)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


PREFIX = re.compile("s?(ua)*u?")


def plain_audit(rows):
    """The cheapest and then least audit, by search from the front in the order of cost and audit, and what it makes."""
    faults, seen = faults_of(rows), set()
    heap = [(0, "", 0, "", ())]
    while True:
        cost, audit, i, initials, made = heapq.heappop(heap)
        if i == len(rows) and GRAMMAR.fullmatch(initials):
            return cost, audit, list(made)
        if (i, initials[-1:]) in seen or not PREFIX.fullmatch(initials):
            continue
        seen.add((i, initials[-1:]))
        steps = [("I", 2, i, (r, "")) for r in ("user", "assistant")]
        if i < len(rows):
            _, role, text = rows[i]
            steps.append(("D", 3, i + 1, None))
            if faults[i] not in ("blank", "duplicate"):
                left = int(faults[i] == "truncated")
                steps += [("R", 2 + left, i + 1, (r, text)) for r in ("user", "assistant")] + ([("K", left, i + 1, (role, text))] if role else [])
        for letter, price, to, turn in steps:
            heapq.heappush(heap, (cost + price, audit + letter, to, initials + (turn[0][0] if turn else ""), made + ((turn,) if turn else ())))


def plain(rows):
    out = []
    for conv, own in plain_rows(rows).items():
        faults, turns = faults_of(own), {t for t, _, _ in own if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit, made = plain_audit(own)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return sorted(out, key=repr)


def odd_rows(seed=2, n=60):
    rng = random.Random(seed)
    texts = ["Hello.", "what?", "cut off", "", "  \n", "so!", "é ", "x.\x85", None, "Hello.", "a. \t"]
    rows = []
    for conv in [None, *range(n)]:
        for _ in range(rng.randint(1, 4)):
            turn = rng.choice([None, *range(8)])
            rows.append((conv, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "ux"]), rng.choice(texts), "c"))
    return rows + rows[:3]


def test_equals_the_plain_form(spark):
    rows = odd_rows()
    got = conversations.repair_digests(conversations.damaged(spark.createDataFrame(rows, SCHEMA).repartition(4))).drop("n_rows")
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows)


def test_dropped_rows_and_empty_tables(spark):
    gone = next(t for t in range(999) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    got = conversations.repair_digests(conversations.damaged(spark.createDataFrame([(5, gone, "user", "x", "c")], SCHEMA))).drop("n_rows").collect()
    assert [tuple(r) for r in got] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert conversations.repair_digests(conversations.damaged(spark.createDataFrame([], SCHEMA))).count() == 0
    assert conversations.repair(spark.createDataFrame([], SCHEMA)).count() == 0


CODES = st.text(st.sampled_from("suaSUA?!bd"), max_size=6)


@settings(max_examples=150, deadline=None)
@given(CODES)
def test_audits_are_the_least(codes):
    role = {"s": "system", "u": "user", "a": "assistant", "?": "tool", "!": "tool", "b": "user", "d": "user"}
    rows, seen = [], 0
    for i, c in enumerate(codes):
        text = "" if c == "b" else f"t{i}" if c in "SUA!" else f"t{i}."
        rows.append((i, role[c.lower()], text))
        seen += c == "d"
    if seen:
        return
    cost, audit, made = plain_audit(rows)
    assert conversations.audit_of(codes) == (cost, audit)
    assert [*conversations.repaired(audit, ((r, t) for _, r, t in rows))] == made


def test_a_long_conversation_is_spread_over_tasks(spark):
    """One conversation with most rows: its pieces come from several tasks and make one audit."""
    rng = random.Random(1)
    rows = [(7, t, rng.choice(["user", "assistant"]), rng.choice(["a.", "b!", "c", ""]) + str(rng.randint(0, 900)) + rng.choice(".?x"), "c") for t in range(3000)] + odd_rows(n=9)
    damaged = conversations.damaged(spark.createDataFrame(rows, SCHEMA))
    own = plain_rows(rows)[7]
    faults = faults_of(own)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pieces = conversations._pieces(conversations._light(damaged)).where("conv_id = 7").collect()
        (got,) = conversations.repair_digests(damaged).where("conv_id = 7").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(pieces) > 1
    assert (got.n_rows, got.blank, got.duplicate, got.truncated) == (len(own), *(faults.count(f) for f in ("blank", "duplicate", "truncated")))
    assert got.illegal == sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
    assert got.gaps == 3000 - len({t for t, _, _ in own}) - (2999 - max(t for t, _, _ in own)) - min(t for t, _, _ in own)
    assert len(got.audit.replace("I", "")) == len(own)
    made = [*conversations.repaired(got.audit, ((r, t) for _, r, t in own))]
    assert GRAMMAR.fullmatch("".join(r[0] for r, _ in made))
    assert got.repaired_sha256 == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()


@pytest.mark.parametrize("role", ["user", "assistant"])
def test_repair_gives_whole_rows(spark, role):
    rows = [(1, 0, role, "One.", "c"), (1, 1, "assistant", "Two.", "c"), (1, 1, "assistant", "Two.", "c")]
    got = [(r.place, r.role, r.text) for r in conversations.repair(spark.createDataFrame(rows, SCHEMA)).orderBy("place").collect()]
    assert got == [(0, "user", "One."), (1, "assistant", "Two.")]
