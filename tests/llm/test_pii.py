"""op 13: patterns against plain regular expressions, the network's gradients and decoding against all paths, spans against brute force."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    """The contract's base spans, by the expressions as they stand."""
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            double = sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits)))
            fine = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(digits) <= 19 and double % 10 == 0, "phone": 8 <= len(digits) <= 15}[kind]
            out += [(kind, *m.span())] if fine else []
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("a1@.-+ 92(_\n7é"), max_size=50))
def test_patterns(text):
    assert pii.matches(text)[0] == plain(text)


def test_patterns_take_linear_time():
    for text in ("x" * 400_000, "1" * 400_000, "1." * 200_000, "a@" * 200_000, "+1(" * 150_000, "1 " * 200_000):
        pii.matches(text)


def test_gradient(monkeypatch):
    monkeypatch.setattr(pii, "WINDOW", 9)
    net, rng = pii.new_net(hidden=2, seed=1), np.random.default_rng(0)
    codes = rng.integers(0, pii.CHARS, (3, 9)).astype(np.int16)
    tags = np.stack([pii.tags_of("x" * 9, s) for s in ([("ip", 2, 5)], [("card", -1, 3), ("phone", 6, 9)], [])])
    _, gradient = pii.loss_and_gradient(net, codes, tags)
    for w, g in zip(net, gradient, strict=True):
        for at in [np.unravel_index(k, w.shape) for k in np.argsort(-np.abs(g), axis=None)[:3]]:
            kept, out = w[at], []
            for move in (1e-5, -1e-5):
                w[at] = kept + move
                out.append(pii.loss_and_gradient(net, codes, tags)[0])
            w[at] = kept
            assert (out[0] - out[1]) / 2e-5 == pytest.approx(g[at], rel=1e-4, abs=1e-8)


def test_decoding_against_all_paths():
    rng = np.random.default_rng(2)
    scores, moves = rng.normal(0, 2, (4, 2, pii.TAGS)), rng.normal(0, 1, (pii.TAGS, pii.TAGS))
    p, _, log_sum = pii.marginals(scores, moves)
    best = pii.viterbi(scores, moves)
    for row in range(2):
        paths = [x for x in itertools.product(range(pii.TAGS), repeat=4) if all(pii.ALLOWED[a, b] for a, b in itertools.pairwise(x))]
        value = np.array([sum(scores[t, row, k] for t, k in enumerate(x)) + sum(moves[a, b] for a, b in itertools.pairwise(x)) for x in paths])
        assert tuple(best[:, row]) == paths[value.argmax()]
        weight = np.exp(value)
        assert log_sum[row] == pytest.approx(np.log(weight.sum()))
        for t, k in ((0, 0), (1, 3), (3, 4)):
            assert p[t, row, k] == pytest.approx(sum(w for w, x in zip(weight, paths, strict=True) if x[t] == k) / weight.sum())


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.tuples(st.integers(0, 3), st.integers(0, 12), st.integers(1, 5)), st.integers(1, 9), max_size=8), st.lists(st.tuples(st.integers(0, 14), st.integers(1, 3)), max_size=2))
def test_reconciling_takes_the_best_set(found, taken):
    found = {(k, a, a + n): float(w) for (k, a, n), w in found.items()}
    taken = [("ip", a, a + n) for a, n in taken]
    apart = lambda x, y: x[2] <= y[1] or y[2] <= x[1]
    free = [s for s in found if all(apart(s, t) for t in taken)]
    best = max(sum(found[s] for s in own) for r in range(len(free) + 1) for own in itertools.combinations(free, r) if all(apart(*x) for x in itertools.combinations(own, 2)))
    got = pii.reconciled(found, taken)
    assert all(apart(x, y) for x, y in itertools.combinations(got, 2)) and all(apart(x, t) for x in got for t in taken)
    assert sum(found[pii.KINDS.index(k), a, z] for k, a, z in got) == best


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 700), st.lists(st.integers(0, 699), max_size=4))
def test_windows_hold_every_short_span(n, signs):
    text = "".join("7" if i in signs else "x" for i in range(n))
    at = pii.windows_of(text)
    for s in signs:
        for a in range(max(0, s - 60), min(s + 1, n)):
            z = min(n, a + 64)
            if s < z:
                assert any(w <= a and z <= w + pii.WINDOW for w in at)


SCHEMA = "doc_id long, text string, base string, added string"


def corpus(seed, n):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdeéfghiou", k=rng.randint(2, 9))) for _ in range(500)]

    def value(kind):
        if kind == "email":
            return f"{rng.choice(vocab).replace('é', 'e')}.{rng.randint(10, 99)}@mail{rng.randint(0, 9)}.example.com"
        if kind == "ip":
            return ".".join(str(rng.randint(1, 255)) for _ in range(4))
        if kind == "phone":
            return f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
        digits = "4" + "".join(rng.choices("0123456789", k=14))
        return next(digits + c for c in "0123456789" if pii.luhn(digits + c))

    words = lambda k: " ".join(rng.choices(vocab, k=k))
    return [(words(rng.randint(3, 40)) + " ", k := pii.KINDS[i % 4], value(k), " " + words(rng.randint(3, 40))) for i in range(n)], words


@pytest.fixture(scope="module")
def net(spark):
    rows, words = corpus(1, 240)
    docs = spark.createDataFrame([(i, a + v + b) for i, (a, _, v, b) in enumerate(rows)] + [(1000 + i, words(30) + f" token {i}a{i * 7919}") for i in range(60)], "doc_id long, text string")
    return pii.fit(pii.pattern_labels(docs))


def test_finds_held_out_disguises_and_leaves_clean_texts_alone(spark, net):
    rng, (rows, words) = np.random.default_rng(4), corpus(2, 80)
    texts, want = [], []
    for a, k, v, b in rows:
        other = pii.disguised(k, v, rng)
        texts.append(a + other + b)
        want.append((k, len(a), len(a) + len(other)))
    clean = [words(200) + f" {i} version 2.{i}" for i in range(60)]
    docs = spark.createDataFrame([*enumerate(texts), *((1000 + i, t) for i, t in enumerate(clean))], "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.begin, s.end) for s in r.base + r.added] for r in pii.find(docs, net).collect()}
    hits = sum(w in got[i] for i, w in enumerate(want))
    assert hits >= 64, hits  # four in five
    assert sum(len(got[1000 + i]) for i in range(60)) <= 1


def test_odd_documents(spark, net):
    long = "x" * 5000 + " a.b@c.de " + "y" * 3000 + " 10.0.0.1"
    rows = [(1, None), (2, ""), (3, long), (3, long), (None, "mail x@y.zz or +49 (30) 1234-567"), (4, "no data"), (5, "4111 1111 1111 1111 and 256.1.1.1, 4111 1111 1111 1112")]
    docs = spark.createDataFrame([(i, t, "b", "a") for i, t in rows], SCHEMA)
    for model in (net, None):
        got = pii.find(docs, model).collect()
        assert len(got) == len(rows)
        for i, t in rows:
            assert any(r.doc_id == i and [(s.kind, s.begin, s.end) for s in r.base] == plain(t or "") for r in got)
    assert pii.find(docs.limit(0), net).count() == 0
    assert pii.fit(pii.pattern_labels(docs.limit(0))) is None
    clean = {r.text for r in pii.redacted(docs.where("doc_id > 1 OR doc_id IS NULL").drop("base", "added"), pii.pattern_labels(docs.limit(0))).collect()}
    assert "mail [email] or [phone]" in clean and long.replace("a.b@c.de", "[email]").replace("10.0.0.1", "[ip]") in clean


def test_digest_columns(spark, tmp_path):
    docs = [(1, "to a@b.co, 1.2.3.4"), (2, "4111111111111111 +1 555 123 4567"), (3, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in pii.op13_pii(spark, str(tmp_path)).collect()}
    for i, t in docs:
        base = ",".join(f"{k}:{a}:{z}" for k, a, z in plain(t or ""))
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(base.split(",")) <= set(got[i].spans.split(","))
    assert (got[1].n_email, got[1].n_ip, got[2].n_card, got[2].n_phone) == (1, 1, 1, 1)
