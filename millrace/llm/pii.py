"""Personal data: fixed patterns, and a character-level bidirectional LSTM with a CRF that finds what they miss.

The patterns (addresses of mail and of machines, payment cards, phones) are found in linear time.  The network is
trained in numpy from labelled spans: windows of text around spans, half of them in disguise (an at-sign or a dot spelt
out, a phone without its plus, other separators), and windows with digits or at-signs but no span.  Without labelled
spans of its own the query takes those of the patterns in a sample of documents, bounded by ``TRAIN_DOCS`` and ``TRAIN_WINDOWS``;
windows with matches that fail (a card number by its check digit) teach nothing and are left out.

A text is cut into windows of ``WINDOW`` characters every ``STRIDE``.  Each is decoded by itself (Viterbi; the confidence
of a span is the least marginal of its tags), then the spans of all windows of a text are reconciled: equal ones
add their confidence, and the set without overlaps of the greatest total is taken (weighted intervals), beside the patterns'
own spans, which stay.  A span must be sound for its kind (``sound``: digits, parts, check digit), so only windows with a
digit or an at-sign in some spelling can have one; the others need not be decoded, and are not.

Defined cases: a null or empty text has no span; offsets are code points; repeated rows have equal results; a null id
stays; without a labelled span in the sample the patterns' spans are all; an empty table gives no row; further columns
are carried if named and ignored otherwise.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, small_batches, table

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE, HIDDEN = 128, 64, 24
TRAIN_DOCS, TRAIN_WINDOWS, STEPS, BATCH, RATE, SURE = 20_000, 3_000, 400, 32, 0.01, 0.8
#: Disguises of a labelled span that are learned beside it.
DISGUISES = 3

# --- patterns --------------------------------------------------------------------------------------------------

_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    """Whether the last digit of a card's number checks the others."""
    own = [int(d) for d in reversed(digits)]
    return sum(own[::2]) % 10 == -sum(2 * d - 9 * (d > 4) for d in own[1::2]) % 10


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Around every at-sign, so that a long run without one costs nothing."""
    end, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > end and not _NOT_LOCAL.match(text, begin - 1):
            begin -= 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            yield begin, domain.end()
            end = domain.end()
        at = text.find("@", max(end, at + 1))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _DOTTED.finditer(text):
        parts = [p.span() for p in re.finditer("[0-9]+", m[0])] if "." in m[0] else []
        for k in range(0, len(parts) - 3, 4):
            yield m.start() + parts[k][0], m.start() + parts[k + 3][1]


def sound(kind: str, value: str) -> bool:
    """Whether a value can be of its kind at all, however it is spelt."""
    digits = "".join(_DIGITS.findall(value))
    if kind == "email":
        plain = re.sub(r"\s*[\[(]?\s*(?:@|＠|\bat\b)\s*[\])]?\s*", "@", re.sub(r"\s*[\[(]\s*(?:dot|\.)\s*[\])]\s*", ".", value, flags=re.I), count=1, flags=re.I)
        return re.fullmatch(r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)+", plain) is not None
    if kind == "ip":
        parts = re.findall("[0-9]+", value)
        return len(parts) == 4 and all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in parts)
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return 8 <= len(digits) <= 15


def matches(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The patterns' spans by kind and start, and matches that have all of a kind's form but one check (digits, or a part's size)."""
    good, bad = [], []
    for kind, found in (("email", _emails(text)), ("ip", _ips(text)), ("card", (m.span() for m in _CARD.finditer(text))), ("phone", (m.span() for m in _PHONE.finditer(text)))):
        for a, z in found:
            if kind == "email" or sound(kind, text[a:z]):
                good.append((kind, a, z))
            elif kind == "ip" or (kind == "card" and 16 <= len(_DIGITS.findall(text[a:z])) <= 19):
                bad.append((kind, a, z))
    return good, bad


#: What a span of any kind must have: a digit, or an at-sign in some spelling.
_SIGN = re.compile(r"[0-9@＠]|[\[(]\s*at\s*[\])]", re.I)

# --- the network -------------------------------------------------------------------------------------------------

TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind
#: Transitions that cannot be: to the inside of a kind from anything but its begin or inside.
ALLOWED = np.array([[not (to and to % 2 == 0) or at in (to, to - 1) for to in range(TAGS)] for at in range(TAGS)])
_PUNCTUATION = "@.-_%+()[]{}<>:;,!?/\\\"'#*$&|=~^` \n\t"
CHARS = 5 + 26 + len(_PUNCTUATION)
_CODES = np.full(0x3000, 4, np.int16)  # 0 is padding, 1 a digit, 3 a letter beyond ASCII, 4 anything else
_CODES[0x30:0x3A] = 1
_CODES[0xC0:0x2000] = 3
for _i in range(26):
    _CODES[0x41 + _i] = _CODES[0x61 + _i] = 5 + _i
for _i, _c in enumerate(_PUNCTUATION):
    _CODES[ord(_c)] = 31 + _i


def encoded(windows: list[str]) -> np.ndarray:
    """Windows as rows of character classes, padded."""
    out = np.zeros((len(windows), WINDOW), np.int16)
    for row, text in zip(out, windows, strict=True):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        row[: len(points)] = _CODES[np.minimum(points, len(_CODES) - 1)]
    return out


class Net(NamedTuple):
    """Input tables and recurrent weights of both directions, the output layer, and the CRF's transitions."""

    forth_in: np.ndarray
    forth: np.ndarray
    back_in: np.ndarray
    back: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    moves: np.ndarray


def new_net(hidden: int = HIDDEN, seed: int = 5) -> Net:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 0.15, shape)
    tables = [draw(CHARS, 4 * hidden) for _ in range(2)]
    for t in tables:
        t[:, hidden : 2 * hidden] += 1.0  # remember at first
    return Net(tables[0], draw(hidden, 4 * hidden), tables[1], draw(hidden, 4 * hidden), draw(2 * hidden, TAGS), np.zeros(TAGS), np.zeros((TAGS, TAGS)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _lstm(codes: np.ndarray, table_in: np.ndarray, own: np.ndarray, keep_all: bool) -> tuple[np.ndarray, list]:
    """States after every step, ``(steps, rows, hidden)``, and what the way back needs."""
    n, steps = codes.shape
    hidden = own.shape[0]
    h = c = np.zeros((n, hidden), own.dtype)
    states, kept = np.empty((steps, n, hidden), own.dtype), []
    for t in range(steps):
        z = table_in[codes[:, t]] + h @ own
        gates, g = _sigmoid(z[:, : 3 * hidden]), np.tanh(z[:, 3 * hidden :])
        i, f, o = gates[:, :hidden], gates[:, hidden : 2 * hidden], gates[:, 2 * hidden :]
        before, old = h, c
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        states[t] = h
        if keep_all:
            kept.append((before, old, i, f, o, g, tc))
    return states, kept


def _lstm_back(codes: np.ndarray, own: np.ndarray, kept: list, d_states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the input table and the recurrent weights."""
    n, steps = codes.shape
    hidden = own.shape[0]
    d_z, d_own = np.empty((steps, n, 4 * hidden), own.dtype), np.zeros_like(own)
    dh = dc = np.zeros((n, hidden), own.dtype)
    for t in range(steps - 1, -1, -1):
        before, old, i, f, o, g, tc = kept[t]
        dh = dh + d_states[t]
        dc = dc + dh * o * (1 - tc**2)
        dz = np.concatenate([dc * g * i * (1 - i), dc * old * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g**2)], 1)
        d_own += before.T @ dz
        d_z[t] = dz
        dh, dc = dz @ own.T, dc * f
    # sums by character class
    flat = codes.T.ravel()
    order = np.argsort(flat, kind="stable")
    there, begins = np.unique(flat[order], return_index=True)
    d_in = np.zeros((CHARS, 4 * hidden), own.dtype)
    d_in[there] = np.add.reduceat(d_z.reshape(-1, 4 * hidden)[order], begins)
    return d_in, d_own


def emissions(net: Net, codes: np.ndarray, keep_all: bool = False) -> tuple[np.ndarray, tuple]:
    """Tag scores ``(steps, rows, tags)``."""
    forth, kept_forth = _lstm(codes, net.forth_in, net.forth, keep_all)
    back, kept_back = _lstm(codes[:, ::-1], net.back_in, net.back, keep_all)
    both = np.concatenate([forth, back[::-1]], 2)
    return both @ net.out + net.bias, (both, kept_forth, kept_back)


def marginals(scores: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tags' marginals, the expected moves, and the log partition sum of every row."""
    steps = len(scores)
    top = scores.max(2, keepdims=True)
    e, m = np.exp(scores - top), np.where(ALLOWED, np.exp(moves), 0.0)
    a, scale = np.empty_like(e), np.empty((steps, scores.shape[1], 1))
    for t in range(steps):
        a[t] = e[t] * (a[t - 1] @ m if t else 1.0)
        scale[t] = a[t].sum(1, keepdims=True)
        a[t] /= scale[t]
    b, moved = np.ones_like(e), np.zeros_like(m)
    for t in range(steps - 2, -1, -1):
        ahead = e[t + 1] * b[t + 1] / scale[t + 1]
        moved += m * (a[t].T @ ahead)
        b[t] = ahead @ m.T
    return a * b, moved, (np.log(scale) + top).sum((0, 2))


def viterbi(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best tags ``(steps, rows)``."""
    steps, n, _ = scores.shape
    m = np.where(ALLOWED, moves, -1e9)
    best, came = scores[0], np.zeros(scores.shape, np.int8)
    for t in range(1, steps):
        every = best[:, :, None] + m
        came[t] = every.argmax(1)
        best = every.max(1) + scores[t]
    path, rows = np.empty((steps, n), np.int8), np.arange(n)
    path[-1] = best.argmax(1)
    for t in range(steps - 1, 0, -1):
        path[t - 1] = came[t, rows, path[t]]
    return path


def loss_and_gradient(net: Net, codes: np.ndarray, tags: np.ndarray) -> tuple[float, Net]:
    """The mean negative log likelihood of ``tags`` (rows of window's tags), and its gradient."""
    n, steps = codes.shape
    scores, (both, kept_forth, kept_back) = emissions(net, codes, True)
    p, moved, log_sum = marginals(scores, net.moves)
    gold, rows = tags.T, np.arange(n)
    own = sum(scores[t, rows, gold[t]] for t in range(steps)) + sum(net.moves[gold[t - 1], gold[t]] for t in range(1, steps))
    d_scores, d_moves = p.copy(), moved
    for t in range(steps):
        d_scores[t, rows, gold[t]] -= 1
    np.add.at(d_moves, (gold[:-1].ravel(), gold[1:].ravel()), -1.0)
    d_both = d_scores @ net.out.T
    hidden = net.forth.shape[0]
    forth_in, forth = _lstm_back(codes, net.forth, kept_forth, d_both[:, :, :hidden])
    back_in, back = _lstm_back(codes[:, ::-1], net.back, kept_back, d_both[::-1, :, hidden:])
    flat = d_scores.reshape(-1, TAGS)
    made = Net(forth_in, forth, back_in, back, both.reshape(-1, 2 * hidden).T @ flat, flat.sum(0), d_moves)
    return float((log_sum - own).mean()), Net(*(g / n for g in made))


def tags_of(text: str, spans: list[tuple[str, int, int]]) -> np.ndarray:
    """A window's tags; a span that begins before it has only insides."""
    out = np.zeros(WINDOW, np.int8)
    for kind, a, z in spans:
        k = 1 + 2 * KINDS.index(kind)
        out[max(a, 0) : min(z, len(text))] = k + 1
        if a >= 0:
            out[a] = k
    return out


def train(windows: list[tuple[str, list[tuple[str, int, int]]]], steps: int = STEPS, hidden: int = HIDDEN, seed: int = 5) -> Net | None:
    """A network by so many steps of Adam over shuffled batches; none without a span to learn from."""
    if not any(spans for _, spans in windows):
        return None
    codes, tags = encoded([t for t, _ in windows]), np.stack([tags_of(t, spans) for t, spans in windows])
    net, rng = Net(*(w.astype(np.float32) for w in new_net(hidden, seed))), np.random.default_rng(seed)
    first, second, order = [np.zeros_like(w) for w in net], [np.zeros_like(w) for w in net], np.empty(0, np.int64)
    for step in range(1, steps + 1):
        if len(order) < min(BATCH, len(codes)):
            order = np.concatenate([order, rng.permutation(len(codes))])
        pick, order = order[:BATCH], order[BATCH:]
        _, gradient = loss_and_gradient(net, codes[pick], tags[pick])
        size = max(1.0, float(np.sqrt(sum((g**2).sum() for g in gradient))) / 5)
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for w, g, m, v in zip(net, gradient, first, second, strict=True):
            m += 0.1 * (g / size - m)
            v += 0.01 * ((g / size) ** 2 - v)
            w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


# --- windows and spans -------------------------------------------------------------------------------------------


def windows_of(text: str) -> list[int]:
    """Where the windows of a text begin that can hold a span."""
    n, out = len(text), []
    for m in _SIGN.finditer(text):
        last = m.start() // STRIDE
        for k in range(max(0, last - WINDOW // STRIDE + 1), last + 1):
            at = k * STRIDE
            if (not out or out[-1] < at) and (at == 0 or at + WINDOW - STRIDE < n):
                out.append(at)
    return out


def decoded(net: Net, windows: list[str]) -> list[list[tuple[int, int, int, float, bool]]]:
    """Per window its spans: kind, begin, end, confidence, and whether the begin is in the window."""
    scores, _ = emissions(net, encoded(windows))
    path, sure = viterbi(scores, net.moves), marginals(scores, net.moves)[0]
    out = [[] for _ in windows]
    for row in np.flatnonzero(path.any(0)):
        own, t = path[:, row], 0
        while t < WINDOW:
            if own[t]:
                a, kind = t, (own[t] - 1) // 2
                t += 1
                while t < WINDOW and own[t] == 2 * kind + 2:
                    t += 1
                least = float(min(sure[x, row, own[x]] for x in range(a, t)))
                out[row].append((int(kind), a, t, least, own[a] % 2 == 1))
            else:
                t += 1
    return out


def reconciled(found: dict[tuple[int, int, int], float], taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Of spans (kind, begin, end) with confidences those without overlaps, with each other or with ``taken``, of the greatest total."""
    held = sorted((a, z) for _, a, z in taken)
    begins, reach = [a for a, _ in held], np.maximum.accumulate([z for _, z in held]) if held else []

    def free(a: int, z: int) -> bool:
        k = np.searchsorted(begins, z)
        return not k or reach[k - 1] <= a

    spans = sorted(((z, a, k, w) for (k, a, z), w in found.items() if free(a, z)))
    ends, best, last = [s[0] for s in spans], [0.0], []
    for n, (_, a, _, w) in enumerate(spans):
        k = int(np.searchsorted(ends[:n], a, side="right"))
        take = best[k] + w
        last.append(k if take > best[n] else None)
        best.append(max(take, best[n]))
    out, n = [], len(spans)
    while n:
        if last[n - 1] is None:
            n -= 1
        else:
            z, a, k, _ = spans[n - 1]
            out.append((KINDS[k], a, z))
            n = last[n - 1]
    return out


def added_spans(net: Net | None, texts: list[str], taken: list[list[tuple[str, int, int]]], sure: float = SURE) -> list[list[tuple[str, int, int]]]:
    """What the network finds in each text besides ``taken``; windows of many texts are decoded together."""
    found: list[dict] = [{} for _ in texts]
    places = ((i, at) for i, text in enumerate(texts) for at in windows_of(text)) if net else iter(())
    while batch := [p for _, p in zip(range(256), places)]:  # noqa: B905
        for (i, at), spans in zip(batch, decoded(net, [texts[i][at : at + WINDOW] for i, at in batch]), strict=True):
            text = texts[i]
            for kind, a, z, least, whole in spans:
                cut = z == WINDOW and at + WINDOW < len(text)  # another window has all of it
                if whole and not cut and at + z <= len(text) and least >= sure and sound(KINDS[kind], text[at + a : at + z]):
                    own = (kind, at + a, at + z)
                    found[i][own] = found[i].get(own, 0.0) + least
    return [reconciled(f, t) if f else [] for f, t in zip(found, taken, strict=True)]


# --- labelled windows ----------------------------------------------------------------------------------------------


def disguised(kind: str, value: str, rng: np.random.Generator) -> str:
    """A value as the patterns do not know it."""
    pick = lambda *options: options[rng.integers(len(options))]
    if kind == "email":
        name, _, host = value.partition("@")
        dot = pick(".", ".", " (dot) ", "[.]")
        return name + pick(" @ ", "(at)", " (at) ", " [at] ", "[at]", "＠") + host.replace(".", dot)
    if kind == "ip":
        return value.replace(".", pick("[.]", " . ", "(.)", "(dot)"))
    if kind == "card":
        digits = "".join(_DIGITS.findall(value))
        return pick(".", "/", "_", " - ").join(digits[k : k + 4] for k in range(0, len(digits), 4))
    bare = value[1:]
    return pick(bare, "00" + bare, "+ " + bare, "(+" + bare[:1] + ")" + bare[1:])


def labelled_windows(text: str, spans: list[tuple[str, int, int]], avoid: list[tuple[str, int, int]] = ()) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Windows of one labelled text: around every span, as it is and in disguise, and one around every other sign."""
    rng = np.random.default_rng(int.from_bytes(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()[:4], "big"))
    signs = [m.start() for m in _SIGN.finditer(text)]
    held = sorted((a, z, k) for k, a, z in spans)
    begins = [a for a, _, _ in held]
    plain = [s for s in signs[:: max(1, len(signs) // 8)] if not any(a <= s < z for a, z, _ in held)]
    out = []
    for centre, disguise in [(a, d) for a in begins for d in (False, *(True,) * DISGUISES)] + [(s, False) for s in plain]:
        start = max(0, centre - int(rng.integers(WINDOW - 8)))
        made, own, at = [], [], start
        for a, z, kind in held:
            if a < start + WINDOW and z > start and a >= at:
                made.append(text[at:a])
                value = text[a:z]
                if disguise and (a == centre or rng.random() < 0.5):
                    value = disguised(kind, value, rng)
                begin = sum(map(len, made))
                made.append(value)
                own.append((kind, begin, begin + len(value)))
                at = z
        rest = text[at : start + 2 * WINDOW]
        if any(a < start + 2 * WINDOW and z > start for _, a, z in avoid):
            continue
        own_text = ("".join(made) + rest)[:WINDOW]
        out.append((own_text, [(k, a, z) for k, a, z in own if a < len(own_text)]))
    return out


_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("end", pa.int64())]))


def _rows(spans: list[tuple[str, int, int]]) -> list[dict]:
    return [{"kind": k, "begin": a, "end": z} for k, a, z in spans]


def pattern_labels(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """``(text, spans, avoid)`` of a bounded sample of documents, by the patterns: the labels if there are no better ones."""
    n = docs.count()
    drawn = small_batches(docs).select("text").where(F.pmod(F.xxhash64("text"), F.lit(max(n, train_docs))) < train_docs).where(F.col("text").rlike("[0-9@]"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [matches(t) for t in part.column(0).to_pylist()]
            yield pa.record_batch([part.column(0), *(pa.array([_rows(f[k]) for f in found], _ARROW_SPANS) for k in (0, 1))], names=["text", "spans", "avoid"])

    return drawn.mapInArrow(run, T.StructType([T.StructField("text", T.StringType()), T.StructField("spans", _SPANS), T.StructField("avoid", _SPANS)]))


def fit(labelled: DataFrame, train_windows: int = TRAIN_WINDOWS) -> Net | None:
    """A network from ``labelled(text, spans, avoid)``, of the windows with the least hashes, ``train_windows`` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacked = lambda spans: [(s["kind"], s["begin"], s["end"]) for s in spans or []]
        for part in slices(batches, 64):
            made = [w for t, s, b in zip(*(part.column(c).to_pylist() for c in ("text", "spans", "avoid")), strict=True) if t for w in labelled_windows(t, unpacked(s), unpacked(b))]
            yield pa.record_batch([pa.array([t for t, _ in made], pa.string()), pa.array([_rows(s) for _, s in made], _ARROW_SPANS)], names=["text", "spans"])

    every = labelled.select("text", "spans", "avoid").mapInArrow(run, T.StructType([T.StructField("text", T.StringType()), T.StructField("spans", _SPANS)])).distinct()
    rows = every.orderBy(F.xxhash64("text"), "text").limit(train_windows).collect()  # of set number and size
    return train([(r.text, [(s.kind, s.begin, s.end) for s in r.spans]) for r in rows])


# --- documents -----------------------------------------------------------------------------------------------------


def find(docs: DataFrame, net: Net | None, *carry: str, sure: float = SURE) -> DataFrame:
    """``(doc_id, base, added)`` and ``carry`` of every document: spans by kind and start."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size
    inputs = small_batches(docs).select("doc_id", "text", *carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = [t or "" for t in part.column(1).to_pylist()]
            base = [matches(t)[0] if _SIGN.search(t) else [] for t in texts]
            added = added_spans(shared.value, texts, base, sure)
            order = lambda spans: sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1]))
            yield pa.record_batch([part.column(0), *(pa.array([_rows(order(s)) for s in x], _ARROW_SPANS) for x in (base, added)), *(part.column(c) for c in carry)], names=["doc_id", "base", "added", *carry])

    return inputs.mapInArrow(run, T.StructType([inputs.schema["doc_id"], T.StructField("base", _SPANS), T.StructField("added", _SPANS), *inputs.select(*carry).schema]))


def redacted(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; of overlapping ones the first counts."""
    net = fit(labelled if labelled is not None else pattern_labels(docs))
    rows = find(docs.withColumn("_row", F.struct(*docs.columns)), net, "_row")
    ordered = F.array_sort(F.concat("base", "added"), lambda a, b: F.when(a["begin"] != b["begin"], F.when(a["begin"] < b["begin"], -1).otherwise(1)).otherwise(b["end"].cast("int") - a["end"].cast("int")))
    start = F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at"))
    step = lambda acc, s: F.when(s["begin"] < acc["at"], acc).otherwise(F.struct(F.concat(acc["text"], F.substring(F.col("_row.text"), acc["at"].cast("int") + 1, (s["begin"] - acc["at"]).cast("int")), F.lit("["), s["kind"], F.lit("]")).alias("text"), s["end"].alias("at")))
    done = F.aggregate(ordered, start, step, lambda acc: F.concat(acc["text"], F.substring(F.col("_row.text"), acc["at"].cast("int") + 1, F.lit((1 << 31) - 1))))
    return rows.select(*(F.when(F.col("_row.text").isNotNull(), done).alias(c) if c == "text" else F.col(f"_row.{c}").alias(c) for c in docs.columns))


def spans_text(spans: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"], s["end"])), ",")


def op13_pii(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find(docs, fit(pattern_labels(docs)))
    rank = lambda s: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("k"), s["begin"].alias("begin"), s["end"].alias("end"), s["kind"].alias("kind"))
    every = F.array_sort(F.transform(F.concat("base", "added"), rank))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(spans_text("base"), 256).alias("base_sha256"), spans_text(every).alias("spans"))
