"""Mixing sources to target weights, with soft membership.

A classifier of the labelled table's domains (clean, toxic, junk) gives every document a posterior over
domains.  Each document gets a rate, how often it is to be seen.  The rates minimise the squared misses of
the domains' expected token totals, ``sum_d rate_d tokens_d posterior_dk`` against the target, each divided
by the domain's present total, plus ``PULL`` times the squared distance (by tokens) from rate 1.

Without a total no document is seen twice.  The domain of the greatest weight leads; every other may have so many tokens to one of
its as their weights say.  Of all rates from 0 to 1 that keep to this, those closest to 1 are taken (squared distance, by tokens), misses
being weighed as above.  A domain that has less than its share is left whole and lowers no other.  If that would leave less than
``LEAST`` of the leading domain, because no documents are pure enough, the shares asked for are moved halfway to the present ones
until it does not.  With a total (or ``once=False``: the leading domain whole) documents are repeated as the targets ask.

Both problems are solved in their dual, which has one multiplier a domain.  A document's gradient is its posterior times the
misses, so all steps taken so far sum to one vector of the domains, and a document's rate is the projection of 1 less its posterior times
that vector.  The projected gradient steps are scaled by the inverse of the free documents' Gram matrix (those between
the bounds), which makes them damped Newton steps, and halved until the dual objective falls as it should.  A pass
over the documents is thus one native aggregation to a few sums.  The loop ends when the optimality condition holds to
``ENOUGH`` of every domain's total; if it does not within ``PASSES``, or no step lets the objective fall, it raises.
Rates become whole copies by a hash of the document, so that expected totals hold.

Tokens are words, unless ``tokens`` names a column of counts (those of ``token_counts``, say): only ratios of
totals count here, and counting by a tokenizer costs as much again as everything else.

Defined cases: a null or empty text has 0 tokens and a posterior like any other; a domain that nothing is
labelled with gets posterior 0 and its weight goes to the others; without labels every document is
"clean" with rate 1; separators of words are the contract's six; documents with a null id are mixed like others; repeated rows get the same rate;
an empty table gives no row; further columns are carried by ``mixed`` and ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import quality_classifier as qc
from .common import keep, slices, table

DOMAINS = ("clean", "toxic", "junk")
TARGETS = {"clean": 0.96, "toxic": 0.02, "junk": 0.02}
PULL, ENOUGH, PASSES, LEAST = 1e-6, 1e-7, 200, 0.5


def domain_of(labels: DataFrame) -> DataFrame:
    """``(doc_id, class)`` of the labelled table: junk if the quality is 0, else toxic if so marked, else clean."""
    per = labels.where(F.col("doc_id").isNotNull() & F.coalesce("quality", "toxic").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    return per.select("doc_id", F.when(F.col("q") == 0, 2).when(F.col("t") == 1, 1).otherwise(0).alias("class"))


def posteriors(docs: DataFrame, labels: DataFrame, *carry: str, tokens: str | None = None) -> DataFrame:
    """``carry`` columns, ``n_tokens`` and ``posterior`` (an array in the order of DOMAINS) of every document."""
    models = qc.train_classes(docs, domain_of(labels), len(DOMAINS))
    shared = docs.sparkSession.sparkContext.broadcast(models)  # of fixed size
    counts = F.coalesce(F.col(tokens).cast("long"), F.lit(0)) if tokens else F.lit(None).cast("long")
    inputs = qc._inputs(docs.withColumn("_tokens", counts), "_tokens", *carry)
    schema = T.StructType([*inputs.select(*carry).schema, T.StructField("n_tokens", T.LongType()), T.StructField("posterior", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = [k for k, m in enumerate(shared.value) if m is not None]
        for part in slices(batches):
            p = np.zeros((part.num_rows, len(DOMAINS)))
            if there:
                p[:, there] = np.stack(qc.score_batch(part, [shared.value[k] for k in there]), 1) + 1e-12
                p /= p.sum(1, keepdims=True)
            else:
                p[:, 0] = 1
            n = part.column("_tokens") if tokens else pa.array([len((t or "").encode().split()) for t in part.column("text").to_pylist()], pa.int64())
            yield pa.record_batch([*(part.column(c) for c in carry), n, pa.array(list(p), pa.list_(pa.float64()))], names=[*carry, "n_tokens", "posterior"])

    return inputs.mapInArrow(run, schema)


def _moved(steps: np.ndarray) -> Column:
    return sum((F.get("posterior", F.lit(k)) * float(x) for k, x in enumerate(steps)), F.lit(0.0))


def rate_of(steps: np.ndarray, once: bool = False) -> Column:
    """The rate of a document by its ``posterior``: 1 less what all steps together say, projected on ``>= 0`` (``once``: and ``<= 1``)."""
    rate = F.greatest(F.lit(0.0), 1.0 - _moved(steps))
    return F.least(F.lit(1.0), rate) if once else rate


def wanted(have: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The domains' totals if none is to be repeated and a scarce one lowers no other; of equal weights the larger domain leads."""
    first = max(range(len(have)), key=lambda k: (weight[k], have[k]))
    return np.minimum(weight * (have[first] / weight[first]), have)


class NotReached(RuntimeError):
    """The rates did not come to satisfy the optimality condition."""


def fit_rates(members: DataFrame, targets: dict[str, float], total: float | None = None) -> tuple[np.ndarray, list[dict]]:
    """The sum of all steps (see ``rate_of``), and per pass the domains' totals; ``members`` has n_tokens and posterior."""
    size = len(DOMAINS)
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    p, n = [F.get("posterior", F.lit(k)) for k in range(size)], F.col("n_tokens").cast("double")

    def sums(steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """The domains' totals, the free documents' Gram matrix, and half the squared rates by tokens."""
        rate = rate_of(steps)
        got = members.agg(*(F.sum(n * rate * x) for x in p), *(F.sum(F.when(rate > 0, n * p[i] * p[j])) for i, j in pairs), F.sum(n * rate * rate) / 2).first()
        got = [x or 0.0 for x in got]
        gram = np.zeros((size, size))
        for (i, j), x in zip(pairs, got[size:-1], strict=True):
            gram[i, j] = gram[j, i] = x
        return np.array(got[:size]), gram, got[-1]

    steps = np.zeros(size)
    have, gram, half = sums(steps)
    weight = np.array([targets.get(d, 0.0) for d in DOMAINS]) * (have > 0)
    if not weight.sum():
        return steps, []
    weight /= weight.sum()
    goal = weight * total if total is not None else wanted(have, weight)
    there, pull, now, log = have > 0, PULL * have, have, []
    for _ in range(PASSES):
        log.append({d: float(x) for d, x in zip(DOMAINS, now, strict=True)})
        slope = np.where(there, now - goal - pull * steps, 0.0)
        if (np.abs(slope) <= ENOUGH * have).all():
            return steps, log
        # the scaled gradient step, halved until the dual objective falls as it should
        step = np.zeros(size)
        step[there] = np.linalg.solve((gram + np.diag(pull + 1e-12 * have))[np.ix_(there, there)], slope[there])
        objective = half + goal @ steps + pull @ steps**2 / 2
        for halvings in range(60):
            tried = steps + step / 2**halvings
            now, gram, half = sums(tried)
            if half + goal @ tried + pull @ tried**2 / 2 <= objective - 1e-4 * (slope @ step) / 2**halvings + 1e-12 * abs(objective):
                break
        else:
            raise NotReached(f"mixing: no step helps after {len(log)} passes; misses {(now - goal).tolist()}")
        steps = tried
    raise NotReached(f"mixing: misses of {dict(zip(DOMAINS, (now - goal).tolist(), strict=True))} tokens after {PASSES} passes")


def fit_once(members: DataFrame, targets: dict[str, float]) -> tuple[np.ndarray, list[dict]]:
    """As ``fit_rates``, for rates of 1 at most: every domain but the leading one has a bound in proportion to that one."""
    size = len(DOMAINS)
    p, n, log = [F.get("posterior", F.lit(k)) for k in range(size)], F.col("n_tokens").cast("double"), []
    have = np.array([x or 0.0 for x in members.agg(*(F.sum(n * x) for x in p)).first()])
    weight = np.array([targets.get(d, 0.0) for d in DOMAINS]) * (have > 0)
    if not weight.sum():
        return np.zeros(size), log
    lead = max(range(size), key=lambda k: (weight[k], have[k]))
    others = [k for k in range(size) if k != lead and have[k] > 0]
    pairs = [(i, j) for i in range(len(others)) for j in range(i, len(others))]
    ratio, pull = weight[others] / weight[lead], PULL * have[others]

    def all_steps(own: np.ndarray) -> np.ndarray:
        steps = np.zeros(size)
        steps[others], steps[lead] = own, -(ratio * own).sum()
        return steps

    def sums(own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """The domains' totals, what is beyond the bounds, the Gram matrix of the free documents, and the objective's sum over documents."""
        steps = all_steps(own)
        moved, rate = _moved(steps), rate_of(steps, True)
        beyond = [p[k] - float(r) * p[lead] for k, r in zip(others, ratio, strict=True)]
        free = (rate > 0) & (rate < 1)
        half = F.sum(n * F.when(moved < 0, 0.5 - moved).otherwise(rate * rate / 2))
        row = [x or 0.0 for x in members.agg(*(F.sum(n * rate * x) for x in p), *(F.sum(F.when(free, n * beyond[i] * beyond[j])) for i, j in pairs), half).first()]
        gram = np.zeros((len(others), len(others)))
        for (i, j), x in zip(pairs, row[size:-1], strict=True):
            gram[i, j] = gram[j, i] = x
        now = np.array(row[:size])
        return now, now[others] - ratio * now[lead], gram, row[-1] + float(pull @ own**2) / 2

    while True:
        own = np.zeros(len(others))
        now, beyond, gram, objective = sums(own)
        for _ in range(PASSES):
            log.append({d: float(x) for d, x in zip(DOMAINS, now, strict=True)})
            slope = beyond - pull * own
            active = (own > 0) | (slope > 0)
            if (np.abs(slope[active]) <= ENOUGH * have[others][active]).all():
                break
            step = np.zeros(len(others))
            step[active] = np.linalg.solve((gram + np.diag(pull + 1e-9 * have[others]))[np.ix_(active, active)], slope[active])
            for halvings in range(60):
                tried = np.maximum(0, own + step / 2**halvings)
                now, beyond, gram, then = sums(tried)
                if then <= objective - 1e-4 * (slope @ (tried - own)) + 1e-12 * abs(objective):
                    break
            else:
                raise NotReached(f"mixing: no step helps after {len(log)} passes; beyond the bounds {beyond.tolist()}")
            own, objective = tried, then
        else:
            raise NotReached(f"mixing: beyond the bounds by {beyond.tolist()} tokens after {PASSES} passes")
        if now[lead] >= LEAST * have[lead]:
            return all_steps(own), log
        ratio = (ratio + have[others] / have[lead]) / 2


def fitted(members: DataFrame, targets: dict[str, float], total: float | None, once: bool) -> np.ndarray:
    return (fit_once(members, targets) if once and total is None else fit_rates(members, targets, total))[0]


def with_rates(members: DataFrame, steps: np.ndarray, doc_id: str = "doc_id", once: bool = False) -> DataFrame:
    """``members`` with ``rate`` and ``copies``: the rate as whole copies, the fraction by the id's hash."""
    chance = F.pmod(F.xxhash64(F.coalesce(F.col(doc_id), F.lit(-1)), F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    return members.withColumn("rate", rate_of(steps, once)).withColumn("copies", F.floor(F.col("rate") + chance).cast("int"))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, total: float | None = None, tokens: str | None = None, once: bool = True) -> DataFrame:
    """``(doc_id, n_tokens, posterior, rate, copies)`` of every document; without a total, one copy of each at most unless ``once`` is false."""
    members = keep(posteriors(docs, labels, "doc_id", tokens=tokens), "posteriors")
    once = once and total is None
    return with_rates(members, fitted(members, targets or TARGETS, total, once), once=once)


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, total: float | None = None, tokens: str | None = None, once: bool = True) -> DataFrame:
    """The documents themselves, each row as often as its rate says, in the columns they came in."""
    rows = docs.withColumn("_row", F.struct(*docs.columns))  # so that no column of theirs meets one made here
    members = keep(posteriors(rows, labels, "_row", tokens=tokens), "posteriors")
    once = once and total is None
    copies = with_rates(members, fitted(members, targets or TARGETS, total, once), "_row.doc_id", once).where("copies > 0")
    if once:
        return copies.select("_row.*")
    return copies.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_tokens", *(F.get("posterior", F.lit(k)).alias(f"p_{d}") for k, d in enumerate(DOMAINS)), "rate", "copies")
