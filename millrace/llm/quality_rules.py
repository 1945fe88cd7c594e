"""Quality rules with risk-controlled thresholds: statistics of each text, cutoffs certified on labelled holdouts.

Every rule says "reject above the cutoff" of one statistic; the candidate cutoffs are fixed beforehand, loosest
first.  The labelled good documents of each stratum (language) are halved by a hash of their id.  One half
tunes: of every rule it picks the strictest cutoff that costs it at most ``risk / rules``.  The other half
certifies: the policies "all rules, each ``s`` cutoffs looser than tuned" reject ever more as ``s`` falls, so they
are tested in that order, each at the whole level of the stratum, up to the first that fails (fixed sequence;
nothing is split among rules and cutoffs).  A policy is certified if a true false-rejection rate of ``risk``
would show as few rejections as ``k`` of ``n`` with probability at most ``delta / strata`` (the exact
binomial tail, Bonferroni over the strata).  The strictest certified policy counts, so with probability
``1 - delta`` no stratum loses more than ``risk`` of its good documents that pass the base rule to all rules together.  A stratum
without labels enough to certify anything loses nothing but to the base rule.

Everything is DataFrame functions: statistics in one row-wise pass, counts by one aggregation.

Defined cases: a null or empty text has zero words and so fails the base rule; a null language is a
stratum of its own; repeated rows are judged alike; labels that repeat count once per document (the
least quality), null labels not at all; no labels certify nothing; an empty table gives no row; further
columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_BREAKS, keep, table, text_or_empty

SYMBOLS, SPACES = "#*$%&|<>", " \t\n\x0b\x0c\r"
WINDOW = 5
RISK, DELTA = 0.05, 0.05
#: Statistic and candidate cutoffs, loosest first; a document above the cutoff is rejected.
RULES: dict[str, tuple[float, ...]] = {
    "symbols_per_word": (0.8, 0.4, 0.2, 0.1, 0.05, 0.02),
    "duplicate_lines": (0.5, 0.3, 0.2, 0.1),
    "repeated_words": (0.15, 0.1, 0.05, 0.02),
    "capitals": (0.8, 0.5, 0.3, 0.2, 0.1),
    "exclamations_per_word": (0.8, 0.5, 0.2, 0.1, 0.05),
    "mean_word_length": (24.0, 16.0, 12.0, 9.0),
}
#: How many cutoffs looser than tuned a policy can be without being empty.
LOOSEST = max(map(len, RULES.values())) - 1


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def text_statistics(docs: DataFrame, *carry: str) -> DataFrame:
    """The base counts and rule statistics of every text, with the columns named in ``carry``."""
    text = F.col("_text")
    base = docs.select(*carry, text_or_empty().alias("_text"))
    base = base.withColumn("_words", F.filter(F.split(text, WORD_BREAKS), lambda w: w != ""))
    base = base.withColumn("_lines", F.filter(F.split(text, "\n"), lambda s: _without(s, SPACES) != ""))
    base = base.select(
        *carry,
        F.size("_words").cast("long").alias("n_words"),
        F.length(_without(text, SPACES)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("_n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        (F.length(text) - F.length(_without(text, string.ascii_uppercase))).alias("_capitals"),
        (F.length(text) - F.length(_without(text, "!"))).alias("_exclamations"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    # windows as (hash, place), sorted: those found twice are neighbours
    window = lambda i: F.struct(F.xxhash64(*(F.get("_hashes", i + k) for k in range(WINDOW))).alias("h"), i.alias("p"))
    none = F.array().cast("array<struct<h:bigint,p:int>>")
    places = F.sequence(F.lit(0), F.size("_hashes") - WINDOW)
    base = base.withColumn("_sorted", F.when(F.size("_hashes") < WINDOW, none).otherwise(F.sort_array(F.transform(places, window)))).drop("_hashes")
    same = lambda x, j: F.coalesce(F.get("_sorted", j)["h"] == x["h"], F.lit(False))
    twice = F.filter("_sorted", lambda x, j: same(x, j - 1) | same(x, j + 1))
    base = base.withColumn("_twice", F.sort_array(F.transform(twice, lambda x: x["p"]))).drop("_sorted")
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("total"))
    step = lambda a, p: F.struct(p.alias("last"), (a["total"] + F.least(F.lit(WINDOW), p - a["last"])).alias("total"))
    base = base.withColumn("n_repeat_words", F.aggregate("_twice", start, step, lambda a: a["total"])).drop("_twice")
    per = lambda n, d: F.when(F.col(d) > 0, F.col(n) / F.col(d)).otherwise(0.0)
    return base.select(
        *carry, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        per("n_symbols", "n_words").alias("symbols_per_word"), per("n_dup_lines", "_n_lines").alias("duplicate_lines"),
        per("n_repeat_words", "n_words").alias("repeated_words"), per("_capitals", "word_chars").alias("capitals"),
        per("_exclamations", "n_words").alias("exclamations_per_word"), per("word_chars", "n_words").alias("mean_word_length"),
    )


def log_binomial_tail(k: Column, n: Column, p: float) -> Column:
    """ln P(Bin(n, p) <= k), by the recurrence of the terms in logarithms."""
    odds = F.log(F.lit(p / (1 - p)))
    first = n * F.log1p(F.lit(-p))
    start = F.struct(first.alias("term"), first.alias("total"))

    def step(a: Column, i: Column) -> Column:
        term = a["term"] + F.log((n - i + 1) / i) + odds
        top = F.greatest(term, a["total"])
        return F.struct(term.alias("term"), (top + F.log(F.exp(term - top) + F.exp(a["total"] - top))).alias("total"))

    steps = F.when(k < 1, F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1).cast("long"))))
    return F.aggregate(steps, start, step, lambda a: a["total"])


def tunes(doc_id: Column) -> Column:
    """Whether a labelled document is of the half that tunes."""
    return F.substring(F.md5(doc_id.cast("string").cast("binary")), 1, 1) < "8"


def _passed(rule: str) -> Column:
    """How many cutoffs of a rule, loosest first, a document does not exceed."""
    return sum(((F.col(rule) <= c).cast("int") for c in RULES[rule]), F.lit(0))


def _margins() -> dict[str, Column]:
    """Per rule, how many cutoffs looser than tuned it can be and still reject; null if the rule is off."""
    return {r: F.when(F.col("tuned")[r] >= 0, F.col("tuned")[r] - _passed(r)) for r in RULES}


def certified_policies(statistics: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """``(stratum, tuned, looser)``: per rule the place of the tuned cutoff (-1: none), and by how many cutoffs the certified policy is looser (null: none is certified)."""
    good = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1")
    held = statistics.where("NOT base_failed").join(good, "doc_id", "left_semi")
    half = tunes(F.col("doc_id"))
    allowed = F.count("*") * (risk / len(RULES))
    # rejections grow with strictness, so the cutoffs that cost little enough come first
    place = {r: sum(((F.sum((F.col(r) > c).cast("long")) <= allowed).cast("int") for c in cs), F.lit(0)) - 1 for r, cs in RULES.items()}
    tuned = held.where(half).groupBy(F.col(stratum).alias("_stratum")).agg(F.struct(*(x.alias(r) for r, x in place.items())).alias("tuned"))
    tuned = keep(tuned, "tuned")  # as a table, its size is known to the planner
    margin = held.where(~half).join(tuned, F.col(stratum).eqNullSafe(F.col("_stratum"))).select("_stratum", "tuned", F.greatest(*_margins().values()).alias("margin"))
    ks = F.array(*(F.sum(F.coalesce((F.col("margin") >= s).cast("long"), F.lit(0))) for s in range(LOOSEST + 1)))
    counts = keep(margin.groupBy("_stratum", "tuned").agg(F.count("*").alias("n"), ks.alias("ks")), "counts")
    level = delta / max(1, counts.count())  # strata: a single number
    sure = F.transform("ks", lambda k: (k <= F.col("n") * risk) & (log_binomial_tail(k, F.col("n"), risk) <= F.log(F.lit(level))))
    n_sure = F.size(F.filter(sure, lambda x: x))  # rejections fall with looseness, so the certified ones are the loosest
    return counts.select("_stratum", "tuned", F.when(n_sure > 0, LOOSEST + 1 - n_sure).alias("looser"))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """Every document with its counts, the rules it breaks (``broken``) and the verdict ``kept``."""
    statistics = keep(text_statistics(docs, "doc_id", stratum), "statistics")
    policies = keep(certified_policies(statistics, labels, stratum), "policies")
    out = statistics.join(policies, F.col(stratum).eqNullSafe(F.col("_stratum")), "left").drop("_stratum")
    breaks = [F.when(m >= F.col("looser"), F.lit(r)) for r, m in _margins().items()]
    out = out.withColumn("broken", F.array_compact(F.array(*breaks))).drop("tuned", "looser")
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))


def op9_rules(spark, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
