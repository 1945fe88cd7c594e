"""URL filter: domain and path rules, and gradient-boosted trees on lexical features where no rule fits.

The trees learn from the URLs that rules label (allow or block).  Features: length, depth, digit ratio,
character entropy, parameter counts, host shape, and statistics of the host's suffix and of the path's first
segment (how many labelled URLs have it, which share of them is blocked; a URL learnt from gets those of the
other folds).  Suffixes are counted over all labelled URLs, segments over those that are drawn for the fit, so that
their table is bounded.  Each boosting
round grows one tree of depth two from one aggregation: the gradients and curvatures of the logistic loss summed per pair of
features and pair of their bins, which gives the root's table as well as, for any root, its children's; the
driver sees that table only (its size is set by features and bins), and the tree becomes a CASE expression, so scoring stays in
generated code.  A fifth of the rows, by hash, grows no tree: rounds end when the loss on it has not fallen for ``PATIENCE``
rounds, and the trees up to the best are kept.  DataFrame functions throughout.  ``holdout`` measures what the trees are worth on URLs they did not see.

The fit uses at most about ``TRAIN_ROWS`` labelled URLs, chosen by hash; every URL is judged.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is scored
like any other; repeated rows are judged alike; of equally long rules the first by text wins; with no
labelled URL the verdict is allow, with one kind of label that kind; an empty table gives no row; further
columns are ignored.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, table

TRAIN_ROWS, ROUNDS, PATIENCE, BINS, RATE, RIDGE, FOLDS = 50_000, 16, 2, 16, 0.5, 1.0, 5
#: The share of blocked URLs that a key without URLs counts as having.
NEUTRAL = 0.5


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return f"{self.host}{self.path}"

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith(f".{self.host}")) & path.startswith(self.path)


RULES = (
    UrlRule("com", "/", "allow"),
    UrlRule("example.com", "/en/", "block"),
    UrlRule("www.example.com", "/en/", "allow"),
    UrlRule("net", "/es/", "block"),
    UrlRule("net", "/fr/", "block"),
)
FEATURES = ("length", "depth", "digit_ratio", "entropy", "parameters", "host_length", "host_labels", "hyphens", "suffix_count", "suffix_blocked", "segment_count", "segment_blocked")


def host_and_path(url: Column) -> tuple[Column, Column]:
    parts = "(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda g: F.coalesce(F.regexp_extract(url, parts, g), F.lit(""))
    return F.translate(part(1), string.ascii_uppercase, string.ascii_lowercase), part(2)


def apply_rules(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES) -> DataFrame:
    """``url`` to host, path, and the text and verdict of the longest rule that fits."""
    host, path = host_and_path(F.col("url"))
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.text))
    out = pages.withColumns({"host": host, "path": path})
    first = F.coalesce(*(F.when(r.fits(F.col("host"), F.col("path")), F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))) for r in ordered))
    return out.withColumn("_fit", first).withColumns({"rule": F.col("_fit.rule"), "ruled": F.col("_fit.verdict")}).drop("_fit")


def _count(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("double")


def _fold(key: str) -> Column:
    return F.pmod(F.xxhash64("url", F.lit(key)), F.lit(FOLDS)).cast("int")


#: What statistics are kept of.
KEYS = {"suffix": "substring_index(host, '.', -1)", "segment": "lower(regexp_extract(path, '^/+([^/]*)', 1))"}


def key_statistics(labelled: DataFrame, name: str) -> DataFrame:
    """``(name, seen, blocked, seen_in, blocked_in)`` of labelled URLs by a key of KEYS, the last two by fold."""
    blocked = (F.col("ruled") == "block").cast("double")
    by_fold = lambda x: F.array(*(F.sum(F.when(_fold("own") == k, x).otherwise(0)) for k in range(FOLDS)))
    return labelled.groupBy(F.expr(KEYS[name]).alias(name)).agg(F.count("*").alias("seen"), F.sum(blocked).alias("blocked"), by_fold(F.lit(1)).alias("seen_in"), by_fold(blocked).alias("blocked_in"))


def _with_statistics(rows: DataFrame, statistics: DataFrame, name: str, prior: float, learning: bool) -> DataFrame:
    out = rows.withColumn("_key", F.expr(KEYS[name])).join(statistics.withColumnRenamed(name, "_own"), F.col("_key") == F.col("_own"), "left")
    other = lambda all_, own: F.coalesce(F.col(all_) - F.get(own, _fold("own")) if learning else F.col(all_), F.lit(0))
    seen, blocked = other("seen", "seen_in"), other("blocked", "blocked_in")
    out = out.withColumns({f"{name}_count": F.log1p(seen.cast("double")), f"{name}_blocked": (blocked + prior) / (seen + 1.0)})
    return out.drop("seen", "blocked", "seen_in", "blocked_in", "_key", "_own")


def lexical_features(ruled: DataFrame, suffixes: DataFrame, segments: DataFrame, prior: float, learning: bool = False) -> DataFrame:
    """The features of every URL, nulls as empty; ``suffixes`` and ``segments`` are of ``key_statistics``.

    Rows that these count and that are to be learnt from get the statistics of the other folds: with their own
    label in it, or with it alone left out, a statistic would tell the label.
    """
    url = F.coalesce(F.col("url"), F.lit(""))
    length = F.length(url).cast("double")
    share = lambda c: (length - F.length(F.replace(url, c))) / length
    entropy = F.aggregate(F.array_distinct(F.split(url, "")), F.lit(0.0), lambda a, c: a - F.when(c == "", 0.0).otherwise(share(c) * F.log2(share(c))))
    out = ruled.withColumns({
        "length": length, "depth": _count(F.col("path"), "/"), "digit_ratio": _count(url, string.digits) / F.greatest(length, F.lit(1.0)),
        "entropy": F.when(length > 0, entropy).otherwise(0.0), "parameters": _count(url, "=&"), "host_length": F.length("host").cast("double"),
        "host_labels": _count(F.col("host"), "."), "hyphens": _count(F.col("host"), "-"),
    })
    out = _with_statistics(out, suffixes, "suffix", prior, learning)
    return _with_statistics(out, segments, "segment", prior, learning)


def _gain(g: float, h: float) -> float:
    return g * g / (h + RIDGE)


def _best_split(rows: list, cuts: dict[str, list[float]]) -> tuple[str, float] | None:
    """The (feature, cutoff) that gains most on one node's table of (feature, bin, gradient, curvature)."""
    best, found = 1e-6, None
    for feature in sorted(cuts):
        own = sorted((r["bin"], r["g"], r["h"]) for r in rows if r["feature"] == feature)
        all_g, all_h = sum(x[1] for x in own), sum(x[2] for x in own)
        g = h = 0.0
        for place, add_g, add_h in own[:-1]:
            g, h = g + add_g, h + add_h
            gain = _gain(g, h) + _gain(all_g - g, all_h - h) - _gain(all_g, all_h)
            if gain > best:
                best, found = gain, (feature, cuts[feature][place])
    return found


def _tables(sums: dict[int, tuple[float, float]]) -> np.ndarray:
    """Gradients and curvatures by feature, feature, bin and bin, both ways round."""
    size = len(FEATURES)
    out = np.zeros((size, size, BINS, BINS, 2))
    for key, value in sums.items():
        pair, bins = divmod(key, BINS * BINS)
        i, j, a, b = *divmod(pair, size), *divmod(bins, BINS)
        out[i, j, a, b] = out[j, i, b, a] = value
    return out


def _rows(table: np.ndarray) -> list[dict]:
    """A node's table by feature and bin as rows; bins without a row of the data are left out."""
    return [{"feature": f, "bin": b, "g": float(g), "h": float(h)} for f, own in zip(FEATURES, table, strict=True) for b, (g, h) in enumerate(own) if h > 0]


def boost(rows: DataFrame, base: float) -> Column:
    """Log-odds of block, as an expression of the feature columns; ``rows`` has ``label`` 0.0 or 1.0, and ``weight`` if rows are to weigh differently."""
    aside = F.pmod(F.xxhash64(*FEATURES, "label"), F.lit(5)) == 0
    quantiles = rows.where(~aside).agg(*(F.percentile_approx(f, [k / BINS for k in range(1, BINS)]).alias(f) for f in FEATURES)).first()
    cuts = {f: sorted(set(quantiles[f] or [])) for f in FEATURES}
    bins = F.array(*(sum(((F.col(f) > c).cast("int") for c in cuts[f]), F.lit(0)) for f in FEATURES))
    weight = F.col("weight") if "weight" in rows.columns else F.lit(1.0)
    size = len(FEATURES)
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    at = lambda k: F.get("bins", F.lit(k))
    keys = F.array(*(((i * size + j) * BINS + at(i)) * BINS + at(j) for i, j in pairs))
    given = rows.select(bins.alias("bins"), "label", weight.alias("weight"), aside.alias("aside"))
    # what a row adds to does not change from round to round; one set aside adds to the loss alone
    binned = keep(given.withColumn("keys", F.when(F.col("aside"), F.array(F.lit(-1))).otherwise(keys)), "binned")

    def one_pass(current: Column) -> tuple[float, np.ndarray]:
        """The weighted mean loss on the rows set aside, and the tables of the others, at the present log-odds."""
        p = 1 / (1 + F.exp(-F.col("now")))
        signed = F.when(F.col("label") > 0, F.col("now")).otherwise(-F.col("now"))
        given = binned.withColumn("now", current).select(
            F.when(F.col("aside"), F.col("weight") * F.log1p(F.exp(-signed))).otherwise(F.col("weight") * (F.col("label") - p)).alias("g"),
            F.when(F.col("aside"), F.col("weight")).otherwise(F.col("weight") * p * (1 - p)).alias("h"), F.explode("keys").alias("key"),
        )
        sums = {r.key: (r.g, r.h) for r in given.groupBy("key").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()}  # of set size
        total, n = sums.pop(-1, (0.0, 0.0))
        return (total / n if n else 0.0), _tables(sums)

    def below(split: tuple[str, float]) -> tuple[int, int]:
        return FEATURES.index(split[0]), cuts[split[0]].index(split[1])

    score, seen = F.lit(base), F.lit(base)  # of features, and of bins
    best, least, since = score, None, 0
    for _ in range(ROUNDS + 1):
        now, tables = one_pass(seen)
        if least is None or now < least:
            best, least, since = score, now, 0
        else:
            since += 1
        root = None if since == PATIENCE else _best_split(_rows(np.array([np.einsum("aac->ac", tables[f, f]) for f in range(size)])), cuts)
        if not root:
            break
        f, place = below(root)
        sides = tables[f][:, : place + 1].sum(1), tables[f][:, place + 1 :].sum(1)
        leaves, conditions, places = [], [], []
        for own in sides:
            split = _best_split(_rows(own), cuts)
            k, at = below(split) if split else (0, BINS - 1)
            conditions.append(F.col(split[0]) <= split[1] if split else F.lit(True))
            places.append(F.get("bins", F.lit(k)) <= at)
            leaves += [F.lit(RATE * float(part[:, 0].sum()) / (float(part[:, 1].sum()) + RIDGE)) for part in (own[k][: at + 1], own[k][at + 1 :])]
        tree = lambda first, second, third: F.when(first, F.when(second, leaves[0]).otherwise(leaves[1])).otherwise(F.when(third, leaves[2]).otherwise(leaves[3]))  # noqa: B023, E731
        score = score + tree(F.col(root[0]) <= root[1], *conditions)
        seen = seen + tree(F.get("bins", F.lit(f)) <= place, *places)
    return best


def blanked(train: DataFrame) -> DataFrame:
    """Rows with features as they are, with the suffix as if never seen, and with the segment too."""
    blank = {"suffix": {"suffix_count": F.lit(0.0), "suffix_blocked": F.lit(NEUTRAL)}, "segment": {"segment_count": F.lit(0.0), "segment_blocked": F.lit(NEUTRAL)}}
    one = train.withColumns(blank["suffix"])
    return train.unionByName(one).unionByName(one.withColumns(blank["segment"]))


def fit(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[DataFrame, DataFrame, float, Column]:
    """The suffix and segment tables and what a key without URLs counts as, all for ``lexical_features``, and the log-odds of block.

    ``labelled`` has page_id, url, host, path and ``ruled``.
    """
    suffixes = keep(key_statistics(labelled, "suffix"), "suffixes")  # as a table, its size is known to the planner
    n, n_blocked = suffixes.agg(F.coalesce(F.sum("seen"), F.lit(0)), F.coalesce(F.sum("blocked"), F.lit(0.0))).first()
    prior = n_blocked / n if n else 0.0
    drawn = labelled.where(F.pmod(F.xxhash64("page_id", "url"), F.lit(max(n, train_rows))) < train_rows)
    segments = keep(key_statistics(drawn, "segment"), "segments")
    if not 0 < prior < 1:
        return suffixes, segments, NEUTRAL, F.lit(1.0 if prior else -1.0)
    label = (F.col("ruled") == "block").cast("double")
    # of equal weight in sum: the class that is commoner among rules says nothing of URLs without one
    weight = F.when(F.col("label") > 0, 0.5 / prior).otherwise(0.5 / (1 - prior))
    train = lexical_features(drawn, suffixes, segments, NEUTRAL, learning=True).select(*FEATURES, label.alias("label")).withColumn("weight", weight)
    return suffixes, segments, NEUTRAL, boost(blanked(keep(train, "labelled")), 0.0)


def judge(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Every URL with host, path, rule, the trees' ``block_score`` and the verdict."""
    ruled = apply_rules(pages.select("page_id", "url"), rules)
    *statistics, score = fit(ruled.where(F.col("ruled").isNotNull()), train_rows)
    out = lexical_features(ruled, *statistics).withColumn("block_score", 1 / (1 + F.exp(-score)))
    return out.withColumn("verdict", F.coalesce("ruled", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")))


def holdout(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, by: str = "url") -> DataFrame:
    """One row: of the ruled URLs of a fold by hash of ``by`` (an expression: url, host), how many the trees of the other folds judge as their rule does, and how many are blocked."""
    ruled = apply_rules(pages.select("page_id", "url"), rules).where("ruled IS NOT NULL")
    ours = F.pmod(F.xxhash64(F.expr(by), F.lit("holdout")), F.lit(FOLDS)) == 0
    *statistics, score = fit(ruled.where(~ours))
    seen = lexical_features(ruled.where(ours), *statistics)
    right = ((score >= 0) == (F.col("ruled") == "block")).cast("long")
    return seen.agg(F.count("*").alias("n"), F.coalesce(F.sum(right), F.lit(0)).alias("n_right"), F.coalesce(F.sum((F.col("ruled") == "block").cast("long")), F.lit(0)).alias("n_blocked"))


def op6_urls(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
