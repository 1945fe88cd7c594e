"""Line scan: sensitive shapes, ownership claims, forbidden phrases and repositories, in one pass over exploded lines."""

from __future__ import annotations

from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.evidence import evidence_id
from ..functions.rows import exploded
from ..functions.text import bound, case_folded, collapse_space, lines_of, match_column, match_forms, match_text
from ..functions.urls import needles
from .inventory import name_glob

# The shapes and claims that findings are defined by.
EMAIL = "[A-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?(?:\\.[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?)+"
SHAPES: dict[str, str] = {
    "private_key": "(?i)-{5}BEGIN [A-Z0-9 ]*PRIVATE KEY-{5}",
    "aws_access_key": "\\b(?:AKIA|ASIA)[0-9A-Z]{16}\\b",
    "github_token": "(?i)\\bgh[pousr]_[A-Za-z0-9]{20,255}\\b",
    "openai_token": "\\bsk-[A-Za-z0-9]{20,200}\\b",
    "google_api_key": "\\bAIza[A-Za-z0-9_-]{30,100}\\b",
    "stripe_secret_key": "(?i)\\bsk_live_[A-Za-z0-9]{16,200}\\b",
    "slack_token": "(?i)\\bxox[baprs]-[A-Za-z0-9-]{10,200}\\b",
    "jwt": "\\beyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\b",
    "credential_assignment": "(?i)\\b(?:api[_-]?key|access[_-]?token|auth[_-]?token|password|passwd|secret)\\b\\s*[:=]\\s*[\"']?[A-Za-z0-9_./+=-]{12,}",
    "credential_url": "(?i)\\b[a-z][a-z0-9+.-]*://[^/\\s:@]{1,64}:[^/\\s@]{4,128}@",
    "connection_string_secret": "(?i)\\b(?:AccountKey|SharedAccessKey|ClientSecret)\\s*=\\s*[A-Za-z0-9+/=_-]{12,}",
    "webhook_secret": "(?i)https://hooks\\.slack\\.com/services/[A-Za-z0-9_-]{6,}/[A-Za-z0-9_-]{6,}/[A-Za-z0-9_-]{12,}",
    "email_address": f"(?i)(?<![A-Za-z0-9.!#$%&'*+/=?^_`{{|}}~-]){EMAIL}",
    "us_ssn": "(?<!\\d)(?!000|666|9\\d\\d)\\d{3}-(?!00)\\d{2}-(?!0000)\\d{4}(?!\\d)",
    "phone_number": "(?i)(?:\\b(?:phone|mobile|cell|tel)\\b\\s*[:=]?\\s*)(?:\\+?1[\\s.-]?)?(?:\\(\\d{3}\\)|\\d{3})[\\s.-]\\d{3}[\\s.-]\\d{4}\\b",
    "postal_address": "(?i)\\b(?:address|street)\\b\\s*[:=]\\s*[\"']?\\d{1,6}\\s+[A-Za-z0-9 .'-]{2,80}\\s+(?:street|st|avenue|ave|road|rd|boulevard|blvd|lane|ln|drive|dr)\\b",
    "submitted_customer_record": "(?i)[\"'](?:submitted_at|submission_id|waitlist_submission)[\"']\\s*:.{0,256}[\"'](?:email|phone|note|customer_id|account_id)[\"']\\s*:",
}
# What a line must hold, in lower case, for a shape to be worth a regular expression.
HINTS: dict[str, tuple[str, ...]] = {
    "private_key": ("-----begin",), "aws_access_key": ("akia", "asia"), "github_token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "openai_token": ("sk-",), "google_api_key": ("aiza",),
    "stripe_secret_key": ("sk_live_",), "slack_token": ("xox",), "jwt": ("eyj",), "credential_assignment": ("key", "token", "passw", "secret"), "credential_url": ("://",),
    "connection_string_secret": ("key", "secret"), "webhook_secret": ("hooks.slack",), "email_address": ("@",), "us_ssn": ("-",), "phone_number": ("phone", "mobile", "cell", "tel"),
    "postal_address": ("address", "street"), "submitted_customer_record": ("submitted_at", "submission"),
}
OWNERSHIP = (
    "(?i)\\b(?:own(?:s|ed|ership)?|equity|stake|share|interest)\\b.{0,48}?\\b(?:100(?:\\.0+)?|[1-9]?\\d(?:\\.\\d+)?)\\s*(?:%|\\bpercent(?:age)?\\b)",
    "(?i)\\b(?:100(?:\\.0+)?|[1-9]?\\d(?:\\.\\d+)?)\\s*(?:%|\\bpercent(?:age)?\\b).{0,48}?\\b(?:owned|ownership|equity|stake|share|interest)\\b",
)
#: Contracts under which a text may name what it forbids (only shapes and URLs are looked for), and that whose URLs are made up too.
DEFINITIONS_ONLY = ("self-reference-safe", "synthetic-test-input")
SYNTHETIC = "synthetic-test-input"
CONTRACTS = ("full", "nondeploy-operational-contact", *DEFINITIONS_ONLY)
#: What numbered detectors are called.
NAMES = {"phrase": "phrase", "repository": "repository", "ownership": "ownership"}
#: How shapes are named where values are allowed.
ALLOWED_AS = {"email_address": "email_address_values", "phone_number": "phone_number_values", "postal_address": "postal_address_values"}


class Allowance(NamedTuple):
    """Values that detectors pass over, on paths that fit a glob: by full pattern or by digest."""

    detectors: tuple[str, ...]
    paths: tuple[str, ...]
    patterns: tuple[str, ...] = ()
    sha256s: tuple[str, ...] = ()


def allowance_fits(path: Column, allowance: Allowance) -> Column:
    """Whether any of the path globs fits, case aside, from the root."""
    rooted = F.concat(F.lit("/"), F.ltrim(path, F.lit("/")))
    return reduce(or_, (rooted.rlike(name_glob(g)) for g in allowance.paths), F.lit(False))


def value_allowed(path: Column, detector: str, value: Column, allowances: tuple[Allowance, ...]) -> Column:
    """Whether a value (also without quotes around it) may stand; null and empty ones may."""
    trimmed = F.trim(value)
    out = F.coalesce(value == "", F.lit(True))
    for a in allowances:
        if detector in a.detectors:
            fits = F.lit(False)
            for v in (trimmed, F.btrim(trimmed, F.lit("\"'"))):
                fits = reduce(or_, (v.rlike(f"^(?:{p})$") for p in a.patterns), fits)
                fits = fits | F.sha2(v, 256).isin(*a.sha256s) if a.sha256s else fits
            out = out | (allowance_fits(path, a) & fits)
    return out


def explode_lines(content: DataFrame, path: str, text: str) -> DataFrame:
    """``(path, line_number, line)``: one row per line, counted from 1."""
    each = content.select(F.col(path).alias("path"), F.posexplode_outer(lines_of(F.col(text))).alias("p", "line")).where("p IS NOT NULL")  # see ``exploded``
    return each.select("path", (F.col("p") + 1).alias("line_number"), "line")


def normalised(lines: DataFrame) -> DataFrame:
    """Lines with entities, compatibility forms and characters of no width resolved, and ``_cased``, these in full case folding; plain ones do not travel to Python."""
    line, forms = F.col("line"), F.col("_forms")
    both = {"line": F.coalesce(forms["plain"], line), "_cased": F.coalesce(forms["cased"], F.lower(line))}
    return lines.withColumn("_forms", match_forms(line)).withColumns(both).drop("_forms")


def _finding(rule: str, detector: str, column: Column) -> Column:
    return F.when(column.isNotNull(), F.struct(F.lit(rule).alias("rule"), F.lit(detector).alias("detector"), column.alias("column")))


def _is(contract: str | Column, kinds: tuple[str, ...]) -> Column:
    return (F.lit(contract) if isinstance(contract, str) else contract).isin(*kinds)


def line_findings(
    lines: DataFrame,
    phrases: tuple[str, ...] = (),
    detectors: tuple[str, ...] | None = None,
    contract: str | Column = "full",
    allowed: dict[str, tuple[str, ...]] | None = None,
    *,
    patterns: dict[str, str] | None = None,
    repositories: tuple[str, ...] = (),
    allowances: tuple[Allowance, ...] = (),
    names: dict[str, str] | None = None,
) -> DataFrame:
    """``(path, line_number, rule, detector, column)``: the first match of every detector on every line."""
    found = with_hits(lines, phrases, detectors, contract, allowed, patterns=patterns, repositories=repositories, allowances=allowances, names=names)
    return exploded(found, "path", "line_number", f="_hits").select("path", "line_number", "f.rule", "f.detector", "f.column")


def with_hits(
    lines: DataFrame,
    phrases: tuple[str, ...] = (),
    detectors: tuple[str, ...] | None = None,
    contract: str | Column = "full",
    allowed: dict[str, tuple[str, ...]] | None = None,
    *,
    patterns: dict[str, str] | None = None,
    repositories: tuple[str, ...] = (),
    allowances: tuple[Allowance, ...] = (),
    names: dict[str, str] | None = None,
) -> DataFrame:
    """``lines(path, line, ...)`` with ``_hits``, an array of ``(rule, detector, column)``; none for a null line.

    ``phrases`` are literal, ``patterns`` (identifier to regular expression) match what is left when white space is
    collapsed, ``repositories`` are named in any of their forms.  Phrases and repositories have no column.  A
    match that ``allowed`` (detector to full patterns) or ``allowances`` let pass hides later ones on its line.
    ``contract`` may be a column of ``lines``.  ``names`` are what detectors of phrases, repositories and ownership claims are
    called before their number, where they are to be called otherwise than ``NAMES``.  Python-style Unicode classes hold throughout.
    """
    called = NAMES | (names or {})
    parts = {"line": F.col("line"), "low": F.lower("line")}
    if phrases or repositories:
        parts["cased"] = F.col("_cased") if "_cased" in lines.columns else case_folded(F.col("line"))
    if phrases:
        parts["spaced"] = collapse_space(parts["cased"])
    kind = "array<struct<rule:string,detector:string,column:int>>"
    bare = lambda rule, detector: F.struct(F.lit(rule).alias("rule"), F.lit(detector).alias("detector"), F.lit(None).cast("int").alias("column"))

    def hits(forms: Column) -> Column:
        line, low, found = forms["line"], forms["low"], []
        named = [F.when(forms["spaced"].contains(" ".join(match_text(p).casefold().split())), bare("forbidden_phrase", f"{called['phrase']}[{i}]")) for i, p in enumerate(phrases)]
        named += [_finding("forbidden_phrase", name, match_column(collapse_space(line), f"(?U){p}")) for name, p in (patterns or {}).items()]
        named += [F.when(reduce(or_, (forms["cased"].contains(n) for n in needles(r)), F.lit(False)), bare("private_repository_link", f"{called['repository']}[{i}]")) for i, r in enumerate(repositories)]
        owns = [_finding("ownership_percentage_claim", f"{called['ownership']}[{i}]", match_column(line, p)) for i, p in enumerate(OWNERSHIP)]
        owned = F.when(low.contains("%") | low.contains("percent"), F.array(*owns))
        found.append(F.when(~_is(contract, DEFINITIONS_ONLY), F.concat(F.array(*named).cast(kind), F.coalesce(owned.cast(kind), F.array().cast(kind)))))
        for name, pattern in SHAPES.items():
            if detectors is not None and name not in detectors:
                continue
            pattern = f"(?U){pattern}"
            column, value = match_column(line, pattern), F.regexp_extract(line, f"({pattern})", 1)
            for okay in (allowed or {}).get(name, ()):
                column = F.when(~value.rlike(f"^(?:{okay})$"), column)
            if allowances:
                column = F.when(~value_allowed(F.col("path"), ALLOWED_AS.get(name, name), value, allowances), column)
            hinted = reduce(or_, (low.contains(h) for h in HINTS[name]))
            found.append(F.when(hinted, F.array(_finding("sensitive_data_shape", name, column)).cast(kind)))
        return F.array_compact(F.flatten(F.array_compact(F.array(*found))))

    # the forms are bound: Spark would put the expression of each into every place that names it
    return lines.withColumn("_hits", bound(F.struct(*(c.alias(n) for n, c in parts.items())), hits)).drop("_cased")


def with_evidence(findings: DataFrame) -> DataFrame:
    """Distinct findings with their identifier."""
    made = evidence_id(rule=F.col("rule"), path=F.col("path"), detector=F.col("detector"), line_no=F.col("line_number"), column_no=F.col("column"))
    return findings.dropDuplicates(["path", "line_number", "rule", "detector", "column"]).withColumn("evidence_id", made)


def in_report_order(findings: DataFrame) -> DataFrame:
    """Path (case aside), line, column, rule, detector; a missing place comes first."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return findings.orderBy(F.lower("path"), "path", zero("line_number"), zero("column"), "rule", "detector")


def count_over(findings: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """Rows per value of a closed vocabulary, values without rows included."""
    spark = findings.sparkSession
    dim = spark.range(1).select(F.explode(F.array(*map(F.lit, values))).alias(column))
    counts = findings.groupBy(column).agg(F.count("*").alias("n"))
    return dim.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))
