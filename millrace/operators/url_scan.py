"""The scan of URLs inside lines: broken escapes, credentials, hosts, repositories and files that a policy forbids."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.text import bound, normalise_match_text, unquote_text
from .inventory import filename_fits
from .shapes import SYNTHETIC, _is

# Fixed value: what is taken for an address inside a line.
IN_LINE = "(?i)(?:https?|ssh)://[^\\s<>\"']+|(?<![A-Z0-9:+.-])//[A-Z0-9.-]+\\.[A-Z]{2,}(?:/[^\\s<>\"']*)?|git@[A-Z0-9.-]+:[^\\s<>\"']+"


class UrlPolicy(NamedTuple):
    """What addresses in a text may not be; hosts that hold repositories deny all but the allowed ones."""

    hosts: tuple[str, ...] = ()
    host_suffixes: tuple[str, ...] = ()
    repository_hosts: tuple[str, ...] = ()
    repositories: tuple[str, ...] = ()
    repository_patterns: tuple[tuple[str, str], ...] = ()
    filenames: tuple[str, ...] = ()
    filename_patterns: tuple[str, ...] = ()


def _matches(line: Column) -> Column:
    """``(raw, column)`` of every match: the texts between matches tell where each one starts."""

    def placed(m: Column) -> Column:
        lengths = lambda texts, n: F.aggregate(F.slice(texts, F.lit(1), n), F.lit(0), lambda k, x: k + F.length(x))
        return F.transform(m["raws"], lambda raw, i: F.struct(F.rtrim(raw, F.lit(urls.TRAILING)).alias("raw"), (lengths(m["between"], i + 1) + lengths(m["raws"], i) + 1).alias("column")))

    return bound(F.struct(F.regexp_extract_all(line, F.lit(f"({IN_LINE})"), 1).alias("raws"), F.split(line, IN_LINE).alias("between")), placed)


def urls_in_lines(lines: DataFrame) -> DataFrame:
    """``(path, line_number, raw, column)``: the addresses of every normalised line and of its decoded form, each once a line.

    Two are the same if they are when decoded (escapes that are no UTF-8 count as they stand); the first place counts.
    """
    made = with_urls(lines.where(_hinted(F.col("line"))))
    return made.select(*(c for c in lines.columns if c != "line"), F.explode("_urls").alias("m")).selectExpr("* EXCEPT (m)", "m.raw", "m.column")


def _hinted(line: Column) -> Column:
    """Whether a line, or its decoded form, may hold an address; few lines need to be lower-cased to tell."""
    low = F.lower(line)
    return line.contains("//") | (line.contains("@") & low.contains("git@")) | (line.contains("%") & low.rlike("%2f%2f|git%40"))


def with_urls(lines: DataFrame) -> DataFrame:
    """``lines`` with ``_urls``, an array of ``(raw, column)``; none for a null line."""
    there = lines.withColumn("_decoded", F.when(_hinted(F.col("line")), unquote_text(F.col("line"))))
    both = F.concat(_matches(F.col("line")), F.when(F.col("_decoded") != F.col("line"), _matches(F.col("_decoded"))).otherwise(F.array().cast("array<struct<raw:string,column:int>>")))
    plain = F.transform(both, lambda m: F.struct(m["raw"].alias("raw"), m["column"].alias("column"), F.coalesce(urls.percent_decode(m["raw"]), m["raw"]).alias("same")))
    made = there.withColumn("_all", F.when(F.col("_decoded").isNotNull(), plain))
    once = F.filter("_all", lambda m, i: ~F.exists(F.slice("_all", F.lit(1), i), lambda other: other["same"] == m["same"]))
    none = F.array().cast("array<struct<raw:string,column:int,same:string>>")
    return made.withColumn("_urls", F.transform(F.coalesce(once, none), lambda m: F.struct(m["raw"].alias("raw"), m["column"].alias("column")))).drop("_decoded", "_all")


def url_findings(lines: DataFrame, policy: UrlPolicy, contract: str | Column = "full") -> DataFrame:
    """``(path, line_number, rule, detector, column)`` for every address that the policy does not let pass."""
    found = with_url_rules(urls_in_lines(lines.where(~_is(contract, (SYNTHETIC,)))), policy)
    each = found.select("path", "line_number", "column", F.explode("_rules").alias("f"))
    return each.select("path", "line_number", "f.rule", "f.detector", "column")


def with_url_rules(found: DataFrame, policy: UrlPolicy) -> DataFrame:
    """``found(raw, ...)`` with ``_rules``, an array of the ``(rule, detector)`` that an address breaks; none for a null address."""
    raw = F.col("raw")
    absolute = F.when(raw.startswith("//"), F.concat(F.lit("https:"), raw)).otherwise(raw)
    made = found.withColumns({
        "_url": absolute, "_broken": raw.rlike(urls.BAD_ESCAPE), "_mail": raw.rlike("(?i)^git@"), "_reference": urls.repository_reference(raw),
    })
    made = made.withColumns({"_parses": F.col("_mail") | urls.parses(F.col("_url")), "_host": urls.host(F.col("_url")), "_slug": urls.slug_key(F.col("_reference.slug"))})
    path = F.when(F.col("_mail"), raw).otherwise(urls.part(F.col("_url"), 5))
    base = F.regexp_extract(unquote_text(path), "([^/\\\\]*)[/\\\\]*$", 1)
    made = made.withColumn("_name", normalise_match_text(base))

    def finding(when: Column, rule: str, detector: Column | str) -> Column:
        name = F.lit(detector) if isinstance(detector, str) else detector
        return F.when(when, F.struct(F.lit(rule).alias("rule"), name.alias("detector")))

    host, slug = F.col("_host"), F.col("_slug")
    denied = host.isin(*(h.lower() for h in policy.hosts)) if policy.hosts else F.lit(False)
    for suffix in policy.host_suffixes:
        denied = denied | host.endswith(suffix.lower())
    kept = [urls.plain_slug(s) for s in policy.repositories]
    repository = F.lower("_reference.host").isin(*(h.lower() for h in policy.repository_hosts)) & (~slug.isin(*kept) if kept else F.lit(True)) if policy.repository_hosts else F.lit(False)
    by_pattern = F.coalesce(*(F.when(slug.rlike(p), F.lit(name)) for name, p in policy.repository_patterns), F.lit("repository_visibility_default_deny"))
    named = filename_fits(F.col("_name"), policy.filenames)
    for p in policy.filename_patterns:
        named = named | F.col("_name").rlike(p)
    sound = ~F.col("_broken") & F.col("_parses")
    rules = F.array(
        finding(F.col("_broken"), "malformed_url", "invalid_percent_encoding"),
        finding(~F.col("_broken") & ~F.col("_parses"), "malformed_url", "url_parser"),
        finding(sound & ~F.col("_mail") & (urls.part(F.col("_url"), 2) != ""), "sensitive_data_shape", "credential_url"),
        finding(sound & denied, "forbidden_url_host", "url_policy.forbidden_host"),
        finding(sound & repository, "private_repository_link", by_pattern),
        finding(sound & named, "forbidden_downloadable_document", "url_path_forbidden_filename"),
    )
    return made.withColumn("_rules", F.array_compact(rules)).drop("_url", "_broken", "_mail", "_reference", "_parses", "_host", "_slug", "_name")
