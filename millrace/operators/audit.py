"""Classify probes of public addresses and saved search results; a probe's answers are an input table."""

from __future__ import annotations

import json
import sys
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import urls
from ..functions.evidence import body_hash
from ..functions.text import unescape_entities
from .automaton import MAX_RULE_BYTES, substring_hits
from .structured import walk

# The classes of an audit, in report order, and the answers that mean gone.
CLASSES = ("unreachable", "reachable-current", "linked", "cached-indicator", "fork-indicator", "probe-error")
GONE = (404, 410)
PROBE_ERRORS = ("timeout", "dns-error", "connection-refused", "network-error", "tls-error")
CACHE_KEYS = ("cache", "cached", "cache_url", "cached_url", "webcache", "is_cached")


def fixture_error(value: Column) -> Column:
    plain = F.replace(F.lower(value), F.lit("_"), F.lit("-"))
    return F.when(plain.isin(*PROBE_ERRORS), plain).when(value.isNotNull(), "network-error")


def classify_probes(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """``requests(url)`` against ``responses(url, status, body, error)``; a URL without an answer is an error."""
    got = _answers(requests, responses)
    ok = F.col("_sound") & F.col("status").between(200, 299)
    kind = F.when(F.col("_sound") & F.col("status").isin(*GONE), "unreachable").when(ok, "reachable-current").otherwise("probe-error")
    return got.select(
        _source().alias("source"), kind.alias("classification"), F.when(F.col("_sound"), F.col("status")).alias("status"),
        F.when(ok, body_hash(F.col("body"))).alias("sha256"), _detail(F.lit(None).cast("string")).alias("detail"),
    )


def _answers(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Distinct requested URLs with their answer, and ``sound``: asked of a public address, and answered."""
    got = requests.select("url").distinct().join(responses.withColumn("_there", F.lit(True)), "url", "left")
    return got.withColumn("_public", urls.public_url(F.col("url"))).withColumn("_sound", F.col("_public") & F.coalesce("_there", F.lit(False)) & F.col("error").isNull())


def _detail(otherwise: Column) -> Column:
    """Why there is no sound answer; ``otherwise`` where there is one."""
    return (
        F.when(~F.col("_public"), "invalid-url").when(F.col("_there").isNull(), "fixture-miss").when(F.col("error").isNotNull(), fixture_error(F.col("error")))
        .when(~F.col("status").isin(*GONE) & ~F.col("status").between(200, 299), "http-error").otherwise(otherwise)
    )


def _source() -> Column:
    return F.when(F.col("_public"), urls.display_url(F.col("url"))).otherwise(urls.redacted_url(F.col("url")))


def classify_repositories(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """``requests(repository)`` against the answers of the host's API; its metadata must say whether it is a fork.

    What names no repository is an error by its digest.
    """
    named = requests.select("repository").distinct().withColumn("name", urls.repository_name(F.col("repository")))
    asked = named.withColumn("url", F.concat(F.lit("https://api.github.com/repos/"), "name"))
    got = asked.join(responses.withColumn("_there", F.lit(True)), "url", "left").withColumn("_public", F.lit(True))
    got = got.withColumn("_sound", F.col("name").isNotNull() & F.coalesce("_there", F.lit(False)) & F.col("error").isNull())
    ok = F.col("_sound") & F.col("status").between(200, 299)
    meta = F.try_parse_json(F.make_valid_utf8(F.col("body").cast("string")))
    fork = F.when(F.schema_of_variant(F.try_variant_get(meta, "$.fork", "variant")) == "BOOLEAN", F.try_variant_get(meta, "$.fork", "boolean"))
    kind = F.when(F.col("_sound") & F.col("status").isin(*GONE), "unreachable").when(ok & fork, "fork-indicator").when(ok & ~fork, "reachable-current").otherwise("probe-error")
    detail = F.when(F.col("name").isNull(), "invalid-repository").otherwise(_detail(F.when(ok & fork.isNull(), "invalid-repository-metadata")))
    return got.select(
        F.when(F.col("name").isNull(), urls.redacted_url(F.col("repository"))).otherwise(F.concat(F.lit("https://github.com/"), "name")).alias("source"), kind.alias("classification"),
        F.when(F.col("_sound"), F.col("status")).alias("status"), F.when(ok, body_hash(F.col("body"))).alias("sha256"), detail.alias("detail"),
    )


def classify_link_documents(requests: DataFrame, responses: DataFrame, forbidden: tuple[str, ...]) -> DataFrame:
    """Requested documents by whether they hold forbidden addresses (``matches``); one with an address that cannot be read is an error."""
    got = _answers(requests, responses)
    ok = F.col("_sound") & F.col("status").between(200, 299)
    found = with_forbidden(got.withColumn("text", F.make_valid_utf8(F.col("body").cast("string"))), forbidden)
    broken = ok & (F.col("n_invalid") > 0)
    kind = F.when(F.col("_sound") & F.col("status").isin(*GONE), "unreachable").when(broken | ~ok, "probe-error").when(F.size("matches") > 0, "linked").otherwise("reachable-current")
    return found.select(
        _source().alias("source"), kind.alias("classification"), F.when(F.col("_sound"), F.col("status")).alias("status"), F.when(ok, body_hash(F.col("body"))).alias("sha256"),
        _detail(F.when(broken, "malformed-extracted-url")).alias("detail"), F.when(ok, F.col("matches")).otherwise(F.array().cast("array<string>")).alias("matches"),
    )


@F.pandas_udf(T.StructType([T.StructField("cached", T.BooleanType()), T.StructField("strings", T.ArrayType(T.StringType()))]))
def _search_signals(items: pd.Series) -> pd.DataFrame:
    """Whether one of a search result's own fields says that it is a copy, and all strings that are values in it."""
    rows = []
    for item in items:
        fields = json.loads(item) if item else {}
        cached = isinstance(fields, dict) and any(k.lower() in CACHE_KEYS and v not in (None, False, "") for k, v in fields.items())
        rows.append((cached, [leaf[-1] for leaf in walk(fields, sys.maxsize, sys.maxsize) if leaf[-2] == "string"]))
    return pd.DataFrame(rows, columns=["cached", "strings"])


def classify_search(items: DataFrame, forbidden: tuple[str, ...]) -> DataFrame:
    """``items(n, item VARIANT)``: the first text among html_url, link, url is the source; forks, then cached copies, then live."""
    kind_of = lambda p: F.schema_of_variant(F.try_variant_get("item", p, "variant"))
    text = lambda p: F.when(kind_of(p) == "STRING", F.try_variant_get("item", p, "string"))
    truth = lambda p: F.coalesce(F.when(kind_of(p) == "BOOLEAN", F.try_variant_get("item", p, "boolean")), F.lit(False))
    url = F.coalesce(text("$.html_url"), text("$.link"), text("$.url"))
    public = F.coalesce(url.isNull() | urls.public_url(url), F.lit(True))
    fork = reduce(or_, map(truth, ("$.fork", "$.is_fork", "$.repository.fork", "$.repository.is_fork")))
    made = items.select("n", url.alias("_url"), public.alias("_public"), fork.alias("_fork"), _search_signals(F.to_json("item")).alias("_signals"))
    named = reduce(or_, (F.exists("_signals.strings", lambda s: s.contains(u)) for u in forbidden), F.lit(not forbidden))  # noqa: B023
    cached = F.col("_signals.cached") | named
    kind = F.when(~F.col("_public"), "probe-error").when(F.col("_fork"), "fork-indicator").when(cached, "cached-indicator").otherwise("reachable-current")
    detail = F.when(kind == "probe-error", "non-public-result-url").when(kind == "reachable-current", "public-search-result")
    label = F.concat(F.lit("search-result#"), F.col("n"))
    source = F.when(F.col("_public") & F.col("_url").isNotNull(), urls.display_url(F.col("_url"))).otherwise(label)
    return made.select("n", source.alias("source"), kind.alias("classification"), detail.alias("detail"))


def with_forbidden(documents: DataFrame, forbidden: tuple[str, ...]) -> DataFrame:
    """``documents`` with ``matches``, the forbidden addresses that ``text`` holds as they stand or in another spelling, and ``n_invalid``, of its addresses that cannot be read."""
    out = documents.withColumn("_text", unescape_entities(F.coalesce("text", F.lit(""))))
    found = F.transform(F.regexp_extract_all("_text", F.lit(f"({urls.ABSOLUTE_URL})"), 1), lambda u: F.rtrim(u, F.lit(".,);]")))
    out = out.withColumn("_urls", found)
    out = out.withColumn("_forms", F.transform("_urls", urls.plain_canonical)).withColumn("n_invalid", F.size(F.filter("_urls", lambda u: ~urls.parses(u))))
    hits = [F.when(F.col("_text").contains(u) | F.array_contains("_forms", urls.canonical_url(F.lit(u))), urls.display_url(F.lit(u))) for u in forbidden]
    return out.withColumn("matches", F.array_sort(F.array_distinct(F.array_compact(F.array(*hits).cast("array<string>"))))).drop("_text", "_urls", "_forms")


def forbidden_links(documents: DataFrame, forbidden: tuple[str, ...]) -> DataFrame:
    """``(doc_id, target)``: forbidden addresses that a text holds, entities decoded."""
    return with_forbidden(documents, forbidden).select("doc_id", F.explode("matches").alias("target"))


def forbidden_by_table(documents: DataFrame, addresses: DataFrame, max_bytes: int = MAX_RULE_BYTES) -> DataFrame:
    """``(doc_id, target)`` as ``forbidden_links``, for a table of forbidden addresses ``addresses(url)`` of any number.

    An address that stands in a text as it is, is found by one pass over the text; one in another spelling by a join on canonical forms.
    """
    wanted = addresses.select("url", F.xxhash64("url").alias("rule_id"), urls.canonical_url(F.col("url")).alias("_form"), urls.display_url(F.col("url")).alias("target")).where("url <> ''").distinct()
    texts = documents.select(F.struct("doc_id").alias("_row"), unescape_entities(F.coalesce("text", F.lit(""))).alias("_text"))
    as_they_are = substring_hits(texts, wanted.select("rule_id", F.col("url").alias("phrase")), max_bytes).join(wanted, "rule_id").select("_row.doc_id", "target")
    found = F.transform(F.regexp_extract_all("_text", F.lit(f"({urls.ABSOLUTE_URL})"), 1), lambda u: F.rtrim(u, F.lit(".,);]")))
    spelt = texts.select("_row.doc_id", F.explode(F.array_distinct(F.transform(found, urls.plain_canonical))).alias("_form")).where("_form <> ''")
    return as_they_are.unionByName(spelt.join(wanted, "_form").select("doc_id", "target")).distinct()


@F.pandas_udf(T.BinaryType())
def _canonical_json(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: json.dumps(json.loads(t), sort_keys=True, separators=(",", ":")).encode(), na_action="ignore").astype(object)


def fixture_body(body: Column, body_base64: Column, document: Column) -> Column:
    """The bytes of a saved answer: a text, base64, or a JSON text (its compact sorted form); several at once are an error."""
    given = sum((c.isNotNull().cast("int") for c in (body, body_base64, document)), F.lit(0))
    one = F.coalesce(F.encode(body, "UTF-8"), F.try_to_binary(body_base64, F.lit("base64")), _canonical_json(document))
    bad = (given > 1) | (body_base64.isNotNull() & one.isNull())
    return F.when(bad, F.raise_error(F.lit("a saved answer has one body field, and base64 must be sound"))).otherwise(F.coalesce(one, F.lit(b"")))
