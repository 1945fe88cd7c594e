"""Whole scans: a source tree against a policy, and a site's artifact through the five gates."""

from __future__ import annotations

import uuid
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.evidence import redacted_path
from ..functions.rows import exploded
from ..operators import inventory, links, rule_tables, shapes, structured, url_scan
from . import reports

MAX_BYTES = 5 << 20


class Policy(NamedTuple):
    """What a scan looks for; empty parts look for nothing."""

    phrases: tuple[str, ...] = ()
    patterns: tuple[tuple[str, str], ...] = ()
    repositories: tuple[str, ...] = ()
    filenames: tuple[str, ...] = ()
    filename_patterns: tuple[tuple[str, str], ...] = ()
    urls: url_scan.UrlPolicy = url_scan.UrlPolicy()
    detectors: tuple[str, ...] = structured.DETECTORS
    allowances: tuple[shapes.Allowance, ...] = ()
    max_bytes: int = MAX_BYTES


COLUMNS = ("rule", "path", "detector", "line_number", "column")


def _found(df: DataFrame, rule: str | None = None, detector: str | None = None) -> DataFrame:
    """Findings in COLUMNS; what a part does not say is null."""
    own = {"rule": F.lit(rule).cast("string"), "detector": F.lit(detector).cast("string"), "line_number": F.lit(None).cast("int"), "column": F.lit(None).cast("int")}
    return df.select(*(F.col(c) if c in df.columns else own[c].alias(c) for c in COLUMNS))


def decoded(items: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``items(path, data)`` with size, digest, ``binary``, ``valid`` and the text, null for what is too large or no text."""
    raw = F.col("data").cast("string")
    small = F.octet_length("data") <= max_bytes
    out = items.withColumns({"size": F.octet_length("data"), "sha256": F.when(small, F.sha2("data", 256)), "binary": small & inventory.is_binary(F.col("data")), "valid": F.is_valid_utf8(raw)})
    plain = F.regexp_replace(F.make_valid_utf8(raw), "^﻿", "")
    return out.withColumn("text", F.when(small & ~F.col("binary"), plain))


_UNIT = "struct<rule:string,detector:string,line_number:int,line:string,leaf:" + structured.LEAF_TYPE.removeprefix("array<")[:-1] + ">"


def _units(files: DataFrame, own: Column) -> Column:
    """What is looked at of a file, one array: its ``own`` findings, its lines, and the leaves of its JSON."""
    null = {"rule": F.lit(None).cast("string"), "detector": F.lit(None).cast("string"), "line_number": F.lit(None).cast("int"), "line": F.lit(None).cast("string"), "leaf": F.lit(None)}
    unit = lambda **given: F.struct(*(given.get(c, v).alias(c) for c, v in null.items())).cast(_UNIT)
    kind = links.suffix_kind(F.col("path"))
    leaves = structured.leaves_in(F.when(kind.isin("json", "jsonl"), F.col("text")), kind == "jsonl")
    none = F.array().cast(f"array<{_UNIT}>")
    parts = (
        F.transform(own, lambda f: unit(rule=f["rule"], detector=f["detector"])), F.transform(text.lines_of(F.col("text")), lambda line, i: unit(line_number=i + 1, line=line)), F.transform(leaves, lambda leaf: unit(leaf=leaf)),
    )
    return F.concat(*(F.coalesce(p, none) for p in parts))


def _judged(units: DataFrame, policy: Policy) -> DataFrame:
    """``units(path, _contract, rule, detector, line_number, line, leaf, ...)`` as findings: every detector in one pass over the rows."""
    carried = [c for c in units.columns if c not in ("rule", "detector", "line_number", "line", "leaf", "_contract")]
    rows = shapes.normalised(units.withColumnsRenamed({"rule": "_rule", "detector": "_detector"}))
    rows = shapes.with_hits(rows, policy.phrases, contract=F.col("_contract"), patterns=dict(policy.patterns), repositories=policy.repositories, allowances=policy.allowances)
    rows = url_scan.with_urls(rows).select("*", *(F.col(f"leaf.{c}").alias(c) for c in ("kind", "value", "_key", "_above", "_around")))
    rows = structured.with_key_hits(rows, F.col("path"), policy.detectors, policy.allowances)
    no_raw, no_column = F.lit(None).cast("string").alias("raw"), F.lit(None).cast("int").alias("column")
    whole = lambda f, column: F.struct(f["rule"].alias("rule"), f["detector"].alias("detector"), column, no_raw)
    own = F.when(F.col("_rule").isNotNull(), F.array(F.struct(F.col("_rule").alias("rule"), F.col("_detector").alias("detector"), no_column, no_raw)))
    named = F.transform("_hits", lambda f: whole(f, f["column"].alias("column")))
    valued = F.transform("_values", lambda f: whole(f, no_column))
    addresses = F.when(~F.col("_contract").eqNullSafe(shapes.SYNTHETIC), F.transform("_urls", lambda u: F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("detector"), u["column"].alias("column"), u["raw"].alias("raw"))))
    each = exploded(rows, *carried, "line_number", f=F.flatten(F.array_compact(F.array(own, named, valued, addresses)))).select(*carried, "line_number", "f.*")
    ruled = url_scan.with_url_rules(each, policy.urls)
    found = F.when(F.col("raw").isNull(), F.array(F.struct("rule", "detector"))).otherwise(F.col("_rules"))
    return exploded(ruled, *carried, "line_number", "column", f=found).select(*carried, "f.rule", "f.detector", "line_number", "column")


def content_findings(files: DataFrame, policy: Policy, contract: str | Column = "full") -> DataFrame:
    """What lines, addresses and JSON values of ``files(path, text)`` break; ``contract`` may be a column of theirs."""
    named = F.lit(contract) if isinstance(contract, str) else contract
    units = exploded(files, "path", named.alias("_contract"), u=_units(files, F.lit(None).cast("array<struct<rule:string,detector:string>>"))).select("path", "_contract", "u.*")
    return _found(_judged(units, policy)).distinct()


def _own_findings(policy: Policy) -> Column:
    """What is wrong with a decoded file as such."""
    one = lambda when, rule, detector: F.when(when, F.struct(F.lit(rule).alias("rule"), F.lit(detector).alias("detector")))
    plain = F.array_compact(F.array(
        one(inventory.unsafe_path(F.col("path")), "path_escape", "path"), one(F.col("size") > policy.max_bytes, "file_too_large", "max_file_bytes"),
        one(F.col("binary"), "unsupported_file_type", "binary"), one(~F.col("valid") & ~F.col("binary"), "invalid_utf8", "utf-8"),
    ))
    return F.concat(plain, F.transform("_names", lambda n: F.struct(F.lit("forbidden_filename").alias("rule"), n.alias("detector"))))


def source_findings(items: DataFrame, policy: Policy, contract: str | Column = "full") -> DataFrame:
    """Every finding of ``items(path, data)``, distinct, with its identifier (of the path as it may be shown).

    The bytes are read once: a file's own findings, lines and JSON leaves are rows of one table that all detectors see.  A second
    scan, of the paths alone, is for paths that collide.
    """
    named = F.lit(contract) if isinstance(contract, str) else contract
    names = inventory.name_hits(F.col("path"), policy.filenames, dict(policy.filename_patterns))
    files = decoded(items, policy.max_bytes).withColumn("_names", names)
    units = exploded(files, "path", (F.size("_names") > 0).alias("_hidden"), named.alias("_contract"), u=_units(files, _own_findings(policy))).select("path", "_hidden", "_contract", "u.*")
    collided = _found(inventory.collisions(items.select("path"), "path", text.fold(F.col("path"))), "path_collision", "nfkc_casefold").withColumn("_hidden", F.size(names) > 0)
    found = _judged(units, policy).select(*COLUMNS, "_hidden").unionByName(collided)
    return shapes.with_evidence(found.withColumn("path", redacted_path(F.col("path"), F.col("_hidden"))).drop("_hidden"))


def scan_source(items: DataFrame, policy: Policy, contract: str | Column = "full") -> tuple[DataFrame, DataFrame]:
    """Findings, and one row per item with size, digest, media type and pass or deny."""
    found = source_findings(items, policy, contract)
    hidden = F.size(inventory.name_hits(F.col("path"), policy.filenames, dict(policy.filename_patterns))) > 0
    shown = decoded(items, policy.max_bytes).withColumn("path", redacted_path(F.col("path"), hidden))
    counted = found.groupBy("path").agg(F.count("*").alias("n_findings"))
    covered = shown.join(counted, "path", "left").select("path", "size", "sha256", inventory.media_type(F.col("path"), F.col("binary")).alias("media_type"), F.coalesce("n_findings", F.lit(0)).alias("n_findings"))
    return found, covered.withColumn("status", F.when(F.col("n_findings") > 0, "deny").otherwise("pass"))


#: What files that say the rules may hold, because they name it.
NAMED_BY_CONTROLS = ("forbidden_phrase", "private_repository_link", "forbidden_downloadable_document", "forbidden_filename")
#: Gates of findings about a file as such; all others are of the policy gate.
FILE_GATES = {"artifact_file_too_large": "eligibility", "artifact_text_not_utf8": "parse"}


def _kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the folder that ``spark.checkpoint.dir`` names, so that its uses do not read the input again; itself where none is named."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def class_findings(paths: DataFrame, classes: DataFrame, manifest: DataFrame) -> DataFrame:
    """``(rule, path, detector)``: ``classes(path, disposition)`` of source paths against the artifact's ``manifest(path, class)``.

    A path that must be absent may not be in the manifest, and one that is a control must be of that class there.
    """
    met = paths.select("path").distinct().join(classes, "path").join(manifest.select("path", "class"), "path", "left")
    rule = F.when((F.col("disposition") == "must-be-absent") & F.col("class").isNotNull(), "nondeploy_path_in_artifact_manifest").when((F.col("disposition") == CONTROL) & ~F.col("class").eqNullSafe(CONTROL), "publication_control_manifest_mismatch")
    return met.select(rule.alias("rule"), "path", F.lit("source_classification").alias("detector")).where("rule IS NOT NULL").distinct()


CONTROL = "publication-control"


def scan_artifact(
    items: DataFrame, manifest: DataFrame, policy: Policy, site_hosts: tuple[str, ...], origins: tuple[str, ...] = (), excluded: tuple[str, ...] = (), controls: tuple[str, ...] = (),
    folders: DataFrame | None = None, sealed: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(gate, rule, path, detector)`` of a built site, ``items(path, data)`` against ``manifest(path, class)``; and its links by class.

    Classes in ``excluded`` may not be published; ``controls`` are the files that hold rules, in which names of what they
    forbid may stand.  ``folders(folder)`` are those that are there, ``sealed(path, sha256)`` what the files were when they were committed:
    a file that is another one now, a control that is (twice wrong), and a declared file that no scan saw are findings.  The bytes are read
    once for the policy and once for the links; the rest reads paths.
    """
    files = decoded(items, policy.max_bytes)
    gate = lambda name, df, rule=None, detector=None: _found(df, rule, detector).select(F.lit(name).alias("gate"), "rule", "path", "detector")
    texts = files.where("text IS NOT NULL")
    found = _kept(links.links_of(texts, "path", "text", links.suffix_kind(F.col("path"))), "links")
    broken = found.where("error IS NOT NULL").select("path", F.col("error").alias("rule")).distinct()
    each = links.one_per_target(found.where("error IS NULL"), "path")
    base = F.concat(F.lit(f"https://{site_hosts[0]}/"), F.col("path"))
    paths = items.select("path")
    classed = links.classify(each, base, site_hosts, paths, origins, policy.urls.repositories, "path")
    fine = ("internal-artifact-link", "documented-internal-url", "allowed-public-repository", "allowlisted-external-origin")
    one = lambda when, rule, detector: F.when(when, F.struct(F.lit(rule).alias("rule"), F.lit(detector).alias("detector")))
    own = F.concat(
        F.array_compact(F.array(one(F.col("size") > policy.max_bytes, "artifact_file_too_large", "max_file_bytes"), one(~F.col("valid") & ~F.col("binary"), "artifact_text_not_utf8", "utf-8"))),
        F.transform(inventory.name_hits(F.col("path"), policy.filenames, dict(policy.filename_patterns)), lambda n: F.struct(F.lit("forbidden_filename").alias("rule"), n.alias("detector"))),
    )
    units = exploded(files, "path", F.lit("full").alias("_contract"), u=_units(files, own)).select("path", "_contract", "u.*")
    judged = _judged(units, policy).where(~(F.col("path").isin(*controls) & F.col("rule").isin(*NAMED_BY_CONTROLS) & F.col("line_number").isNotNull()))
    gates = F.coalesce(*(F.when(F.col("rule") == r, F.lit(g)) for r, g in FILE_GATES.items()), F.lit("policy"))
    parts = [
        gate("inventory", inventory.missing(manifest, paths, "path"), "missing_artifact_path", "manifest"),
        gate("inventory", inventory.missing(paths, manifest, "path"), "extra_artifact_path", "manifest"),
        gate("inventory", inventory.collisions(paths, "path", text.fold(F.col("path"))), "artifact_path_collision", "nfkc_casefold"),
        gate("eligibility", paths.where(inventory.path_error(F.col("path")).isNotNull()).withColumn("rule", inventory.path_error(F.col("path"))), detector="path"),
        gate("eligibility", manifest.where(F.col("class").isin(*excluded)), "path_not_public_eligible", "class"),
        gate("parse", broken, detector="link_parser"),
        judged.select(gates.alias("gate"), "rule", "path", "detector"),
        gate("links", classed.where(~F.col("classification").isin(*fine)).withColumn("rule", F.col("classification")), detector="redacted_link_target"),
    ]
    if folders is not None:
        extra = rule_tables.folder_faults(manifest.select("path"), folders).where("fault = 'extra'")
        parts.append(gate("inventory", extra.select(F.col("folder").alias("path")), "extra_artifact_directory", "default_deny"))
    if sealed is not None:
        digests = _kept(files.select("path", "sha256"), "digests")
        other = digests.join(sealed.select("path", F.col("sha256").alias("_sealed")), "path").where("NOT sha256 <=> _sealed").select("path")
        parts.append(gate("eligibility", other, "artifact_commit_blob_mismatch", "git_object_binding"))
        parts.append(gate("policy", other.where(F.col("path").isin(*controls)), "publication_control_mismatch", "git_object_binding"))
        unseen = manifest.select("path").join(digests.where("sha256 IS NOT NULL").select("path"), "path", "left_anti")
        parts.append(gate("policy", unseen, "publication_policy_unscanned", "coverage"))
    listed = classed.select(F.col("path").alias("source_path"), "context", "classification", F.when(F.col("classification").isin(*fine), F.col("shown")).alias("target"), "fingerprint")
    return reduce(DataFrame.unionByName, parts).distinct(), listed


def gate_report(findings: DataFrame) -> DataFrame:
    return reports.gates(findings)
