"""Inventories: what is declared against what is there, path classes, collisions, partitions."""

from __future__ import annotations

import mimetypes
import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalise_match_text


def missing(declared: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    return declared.select(key).distinct().join(actual.select(key), key, "left_anti")


def reconcile(declared: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """``(key, status)`` of every key on one side only."""
    gone = missing(declared, actual, key).withColumn("status", F.lit("missing"))
    return gone.unionByName(missing(actual, declared, key).withColumn("status", F.lit("extra")))


def drift(expected: DataFrame, observed: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``(key, field)`` for every field that differs, nulls equal to nulls; a row on one side only differs in all."""
    e, o = (d.select(key, F.lit(True).alias("_there"), *columns).alias(n) for d, n in ((expected, "e"), (observed, "o")))
    both = e.join(o, F.col(f"e.{key}") == F.col(f"o.{key}"), "full_outer")
    alone = F.col("e._there").isNull() | F.col("o._there").isNull()
    fields = F.array_compact(F.array(*(F.when(alone | ~F.col(f"e.{c}").eqNullSafe(F.col(f"o.{c}")), F.lit(c)) for c in columns)))
    return both.select(F.coalesce(f"e.{key}", f"o.{key}").alias(key), F.explode(fields).alias("field"))


def partition_faults(items: DataFrame, members: DataFrame, key: str, group: str) -> DataFrame:
    """Items in no group or in several, and members that are no items: empty if the groups are a partition."""
    counted = members.groupBy(key).agg(F.count_distinct(group).alias("n"))
    both = items.select(key, F.lit(1).alias("item")).distinct().join(counted, key, "full_outer")
    fault = F.when(F.col("item").isNull(), "unknown").when(F.col("n").isNull(), "unassigned").when(F.col("n") > 1, "overlap")
    return both.select(key, fault.alias("fault")).where("fault IS NOT NULL")


def collisions(paths: DataFrame, path: str, key: Column) -> DataFrame:
    """Distinct paths that share a folded key with another."""
    keyed = paths.select(path, key.alias("_key")).distinct()
    shared = keyed.groupBy("_key").count().where("count > 1").select("_key")
    return keyed.join(shared, "_key", "left_semi").select(path)


def path_glob(glob: str) -> str:
    """Site paths: one star stays within a directory, two cross them; case counts."""
    parts = re.split(r"(\*\*|\*|\?)", glob)
    return "^" + "".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p) if p else "") for p in parts) + "$"


def name_glob(glob: str) -> str:
    """File names: a star crosses directories too; case does not count."""
    parts = re.split(r"(\*|\?|\[[^\]]*\])", glob)
    return "(?is)^" + "".join({"*": ".*", "?": "."}.get(p, p.replace("[!", "[^") if p.startswith("[") else re.escape(p) if p else "") for p in parts) + "$"


def filename_fits(path: Column, globs: tuple[str, ...]) -> Column:
    """Whether a file glob fits a normalised path or its last part, case aside."""
    base = F.regexp_extract(path, "([^/]*)/*$", 1)
    return reduce(or_, (path.rlike(name_glob(g.replace("\\", "/"))) | base.rlike(name_glob(g.replace("\\", "/"))) for g in globs), F.lit(False))


def filename_findings(paths: DataFrame, globs: tuple[str, ...] = (), patterns: dict[str, str] | None = None) -> DataFrame:
    """``(path, rule, detector)``: one finding per file rule that a path breaks; patterns (identifier to expression) match the path."""
    made = paths.select("path", name_hits(F.col("path"), globs, patterns).alias("_hits"))
    return made.select("path", F.lit("forbidden_filename").alias("rule"), F.explode("_hits").alias("detector"))


def name_hits(path: Column, globs: tuple[str, ...] = (), patterns: dict[str, str] | None = None) -> Column:
    """The detectors of the file rules that a path breaks."""
    plain = normalise_match_text(path)
    hits = [F.when(filename_fits(plain, (g,)), F.lit(f"filename[{i}]")) for i, g in enumerate(globs)]
    hits += [F.when(plain.rlike(p), F.lit(name)) for name, p in (patterns or {}).items()]
    return F.array_compact(F.array(*hits).cast("array<string>"))


def categories(path: Column, rules: dict[str, str]) -> Column:
    """The classes of all globs that fit, sorted; rules are few, so they are unrolled."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(path.rlike(path_glob(g)), F.lit(c)) for g, c in rules.items())))))


def single_class(path: Column, rules: dict[str, str], default: str) -> Column:
    """The class of the one glob that fits, or the default; two that fit are an error of the rules."""
    fits = [path.rlike(name_glob(g)) for g in rules]
    count = sum((f.cast("int") for f in fits), F.lit(0))
    chosen = F.coalesce(*(F.when(f, F.lit(c)) for f, c in zip(fits, rules.values(), strict=True)), F.lit(default))
    return F.when(count > 1, F.raise_error(F.concat(F.lit("several classes for "), path))).otherwise(chosen)


def unsafe_path(path: Column) -> Column:
    """Absolute, with a drive, leaving its root, or with a NUL."""
    return path.rlike("^[/\\\\]|^[A-Za-z]:|(^|[/\\\\])\\.\\.([/\\\\]|$)|\\x00")


def path_error(path: Column) -> Column:
    """Why a declared path cannot be one: ``invalid_manifest_path`` or ``manifest_path_escape``; null for a relative path."""
    invalid = path.isNull() | (path == "") | path.contains("\x00") | path.contains("\\")
    escapes = path.rlike("^/|^[A-Za-z]:|(^|/)\\.\\.(/|$)|^\\./*$")
    return F.when(invalid, "invalid_manifest_path").when(escapes, "manifest_path_escape")


# How files begin that are no text, as hexadecimal; the first bytes that are looked at, and what share of controls is too much.
SIGNATURES = ("255044462D", "1F8B", "7F454C46", "89504E470D0A1A0A", "474946383761", "474946383961", "504B0304", "FFD8FF")
SNIFFED, CONTROLS = 8192, 0.30
#: Controls that texts do not have.
STRANGE = "[\\x00-\\x06\\x0b\\x0e-\\x1a\\x1c-\\x1f]"


def is_binary(data: Column) -> Column:
    """Whether bytes are no text: by signature, by a NUL, or by the share of control characters at the beginning."""
    start = F.hex(F.substring(data, 1, 8))
    signed = reduce(or_, (start.startswith(s) for s in SIGNATURES))
    raw, head = data.cast("string"), F.substring(data, 1, SNIFFED)
    strange = F.length(F.regexp_replace(F.decode(head, "ISO-8859-1"), f"{STRANGE}+", ""))
    some = F.when(head.cast("string").rlike(STRANGE), F.octet_length(head) - strange > CONTROLS * F.octet_length(head)).otherwise(False)
    # bytes of zero are looked for in all of the data
    return (F.octet_length(data) > 0) & (signed | raw.contains("\x00") | some)


def media_type(path: Column, binary: Column | None = None) -> Column:
    """The type by the path's extension; else text, or bytes where ``binary`` says so (without it: bytes)."""
    kinds = mimetypes.types_map | {".jsonl": "application/x-ndjson"}
    by = F.create_map(*(F.lit(x) for kv in sorted(kinds.items()) for x in kv))
    own = F.lower(F.regexp_extract(path, "(?:^|/)[^/]+([.][^./]+)$", 1))
    plain = F.lit("application/octet-stream") if binary is None else F.when(binary, "application/octet-stream").otherwise("text/plain")
    return F.when(path.isin("CNAME", ".nojekyll"), "text/plain").otherwise(F.coalesce(F.try_element_at(by, own), plain))


def one_class_each(entries: DataFrame, key: Column) -> DataFrame:
    """``entries(path, class)`` by path; two that share ``key`` are an error."""
    counted = entries.withColumn("_key", key).groupBy("_key").agg(F.count("*").alias("n"), F.min("path").alias("path"), F.min("class").alias("class"))
    return counted.select(F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("path collision: "), F.col("path")))).otherwise(F.col("path")).alias("path"), "class")


def size_findings(items: DataFrame, limit: int) -> DataFrame:
    """``(path, rule)`` for items of ``(path, size)`` that are too large to be scanned."""
    return items.where(F.col("size") > limit).select("path", F.lit("file_too_large").alias("rule"))


def both_sides(one: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """The keys that both have."""
    return one.select(key).intersect(other.select(key))
