"""Rules as tables: hosts by label suffixes, paths by globs, inventories by folders. Equi joins, so rule tables may be of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .inventory import path_glob


def host_suffixes(host: Column) -> Column:
    """A host and all domains it is in, by whole labels: ``a.b.c``, ``b.c``, ``c``."""
    labels = F.split(host, "[.]")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def host_verdicts(hosts: DataFrame, rules: DataFrame, otherwise: str | None = None) -> DataFrame:
    """``hosts`` with ``rule`` and ``verdict`` of the longest domain of ``rules(domain, verdict)`` that its ``host`` is in.

    Case does not count; of two rules for one domain the verdict that is least in order holds.  Distinct hosts are
    looked up, so a host of many rows is expanded once.
    """
    ruled = rules.select(F.lower(F.ltrim("domain", F.lit("."))).alias("_suffix"), F.col("verdict").alias("_verdict")).groupBy("_suffix").agg(F.min("_verdict").alias("_verdict"))
    distinct = hosts.select(F.lower("host").alias("_host")).where("_host IS NOT NULL").distinct()
    met = distinct.select("_host", F.explode(host_suffixes(F.col("_host"))).alias("_suffix")).join(ruled, "_suffix")
    best = met.groupBy("_host").agg(F.max_by(F.struct("_suffix", "_verdict"), F.length("_suffix")).alias("_best"))
    joined = hosts.join(best, F.lower("host") == F.col("_host"), "left")
    return joined.select(*hosts.columns, F.col("_best._suffix").alias("rule"), F.coalesce("_best._verdict", F.lit(otherwise)).alias("verdict"))


def first_segment(glob: Column) -> Column:
    """The literal first segment of a glob, which its paths begin with; null if it has a wildcard."""
    head = F.split(F.ltrim(glob, F.lit("/")), "/")[0]
    return F.when(~head.rlike("[*?]"), head)


def glob_regex(glob: Column) -> Column:
    """``inventory.path_glob`` as a column of patterns."""
    quoted = F.regexp_replace(glob, "([.^$+(){}\\[\\]|\\\\])", "\\\\$1")
    steps = (("**", "\x01"), ("*", "[^/]*"), ("?", "[^/]"), ("\x01", ".*"))
    for old, new in steps:
        quoted = F.replace(quoted, F.lit(old), F.lit(new))
    return F.concat(F.lit("^"), quoted, F.lit("$"))


def glob_classes(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """``(path, class)``: every class of ``rules(glob, class)`` that a path of ``paths(path)`` is in, once.

    A rule meets only paths of its own first segment; those whose first segment has a wildcard are few in any policy and meet
    all paths, as one pattern a class.
    """
    keyed = rules.select("glob", "class", first_segment(F.col("glob")).alias("_head")).distinct()
    distinct = paths.select("path").distinct()
    own = distinct.withColumn("_head", F.split(F.ltrim("path", F.lit("/")), "/")[0])
    met = own.join(keyed.where("_head IS NOT NULL").withColumn("_regex", glob_regex(F.col("glob"))), "_head").where("rlike(path, _regex)").select("path", "class")
    wild = keyed.where("_head IS NULL").select("class", "glob").orderBy("class", "glob").limit(MAX_WILD + 1).collect()
    if len(wild) > MAX_WILD:
        raise ValueError(f"more than {MAX_WILD} globs begin with a wildcard")
    by_class: dict[str, list[str]] = {}
    for row in wild:
        by_class.setdefault(row["class"], []).append(path_glob(row["glob"]))
    hits = [F.when(F.col("path").rlike("|".join(own)), F.lit(name)) for name, own in by_class.items()]
    loose = distinct.select("path", F.explode(F.array_compact(F.array(*hits).cast("array<string>"))).alias("class"))
    return met.unionByName(loose).distinct()


#: Globs without a literal first segment that one table of rules may have.
MAX_WILD = 500


def parents(path: Column) -> Column:
    """All folders above a path, from the top."""
    names = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(names) - 1, F.lit(1))), lambda i: F.when(i < F.size(names), F.array_join(F.slice(names, F.lit(1), i), "/")))


def folders(paths: DataFrame) -> DataFrame:
    """``(folder)``: the distinct folders that the paths of ``paths(path)`` lie in, at any depth."""
    return paths.select(F.explode(F.array_compact(parents(F.col("path")))).alias("folder")).where("folder <> ''").distinct()


def folder_faults(declared: DataFrame, present: DataFrame) -> DataFrame:
    """``(folder, fault)``: folders of ``present(folder)`` in which nothing declared lies (``extra``), and those that declared files need (``missing``)."""
    needed, there = folders(declared), present.select("folder").distinct()
    extra = there.join(needed, "folder", "left_anti").select("folder", F.lit("extra").alias("fault"))
    return extra.unionByName(needed.join(there, "folder", "left_anti").select("folder", F.lit("missing").alias("fault")))
