"""Scan reports: coverage per item, findings per gate, one pass-or-deny row."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import fold
from ..operators.shapes import count_over

GATES = ("inventory", "eligibility", "parse", "policy", "links")


def coverage(items: DataFrame, findings: DataFrame, path: str, text: str) -> DataFrame:
    """Every item with size, digest and deny if anything was found in it."""
    denied = findings.groupBy("path").agg(F.count("*").alias("n_findings"))
    own = items.select(F.col(path).alias("path"), F.octet_length(text).alias("size"), F.sha2(text, 256).alias("sha256"))
    n = F.coalesce("n_findings", F.lit(0))
    return own.join(denied, "path", "left").select("path", "size", "sha256", n.alias("n_findings"), F.when(n > 0, "deny").otherwise("pass").alias("status"))


def gates(findings: DataFrame) -> DataFrame:
    return count_over(findings, "gate", GATES).withColumn("result", F.when(F.col("n") > 0, "deny").otherwise("pass"))


def summary(covered: DataFrame) -> DataFrame:
    """One row, on empty input too."""
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return covered.agg(
        F.count("*").alias("scanned"), n(F.when(F.col("status") == "deny", 1)).alias("denied"), n("n_findings").alias("findings"), n("size").alias("bytes"),
        F.coalesce(F.min("status"), F.lit("pass")).alias("result"),
    )


def render(report: DataFrame) -> str:
    """A one-row report as sorted JSON."""
    row = report.first()
    return json.dumps(row.asDict(True) if row else {}, indent=2, sort_keys=True)


#: The order of a report: path (case aside), place (a missing one first), rule, detector.
REPORT_ORDER = ("lower(path)", "path", "coalesce(line_number, 0)", "coalesce(column, 0)", "rule", "detector")


def write_shards(findings: DataFrame, folder: str, order: tuple[str, ...] = REPORT_ORDER) -> None:
    """``findings`` in report order as shards of a range each, sorted, with ``_shard`` and ``_place``: no task sees more than its range."""
    by = [F.expr(o).asc_nulls_first() for o in order]
    ranged = findings.repartitionByRange(*by).sortWithinPartitions(*by)
    ranged.select("*", F.spark_partition_id().alias("_shard"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_place")).write.parquet(folder)


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Shards of ``write_shards`` with ``row``, the number in the whole report from 1: a shard's first one from the counts of those before it."""
    shards = spark.read.parquet(folder)
    counts = {r["_shard"]: r.n for r in shards.groupBy("_shard").agg(F.count("*").alias("n")).collect()}  # a row per shard
    starts, total = [], 0
    for shard in sorted(counts):
        starts.append((shard, total))
        total += counts[shard]
    first = spark.createDataFrame(starts, "_shard int, _first long")
    return shards.join(F.broadcast(first), "_shard").withColumn("row", F.col("_first") + F.col("_place") + 1).drop("_shard", "_place", "_first")


def numbered(findings: DataFrame, order: tuple[str, ...] = REPORT_ORDER) -> DataFrame:
    """``findings`` with ``row``, their number in report order, by way of shards in the folder that ``spark.checkpoint.dir`` names.

    Without such a folder (a session in one process) by one window.
    """
    spark = findings.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return findings.withColumn("row", F.row_number().over(Window.orderBy(*(F.expr(o).asc_nulls_first() for o in order))).cast("long"))
    path = f"{folder.rstrip('/')}/report-{uuid.uuid4().hex}"
    findings.write.parquet(f"{path}-found")  # ranges are drawn from a sample, which else makes all findings a second time
    write_shards(spark.read.schema(findings.schema).parquet(f"{path}-found"), path, order)
    return read_shards(spark, path)


def artifact_order(findings: DataFrame) -> DataFrame:
    """Findings by folded path, path, gate, rule and detector."""
    return findings.orderBy(fold(F.col("path")), "path", "gate", "rule", "detector")


def link_order(links: DataFrame) -> DataFrame:
    """Link records by folded source, source, class, target (a missing one first), fingerprint and context."""
    return links.orderBy(fold(F.col("source_path")), "source_path", "classification", F.coalesce("target", F.lit("")), "fingerprint", "context")


def cell(value: Column) -> Column:
    """A value as it may stand in a table of Markdown."""
    return F.replace(F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def markdown(artifacts: DataFrame, classes: tuple[str, ...], title: str) -> DataFrame:
    """``(part, line)``: an audit as Markdown, ordered by part: a head, counts of all classes, a row per artifact."""
    spark = artifacts.sparkSession
    say = lambda lines, part: spark.range(1).select(F.lit(part).alias("part"), F.posexplode(F.array(*map(F.lit, lines))).alias("place", "line"))
    total = artifacts.agg(F.lit(1).alias("part"), F.lit(0).alias("place"), F.concat(F.lit("Artifacts audited: **"), F.count("*"), F.lit("**")).alias("line"))
    rank = F.array_position(F.array(*map(F.lit, classes)), F.col("classification")).cast("int")
    counts = count_over(artifacts, "classification", classes).select(F.lit(3).alias("part"), rank.alias("place"), F.concat(F.lit("| "), "classification", F.lit(" | "), "n", F.lit(" |")).alias("line"))
    matches = F.col("matches") if "matches" in artifacts.columns else F.array().cast("array<string>")
    detail = F.when(F.size(matches) > 0, F.concat(F.lit("matches: "), F.array_join(matches, ", "))).otherwise(F.col("detail"))
    values = F.concat_ws(" | ", *(cell(c) for c in (F.col("kind"), F.col("source"), F.col("classification"), F.col("status"), F.col("sha256"), detail)))
    rows = artifacts.select(F.lit(5).alias("part"), F.lit(0).alias("place"), F.concat(F.lit("| "), values, F.lit(" |")).alias("line"))
    heads = say([f"# {title}", ""], 0).unionByName(say(["", "| Classification | Count |", "| --- | ---: |"], 2)).unionByName(say(["", "| Kind | Source | Classification | Status | SHA-256 | Detail |", "| --- | --- | --- | ---: | --- | --- |"], 4))
    return heads.unionByName(total).unionByName(counts).unionByName(rows).orderBy("part", "place", "line").select("part", "line")


def write_pair(artifacts: DataFrame, classes: tuple[str, ...], title: str, folder: str) -> None:
    """An audit as JSON lines and as Markdown, in two folders below ``folder``."""
    artifacts.orderBy("kind", "source").write.mode("overwrite").json(f"{folder}/json")
    markdown(artifacts, classes, title).select("line").coalesce(1).write.mode("overwrite").text(f"{folder}/markdown")
