"""Evidence against the truth, and released pages against what they must and must not say."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import case_folded
from ..operators.bags import bag_differences
from ..operators.inventory import drift
from ..operators.structured import json_leaves, unsafe_evidence

# The fields of a coverage record of sources and of artifacts, and forms of digests.
SOURCE_FIELDS = ("artifact_disposition", "artifact_manifest_class", "category", "content_contract", "git_blob_id", "git_mode", "media_type", "origin", "path", "scanner_status", "sha256", "size", "source_manifest_class")
SHA256, OBJECT_ID, MODES = "^[0-9a-f]{64}$", "^[0-9a-f]{40,64}$", ("100644", "100755")


def key_faults(documents: DataFrame, key: str, text: str, fields: tuple[str, ...]) -> DataFrame:
    """``(key, field, fault)``: top-level fields that JSON documents lack, or have and may not; no object is one fault."""
    keys = F.json_object_keys(text)
    want = F.array(*map(F.lit, fields))
    lists = F.concat(
        F.transform(F.array_except(want, keys), lambda x: F.struct(x.alias("field"), F.lit("missing").alias("fault"))),
        F.transform(F.array_except(keys, want), lambda x: F.struct(x.alias("field"), F.lit("unknown").alias("fault"))),
    )
    none = F.array(F.struct(F.lit(None).cast("string").alias("field"), F.lit("not an object").alias("fault")))
    return documents.select(F.col(key).alias("key"), F.explode(F.when(keys.isNull(), none).otherwise(lists)).alias("f")).select("key", "f.field", "f.fault")


def value_faults(documents: DataFrame, key: str, expected: dict[str, Column]) -> DataFrame:
    """``(key, field, fault)`` for every column that is not the value it must have, nulls equal to nulls."""
    wrong = [F.when(~F.col(c).eqNullSafe(v), F.struct(F.lit(c).alias("field"), F.lit("mismatch").alias("fault"))) for c, v in expected.items()]
    return documents.select(F.col(key).alias("key"), F.explode(F.array_compact(F.array(*wrong))).alias("f")).select("key", "f.field", "f.fault")


def record_faults(records: DataFrame, truth: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``(key, field, fault)``: records against the truth, both ways: a field that differs, a key twice, on one side only."""
    twice = records.groupBy(key).count().where("count > 1").select(F.col(key).alias("key"), F.lit(key).alias("field"), F.lit("repeated").alias("fault"))
    sides = records.select(key, F.lit(True).alias("_a")).distinct().join(truth.select(key, F.lit(True).alias("_b")), key, "full_outer")
    alone = sides.select(F.col(key).alias("key"), F.lit(key).alias("field"), F.when(F.col("_b").isNull(), "unexpected").when(F.col("_a").isNull(), "absent").alias("fault")).where("fault IS NOT NULL")
    there = records.join(truth.select(key), key, "left_semi")
    differ = drift(truth.join(there.select(key), key, "left_semi"), there, key, fields)
    return twice.unionByName(alone).unionByName(differ.select(F.col(key).alias("key"), "field", F.lit("mismatch").alias("fault")))


def form_faults(records: DataFrame, key: str = "path") -> DataFrame:
    """``(key, field, fault)`` for fields of coverage records that are not of the form they must have."""
    bad = {
        "sha256": ~F.coalesce(F.col("sha256").rlike(SHA256), F.lit(False)), "size": F.coalesce(F.col("size") < 0, F.lit(True)),
        "git_blob_id": ~F.coalesce(F.col("git_blob_id").rlike(OBJECT_ID), F.lit(False)), "git_mode": ~F.coalesce(F.col("git_mode").isin(*MODES), F.lit(False)),
        **{c: F.col(c).isNull() for c in ("category", "content_contract", "media_type", "artifact_disposition")},
    }
    own = [F.when(x, F.struct(F.lit(c).alias("field"), F.lit("malformed").alias("fault"))) for c, x in bad.items() if c in records.columns]
    return records.select(F.col(key).alias("key"), F.explode(F.array_compact(F.array(*own))).alias("f")).select("key", "f.field", "f.fault")


def evidence_faults(report: DataFrame, fields: tuple[str, ...], expected: dict[str, Column], truth: DataFrame, compared: list[str], record_fields: tuple[str, ...] = SOURCE_FIELDS, spec: str | None = None) -> DataFrame:
    """All that is wrong with ``report(id, text)``, one JSON evidence document with ``coverage_records``: ``(check, key, field, fault)``.

    Its own fields and those of its records are closed; fields in ``expected`` have set values; its records are those
    of ``truth`` by path, equal in ``compared``; nothing private stands in it.  Empty for evidence that holds.
    """
    kinds = ", ".join(f"{c} {'long' if c == 'size' else 'string'}" for c in record_fields)
    top = report.withColumn("_v", F.try_parse_json("text"))
    values = top.select("id", *(F.try_variant_get("_v", f"$.{c}", "string").alias(c) for c in expected))
    listed = top.select("id", F.explode(F.try_variant_get("_v", "$.coverage_records", "array<variant>")).alias("r")).withColumn("_text", F.to_json("r"))
    records = listed.select(F.from_json("_text", kinds).alias("r")).select("r.*")
    named = lambda check, faults: faults.select(F.lit(check).alias("check"), F.col("key").cast("string").alias("key"), "field", "fault")
    private = unsafe_evidence(json_leaves(report, "id", "text", empties=True), spec).select("key", F.col("path").alias("field"), "fault")
    checks = {
        "schema": key_faults(report, "id", "text", fields), "values": value_faults(values, "id", expected), "record schema": key_faults(listed.withColumn("path", F.try_variant_get("r", "$.path", "string")), "path", "_text", record_fields),
        "record form": form_faults(records), "truth": record_faults(records, truth, "path", compared), "private": private,
    }
    out = None
    for check, faults in checks.items():
        out = named(check, faults) if out is None else out.unionByName(named(check, faults))
    return out


def page_faults(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``(page, phrase, fault)``: ``pages(page, text)`` against ``rules(page, phrase, required, folded)``, joined by page.

    A required phrase that is missing, a forbidden one that is there; ``folded`` phrases are compared without case.
    """
    there = F.when(F.col("folded"), case_folded(F.col("text")).contains(case_folded(F.col("phrase")))).otherwise(F.col("text").contains(F.col("phrase")))
    joined = rules.join(pages.select("page", "text"), "page", "left").withColumn("_there", F.coalesce(there, F.lit(False)))
    fault = F.when(F.col("text").isNull(), "no page").when(F.col("required") & ~F.col("_there"), "missing").when(~F.col("required") & F.col("_there"), "forbidden")
    return joined.select("page", "phrase", fault.alias("fault")).where("fault IS NOT NULL")


def canonical_faults(pages: DataFrame, declared: DataFrame, sitemap: DataFrame) -> DataFrame:
    """``(page, fault)``: pages of ``declared(page, canonical)`` without that canonical link, or that the sitemap (``loc``) leaves out."""
    link = F.concat(F.lit('<link rel="canonical" href="'), "canonical", F.lit('">'))
    unlinked = declared.join(pages.select("page", "text"), "page", "left").where(~F.coalesce(F.col("text").contains(link), F.lit(False))).select("page", F.lit("canonical link").alias("fault"))
    unlisted = declared.join(sitemap.select(F.col("loc").alias("canonical")), "canonical", "left_anti").select("page", F.lit("sitemap").alias("fault"))
    return unlinked.unionByName(unlisted)


def told(faults: DataFrame) -> str:
    """Pass, or the first faults, for a log."""
    rows = [r.asDict() for r in faults.limit(20).collect()]
    return json.dumps({"result": "deny" if rows else "pass", "first": rows}, sort_keys=True, default=str)


def declared_counts(documents: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """``(key, name, declared)``: the fields of the object of counts at ``path`` of JSON documents; null for what is no whole number."""
    told = F.try_variant_get(F.try_parse_json(text), path, "map<string,variant>")
    each = documents.select(F.col(key).alias("key"), F.explode(told).alias("name", "v"))
    whole = F.schema_of_variant("v").isin("BIGINT")
    return each.select("key", "name", F.when(whole, F.try_variant_get("v", "$", "long")).alias("declared"))


def count_faults(declared: DataFrame, counted: DataFrame) -> DataFrame:
    """``(key, name, fault)``: ``declared(key, name, declared)`` against ``counted(key, name, n)``, what was counted again, both ways.

    A count that is ``missing``, of nothing that was counted (``unexpected``), ``no number``, or another one (``mismatch``).
    """
    d, c = declared.withColumn("_d", F.lit(True)), counted.withColumn("_c", F.lit(True))
    both = d.join(c, ["key", "name"], "full_outer")
    fault = F.when(F.col("_d").isNull(), "missing").when(F.col("_c").isNull(), "unexpected").when(F.col("declared").isNull(), "no number").when(F.col("declared") != F.col("n"), "mismatch")
    return both.select("key", "name", fault.alias("fault")).where("fault IS NOT NULL")


def stale_parts(report: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """``(part, row, n_declared, n_found)``: lists of the evidence document ``report(id, text)`` against the same ones made anew.

    ``parts`` maps the list's field to a table of what a new scan finds, each row an object of its columns.  Both are bags: order
    does not count, number does.  Empty for evidence that is not stale.
    """
    out = None
    for name, found in parts.items():
        told = F.try_variant_get(F.try_parse_json("text"), f"$.{name}", "array<variant>")
        listed = report.select(F.explode(told).alias("v")).select(F.to_json("v").alias("_text"))
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)
        declared = listed.select(F.from_json("_text", kinds).alias("r")).select("r.*")
        differ = bag_differences(declared, found.select(*declared.columns)).select(F.lit(name).alias("part"), F.to_json(F.struct(*declared.columns)).alias("row"), F.col("n_left").alias("n_declared"), F.col("n_right").alias("n_found"))
        out = differ if out is None else out.unionByName(differ)
    return out
