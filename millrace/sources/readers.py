"""Sources as DataFrames, all through Spark's own readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold
from ..operators.audit import fixture_body
from ..operators.inventory import one_class_each, unsafe_path

MAX_FILE_BYTES = 5 << 20


def content(spark: SparkSession, folder: str, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """``(path, size, sha256, text)`` of the files below a folder; text is null above the size limit or if not UTF-8."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    small = F.col("length") <= max_bytes
    text = F.when(small & F.is_valid_utf8(F.col("content").cast("string")), F.regexp_replace(F.col("content").cast("string"), "^﻿", ""))
    return files.select("path", F.col("length").alias("size"), F.when(small, F.sha2("content", 256)).alias("sha256"), text.alias("text"))


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Paths and sizes only: the bytes are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("length").alias("size"))


def manifest_paths(spark: SparkSession, file: str) -> DataFrame:
    """Distinct paths in report order: a JSON list, or that in ``paths`` or ``files`` of an object; else one per NUL or line."""
    whole = spark.read.text(file, wholetext=True).select(F.regexp_replace("value", "^\ufeff", "").alias("value"))
    doc = F.try_parse_json(F.when(F.ltrim("value", F.lit(" \t\r\n")).rlike("^[\\[{]"), F.col("value")))
    strings = lambda p: F.try_variant_get(doc, p, "array<string>")
    plain = F.split("value", F.when(F.col("value").contains("\x00"), F.lit("\x00")).otherwise(F.lit("\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")))
    told = F.when(doc.isNotNull(), F.coalesce(strings("$.paths"), strings("$.files"), strings("$"), F.raise_error(F.lit("a JSON manifest is a list, or has one in paths or files")).cast("array<string>"))).otherwise(plain)
    return whole.select(F.explode(told).alias("path")).where("path <> ''").distinct().orderBy(F.lower("path"), "path")


def class_map(spark: SparkSession, file: str) -> DataFrame:
    """``(path, class)`` of a JSON manifest with ``source_classes: [{class, paths}]``."""
    doc = spark.read.schema("source_classes array<struct<class:string,paths:array<string>>>").json(file, multiLine=True)
    return doc.select(F.explode("source_classes").alias("c")).select(F.explode("c.paths").alias("path"), F.col("c.class").alias("class"))


def artifact_classes(spark: SparkSession, file: str) -> DataFrame:
    """``(path, class)`` of a JSON manifest with ``paths: [{path, class}]``; paths that collide or leave their root are an error."""
    doc = spark.read.schema("paths array<struct<path:string,class:string>>").json(file, multiLine=True)
    given = doc.select(F.explode("paths").alias("p")).select(F.replace("p.path", F.lit("\\"), F.lit("/")).alias("path"), "p.class")
    sound = F.when(unsafe_path(F.col("path")), F.raise_error(F.concat(F.lit("unsafe path: "), F.col("path")))).otherwise(F.col("path"))
    return one_class_each(given.withColumn("path", sound), fold(F.col("path")))


def checked_class_map(spark: SparkSession, file: str) -> DataFrame:
    """``class_map``; a path in two classes is an error."""
    return one_class_each(class_map(spark, file).distinct(), F.col("path"))


def fixtures(spark: SparkSession, file: str) -> DataFrame:
    """Saved answers ``(url, status, body, error)`` of a JSON document ``{responses: {url: {status, body | body_base64 | json, error}}}``."""
    doc = spark.read.text(file, wholetext=True).select(F.try_parse_json("value").alias("v"))
    each = doc.select(F.explode(F.try_variant_get("v", "$.responses", "map<string,variant>")).alias("url", "r"))
    get = lambda c: F.try_variant_get("r", f"$.{c}", "string")
    document = F.to_json(F.try_variant_get("r", "$.json", "variant"))
    return each.select("url", F.try_variant_get("r", "$.status", "int").alias("status"), fixture_body(get("body"), get("body_base64"), document).alias("body"), get("error").alias("error"))


def records(spark: SparkSession, file: str) -> DataFrame:
    """Hash-linked records, one JSON object a line."""
    return spark.read.schema("spec string, kind string, stream_id string, seq long, utc string, payload string, payload_hash string, prev string, prev_wave string, sig string, frame_hash string").json(file)


def sitemap(spark: SparkSession, file: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "url").schema("loc string, priority double").load(file)


def search_items(spark: SparkSession, file: str) -> DataFrame:
    """``(n, item)`` of saved search results: a list, ``results``, ``items``, or one object."""
    doc = spark.read.text(file, wholetext=True).select(F.try_parse_json("value").alias("v"))
    doc = doc.selectExpr("coalesce(try_variant_get(v, '$.results', 'array<variant>'), try_variant_get(v, '$.items', 'array<variant>'), try_variant_get(v, '$', 'array<variant>'), array(v)) AS items")
    return doc.select(F.posexplode("items").alias("p", "item")).select((F.col("p") + 1).alias("n"), "item")
