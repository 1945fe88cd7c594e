"""Digests that identify findings and redact what must not be shown."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def body_hash(body: Column) -> Column:
    return F.sha2(body, 256)


@F.pandas_udf(StringType())
def _ascii_json(texts: pd.Series) -> pd.Series:
    return texts.map(json.dumps, na_action="ignore").astype(object)


def _json_text(text: Column) -> Column:
    """A text as an ASCII JSON string; only control and non-ASCII characters need Python."""
    quoted = F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.coalesce(_ascii_json(F.when(text.rlike("[^\\x20-\\x7e]"), text)), quoted)


def evidence_id(**fields: Column) -> Column:
    """First 16 hex digits of the digest of the fields that are not null, as compact JSON sorted by name.

    Fields whose name ends in ``_no`` (the suffix is dropped) are numbers.
    """
    parts = []
    for name in sorted(fields):
        value = fields[name].cast("string") if name.endswith("_no") else _json_text(fields[name])
        parts.append(F.when(fields[name].isNotNull(), F.concat(F.lit(f'"{name.removesuffix("_no")}":'), value)))
    return F.substring(F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")), 256), 1, 16)


def redacted_path(path: Column, sensitive: Column) -> Column:
    return F.when(sensitive, F.concat(F.lit("redacted-path:"), F.substring(F.sha2(path, 256), 1, 16))).otherwise(path)
