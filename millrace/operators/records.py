"""Hash-linked records and sign-ups: chain checks, one sign-up per address, what is still to be sent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import first_word, normal_email, normal_phone

EMAIL = "^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$"


def chain_faults(records: DataFrame, stream: str, seq: str, link: str | None = None, own: str | None = None, heads: DataFrame | None = None) -> DataFrame:
    """``(stream, seq, fault)``: gaps and repeats in the numbering, links that do not name the record before.

    ``heads`` (of ``head``, by the same streams) are what earlier records ended with; their streams go on from there, a record of
    a head's number is a ``repeat`` and one of a lower number ``late``.  A stream is one window here: for streams that grow
    without end, or whose records come out of order, see ``streaming.chains``.
    """
    columns = [stream, seq, *([link, own] if link and own else [])]
    rows = records.select(*columns, F.lit(False).alias("_head"))
    if heads is not None:
        digest = [F.lit(None).cast("string").alias(link), F.col("digest").alias(own)] if link and own else []
        rows = rows.unionByName(heads.select(stream, F.col("seq").alias(seq), *digest, F.lit(True).alias("_head")))
    order = Window.partitionBy(stream).orderBy(F.col(seq), F.col("_head").desc())
    before = F.lag(seq).over(order)
    known = F.max(F.when(F.col("_head"), F.col(seq))).over(Window.partitionBy(stream)) if heads is not None else F.lit(None).cast("long")
    behind = F.when(F.col(seq) == known, "repeat").when(F.col(seq) < known, "late")
    fault = behind if heads is not None else F.lit(None).cast("string")
    fault = F.when(fault.isNotNull(), fault).when(before.isNull() & (F.col(seq) != 0), "start").when(F.col(seq) - before == 0, "repeat").when(F.col(seq) - before != 1, "gap")
    if link and own:
        fault = F.coalesce(fault, F.when(~F.col(link).eqNullSafe(F.lag(own).over(order)), "link"))
    return rows.select(stream, seq, fault.alias("fault"), "_head").where("fault IS NOT NULL AND NOT _head").drop("_head")


def head(records: DataFrame, stream: str, seq: str, digest: str | None = None) -> DataFrame:
    last = F.max_by(digest, seq) if digest else F.lit(None).cast("string")
    return records.groupBy(stream).agg(F.max(seq).alias("seq"), last.alias("digest"), F.count("*").alias("n"))


def heads_after(heads: DataFrame, records: DataFrame, stream: str, seq: str, digest: str | None = None) -> DataFrame:
    """``heads`` with ``records`` added to them."""
    both = heads.unionByName(head(records, stream, seq, digest))
    return both.groupBy(stream).agg(F.max("seq").alias("seq"), F.max_by("digest", "seq").alias("digest"), F.sum("n").alias("n"))


def clean_signups(raw: DataFrame) -> DataFrame:
    """Valid sign-ups with normal address and phone; the others are turned away."""
    cut = lambda c, n: F.substring(F.trim(F.coalesce(c, F.lit(""))), 1, n).alias(c)
    own = raw.select("ts", cut("name", 100), normal_email(F.col("email")).alias("email"), normal_phone(F.col("phone")).alias("phone"), cut("note", 2000), F.substring("source", 1, 100).alias("source"))
    return own.where((F.col("name") != "") & F.col("email").rlike(EMAIL)).withColumn("first_name", first_word(F.col("name")))


def first_signups(signups: DataFrame, key: str, *order: str) -> DataFrame:
    """The earliest row per key, by partial aggregation."""
    rest = [c for c in signups.columns if c != key]
    least = signups.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return least.select(key, *(F.col(f"r.{c}").alias(c) for c in rest))


def pending(signups: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Sign-ups with nothing done for them."""
    return signups.join(done.select(key).distinct(), key, "left_anti")


def pending_texts(signups: DataFrame) -> DataFrame:
    """``(name, email, phone, ts)`` of sign-ups with a phone number that were sent no text."""
    return signups.where((F.coalesce("phone", F.lit("")) != "") & (F.coalesce("texted_at", F.lit("")) == "")).select("name", "email", "phone", "ts")


def mark_texted(signups: DataFrame, callbacks: DataFrame) -> DataFrame:
    """``signups`` with ``texted_at`` of the latest of ``callbacks(texted, at)`` for the same address; every row of the address."""
    told = callbacks.groupBy(normal_email(F.col("texted")).alias("_email")).agg(F.max("at").alias("_at"))
    joined = signups.join(told, normal_email(F.col("email")) == F.col("_email"), "left")
    return joined.withColumn("texted_at", F.coalesce("_at", "texted_at")).select(*signups.columns)
