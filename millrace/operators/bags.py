"""Two tables as bags of rows: whether they are equal, and which rows one has more often than the other.

Each side is summed to one row of digest sums per bucket, by partial aggregation, so two equal tables of any size meet in
``BUCKETS`` rows a side; only rows of buckets whose sums differ are shuffled and compared as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096
_SUMS = ("n", "a", "b", "c", "d")


def _hash(columns: list[str], seed: str) -> Column:
    """A 64-bit digest of a row in which a null is not the same as no column."""
    return F.xxhash64(F.lit(seed), *(x for c in columns for x in (F.col(c).isNull(), F.col(c))))


def bucket_of(columns: list[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(_hash(columns, "bucket"), F.lit(buckets))


def bag_digests(rows: DataFrame, columns: list[str], buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, n, a, b, c, d)``: rows, and the sums of four 32-bit parts of two digests of theirs, per bucket."""
    parts = [F.shiftrightunsigned(F.shiftleft(_hash(columns, seed), at), 32) for seed in ("x", "y") for at in (0, 32)]
    return rows.groupBy(bucket_of(columns, buckets).alias("bucket")).agg(F.count("*").alias("n"), *(F.sum(p).alias(s) for p, s in zip(parts, _SUMS[1:], strict=True)))


def open_buckets(left: DataFrame, right: DataFrame, columns: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The buckets in which two tables differ: none if they are equal as bags."""
    ours, theirs = (bag_digests(t, columns, buckets).select("bucket", F.struct(*_SUMS).alias(s)) for t, s in ((left, "ours"), (right, "theirs")))
    return ours.join(theirs, "bucket", "full_outer").where(~F.col("ours").eqNullSafe(F.col("theirs"))).select("bucket")


def bag_differences(left: DataFrame, right: DataFrame, columns: list[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """``columns`` with ``n_left`` and ``n_right`` for every distinct row that the two have not equally often; nulls are equal."""
    columns = columns or left.columns
    differ = F.broadcast(open_buckets(left, right, columns, buckets))  # at most ``buckets`` rows
    near = lambda t, own: t.select(*columns).withColumn("_bucket", bucket_of(columns, buckets)).join(differ, F.col("_bucket") == F.col("bucket"), "left_semi").select(*columns, F.lit(own).alias("_own"))
    both = near(left, 1).unionByName(near(right, 0))
    counted = both.groupBy(*columns).agg(F.sum("_own").alias("n_left"), F.sum(1 - F.col("_own")).alias("n_right"))
    return counted.where("n_left <> n_right")


def bag_equal(left: DataFrame, right: DataFrame, columns: list[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """One row, ``equal``."""
    return open_buckets(left, right, columns or left.columns, buckets).agg((F.count("*") == 0).alias("equal"))
