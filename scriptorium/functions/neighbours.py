"""Previous-row logic and ranks that stay even when one key holds a large share of all rows.

A window over a key puts the whole key in one task. Here the rows of a key with more than ``SPAN`` rows are
cut into buckets at quantiles of the order value, however it is spaced; a window works inside a
bucket, and the few rows that cross a border come from a table with one row per bucket.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a key that one window may hold, and buckets of a key with more.
SPAN, BUCKETS = 10_000, 256


def _bucketed(df: DataFrame, keys: Sequence[str], order: str, span: int) -> DataFrame:
    """Bucket ``__b`` of each row: 0 in a key with at most ``span`` rows, else one of ``BUCKETS`` by quantile; rows without an order come first."""
    at = F.col(order).cast("double")
    large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > span).select(*keys)
    # keys of ``large`` are unique, so this is a semi-join; written as one it would be pushed below a union, whose sides need not end with equal partitions
    cuts = df.join(large, list(keys)).groupBy(*keys).agg(
        F.percentile_approx(at, [i / BUCKETS for i in range(1, BUCKETS)], 16 * BUCKETS).alias("__cuts"))
    bucket = F.when(F.col("__cuts").isNull(), 0).when(at.isNull(), -1).otherwise(F.size(F.filter("__cuts", lambda c: c < at)))
    return df.join(cuts, list(keys), "left").withColumn("__b", bucket).drop("__cuts")


def numbered(df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str], out: str, span: int = SPAN) -> DataFrame:
    """Add ``out``: the rank of the row in its key from 1, by ``order`` and then ``ties``."""
    at = [*keys, "__b"]
    b = _bucketed(df, keys, order, span)
    sizes = b.groupBy(*at).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*at, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    own = F.row_number().over(Window.partitionBy(*at).orderBy(order, *ties))
    return b.withColumn(out, own).join(sizes, at).withColumn(out, (F.col(out) + F.col("__base")).cast("int")).select(*df.columns, out)


def previous(df: DataFrame, keys: Sequence[str], order: str, cols: Mapping[str, Column], span: int = SPAN) -> DataFrame:
    """Add ``out: value of the row before in the key`` for each of ``cols``, null on a key's first row."""
    b = _bucketed(df, keys, order, span).withColumn("__v", F.struct(*[c.alias(n) for n, c in cols.items()]))
    at = [*keys, "__b"]
    inside = b.withColumn("__in", F.lag("__v").over(Window.partitionBy(*at).orderBy(order)))
    edges = b.groupBy(*at).agg(F.max_by("__v", order).alias("__last"))
    edges = edges.select(*at, F.lag("__last").over(Window.partitionBy(*keys).orderBy("__b")).alias("__edge"))
    out = inside.join(edges, at).withColumn("__p", F.coalesce("__in", "__edge"))
    return out.select(*df.columns, *[F.col("__p")[n].alias(n) for n in cols])


def carried(df: DataFrame, keys: Sequence[str], order: str, cols: Mapping[str, Column], span: int = SPAN) -> DataFrame:
    """Add ``out: latest non-null value up to this row`` for each of ``cols``."""
    at = [*keys, "__b"]
    b = _bucketed(df, keys, order, span)
    for n, c in cols.items():
        b = b.withColumn(n, c)
    w = Window.partitionBy(*at).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    inside = b.select(*df.columns, "__b", *[F.last(n, ignorenulls=True).over(w).alias(n) for n in cols])
    edges = b.groupBy(*at).agg(*[F.max_by(n, F.when(F.col(n).isNotNull(), F.col(order))).alias(n) for n in cols])
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(*at, *[F.last(n, ignorenulls=True).over(before).alias(f"__{n}") for n in cols])
    return inside.join(edges, at).select(*df.columns, *[F.coalesce(n, f"__{n}").alias(n) for n in cols])
