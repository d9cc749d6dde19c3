"""Helpers shared by the operators: shared-folder tables, ranks, components and dealt buckets."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class Scratch:
    """Tables in the folder that every executor shares; writing one cuts the lineage.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a local session without that
    setting gets a temporary folder of its own; a cluster without it is refused.
    """

    def __init__(self, spark: SparkSession):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="llm-scratch-")
        self.spark, self.base, self.n = spark, f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        """Write the table and read it back."""
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *frames: DataFrame) -> None:
        """Delete kept tables that no later step reads."""
        jvm = self.spark._jvm
        for df in frames:
            for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
                path = jvm.org.apache.hadoop.fs.Path(name)
                if self.base.split("://")[-1].lstrip("/") in name:
                    path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def crc_bucket(column: str, n: int) -> Column:
    """crc32 of a column as text, modulo ``n``; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def lower_ascii(c: Column) -> Column:
    """Lower-case A to Z only."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


def shuffle_key(c: Column) -> Column:
    """A fixed pseudo-random 60-bit order key: the first 15 hex digits of the md5 of a value as text."""
    return F.conv(F.substring(F.md5(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def ranked(df: DataFrame, keys: list[str], order: str, ties: list[str], out: str, bits: int = 12) -> DataFrame:
    """Gapless rank from 0 within ``keys``, which hold no nulls, by the 60-bit key ``order`` and then ``ties``.

    A key may hold a third of all rows, so no window spans a key: rows are numbered within 2^bits ranges of the
    order key, and a range starts where the counts of the earlier ranges end. The counts are at most 2^bits rows a key.
    """
    part, base = f"{out}__part", f"{out}__base"
    df = df.withColumn(part, F.shiftright(order, 60 - bits).cast("int"))
    totals = df.groupBy(*keys, part).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(part).alias("__part"),
                           F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(base))
    same = F.col(part) == F.col("__part")
    for k in keys:
        same = same & (F.col(k) == F.col(f"__{k}"))
    own = Window.partitionBy(*keys, part).orderBy(order, *ties)
    df = df.withColumn(out, F.row_number().over(own) - 1)
    joined = df.join(totals, same, "inner")
    return joined.withColumn(out, F.col(out) + F.col(base)).drop(*[f"__{k}" for k in keys], "__part", part, base)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of undirected edges ``(a, b)`` of longs: rows ``(node, component)``, the smallest node.

    Alternates large-star and small-star until nothing changes. A node with very many neighbours is pre-aggregated
    to its minimum before the shuffle; the join back is one that adaptive execution may split.
    """
    e = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    seen = None
    while True:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("u2"), F.least("m", "u").alias("m"))
        large = both.join(least, F.col("u") == F.col("u2")).where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = scratch.keep(large.where("hi <> lo").distinct())
        low = large.groupBy("hi").agg(F.min("lo").alias("m")).withColumnRenamed("hi", "hi2")
        small = large.join(low, F.col("hi") == F.col("hi2"))
        small = small.select(F.greatest("lo", "m").alias("hi"), F.least("lo", "m").alias("lo")).where("hi <> lo")
        e2 = scratch.keep(small.union(low.select("hi2", "m")).distinct())
        now = e2.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        scratch.drop(e, large)
        e = e2
        if now == seen:
            break
        seen = now
    stars = e.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return stars.union(e.select(F.col("lo"), F.col("lo")).distinct())


def deal(rows: DataFrame, keys: list[str], by: str, limit: int, scratch: Scratch) -> DataFrame:
    """Deal the rows of buckets so that no task gets an unbounded one, yet any two rows of a bucket meet.

    Adds ``pi``, ``pj`` and ``part``. A bucket with more than ``limit`` rows is cut into parts by a hash of ``by``;
    a row goes to every pair of parts with its own, and rows of different parts meet in exactly one pair.
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > limit)
    big = scratch.keep(counts.select(*keys, F.ceil(F.col("__n") / limit).cast("int").alias("__parts")))
    out = rows.join(big, keys, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64(by), F.col("__parts")), F.lit(0)).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.coalesce(F.col("__parts"), F.lit(1)) - 1),
                       lambda p: F.struct(F.least(p, F.col("part")).alias("i"), F.greatest(p, F.col("part")).alias("j")))
    out = out.withColumn("__p", F.explode(pair))
    return out.withColumn("pi", F.col("__p.i")).withColumn("pj", F.col("__p.j")).drop("__p", "__parts")


def blocks(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 512) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Cut a stream sorted by ``keys`` into blocks of whole groups with about ``least`` rows or one larger group.

    Yields the rows of a block and the group number of each. Groups of one row are left out.
    """

    def whole(table: pa.Table, starts: np.ndarray) -> Iterator[tuple[pa.Table, np.ndarray]]:
        sizes = np.diff(starts)
        gid = np.repeat(np.arange(len(sizes)), sizes)
        keep = np.flatnonzero(sizes[gid] > 1)
        table, gid = table.take(pa.array(keep)), gid[keep]
        at = 0
        while at < len(gid):
            end = min(at + least, len(gid))
            end = int(np.searchsorted(gid, gid[end - 1], side="right"))
            yield table.slice(at, end - at), gid[at:end]
            at = end

    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]).combine_chunks() if rest is not None else table
        if not table.num_rows:
            continue
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for k in keys:
            col = table[k].to_numpy()
            new[1:] |= col[1:] != col[:-1]
        starts = np.flatnonzero(new)
        yield from whole(table.slice(0, starts[-1]), starts)
        rest = table.slice(starts[-1])
    if rest is not None and rest.num_rows:
        yield from whole(rest, np.array([0, rest.num_rows]))


def block_labels(near: np.ndarray) -> np.ndarray:
    """Smallest row number reachable from each row of a boolean adjacency matrix."""
    n = len(near)
    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(near, label[None, :], n).min(axis=1))
        new = new[new]
        if (new == label).all():
            return label
        label = new
