"""Exact dedup by an extendible-hash index on shared files. DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import Scratch, lower_ascii

#: Distinct texts a bucket may hold before it is split, and bits of the hash beyond those that the number of texts asks for.
BUCKET_ROWS, SPARE = 4096, 6


def directory(entries: DataFrame, capacity: int, finest: int, scratch: Scratch) -> DataFrame:
    """Buckets of the index: ``(slot, bucket, depth)`` for every used slot of the finest directory.

    The directory starts with one bucket and doubles while a bucket holds more than ``capacity`` entries: the
    overfull ones are split by the next bit of the hash, the others keep their depth. Each step reads the counts of the
    finest slots, of which a bucket that is full has many. ``bucket`` is the first slot of the bucket's key range.
    """
    slots = scratch.keep(entries.groupBy(slot_of(F.col("h"), finest).alias("slot")).agg(F.count(F.lit(1)).alias("n")))
    done, open_, depth = None, slots, 0
    while True:
        bucket = F.shiftleft(F.shiftright("slot", finest - depth), finest - depth)
        level = open_.withColumn("bucket", bucket)
        load = level.groupBy("bucket").agg(F.sum("n").alias("load"))
        level = level.join(load, "bucket").withColumn("depth", F.lit(depth))
        full = level.where((F.col("load") > capacity) & (F.col("depth") < finest))
        ready = level.where((F.col("load") <= capacity) | (F.col("depth") >= finest)).select("slot", "bucket", "depth")
        done = ready if done is None else done.union(ready)
        if depth == finest:
            return done
        open_ = scratch.keep(full.select("slot", "n"))
        if open_.isEmpty():
            return done
        depth += 1


def slot_of(h: Column, finest: int) -> Column:
    return F.shiftrightunsigned(h, 64 - finest) if finest else F.lit(0).cast("long")


def index(entries: DataFrame, slots: DataFrame, finest: int) -> DataFrame:
    """The buckets' contents: ``(bucket, depth, h, chain)``, owned by the tasks of the buckets' key ranges.

    Entries ``(h, sha, keep_id, group_size)`` go to the owner of their bucket, which chains those of one hash in order of their
    SHA-256; the texts themselves were compared when copies were merged.
    """
    owned = entries.withColumn("slot", slot_of(F.col("h"), finest)).join(slots, "slot").repartition("bucket")
    link = F.struct("sha", "keep_id", "group_size")
    return owned.groupBy("bucket", "depth", "h").agg(F.array_sort(F.collect_list(link)).alias("chain"))


def exact_dedup(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text",
                capacity: int = BUCKET_ROWS) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256, bucket, depth``.

    Texts are equal when identical after lower-casing A to Z; a null text counts as empty. The row with the largest id
    of a group stays; with repeated ids, each repeated row counts and is marked alike. A null id never stays unless
    all ids of the group are null. An empty table gives no rows; columns beside id and text are not read.

    Copies are merged before the shuffle, by hash and bytes, so a group with a third of all rows costs one row a task and becomes
    one entry. Entries are dealt to the owners of the buckets, where those with one hash form a chain. A row is answered through the index alone:
    its slot names the bucket, the bucket holds the chain of its hash, and the link of its text has the answer.
    """
    keyed = docs.select(F.col(id_col).alias("doc_id"), lower_ascii(F.coalesce(F.col(text_col), F.lit(""))).alias("norm"))
    keyed = keyed.withColumn("h", F.xxhash64("norm"))
    entries = keyed.groupBy("h", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    entries = scratch.keep(entries.select("h", F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size"))
    finest = max(0, math.ceil(math.log2(max(1, entries.count() / capacity)))) + SPARE
    slots = scratch.keep(directory(entries, capacity, finest, scratch))
    buckets = scratch.keep(index(entries, slots, finest))
    return lookup(keyed.select("doc_id", "h", F.unhex(F.sha2("norm", 256)).alias("sha")), slots, buckets, finest)


def lookup(rows: DataFrame, slots: DataFrame, buckets: DataFrame, finest: int) -> DataFrame:
    """Answers of the index to rows ``(doc_id, h, sha)``; a row whose bucket is missing has none."""
    routed = rows.withColumn("slot", slot_of(F.col("h"), finest)).join(slots, "slot")
    found = routed.join(buckets.drop("depth"), ["bucket", "h"])
    own = F.get(F.filter("chain", lambda c: c["sha"] == F.col("sha")), F.lit(0))
    found = found.withColumn("own", own).where("own is not null")
    return found.select("doc_id", "own.keep_id", "own.group_size", F.col("doc_id").eqNullSafe(F.col("own.keep_id")).alias("kept"),
                        F.lower(F.hex("sha")).alias("text_sha256"), "bucket", "depth")


SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size, sha256(t) AS text_sha256 FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM d JOIN g USING (t)
"""
