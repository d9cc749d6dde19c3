"""Near copies by exact Jaccard similarity of word shingles; candidates from SimHash fingerprints and from banded minima."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import simhash
from scriptorium.llm.common import Scratch, blocks, components, deal
from scriptorium.llm.simhash import hashes

#: Words of a shingle, and the similarity of near copies.
SHINGLE, SIMILARITY = 5, 0.8
#: Bands of so many minima: a pair at 0.8 shares a band with probability 1 - (1 - 0.8^4)^24 = 0.999997.
BANDS, ROWS = 24, 4
#: Largest part of a hot bucket that one task compares at once.
PART_ROWS = 512
_RNG = np.random.default_rng(42)
_MUL = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a text with fewer words has one, one without words none."""
    parts = list(hashes(text, size=SHINGLE))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def keys(s: np.ndarray) -> np.ndarray:
    """One key a band; sets without elements share all of them."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(s), 1 << 12):
        x = s[at:at + (1 << 12), None] * _MUL + _ADD
        x ^= x >> np.uint64(32)
        low = np.minimum(low, (x * np.uint64(0x9E3779B97F4A7C15)).min(axis=0))
    out = np.zeros(BANDS, np.uint64)
    for r in range(ROWS):
        out = (out ^ low[r::ROWS]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out.view(np.int64)


def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(doc_id, text)`` with the hash ``th`` of the text to ``(doc_id, th, fp, digest, n, keys)``; equal sets have equal digests."""
    for b in batches:
        sets = [shingle_set(t.as_py()) for t in b.column(1)]
        digest = [int(np.bitwise_xor.reduce(s * np.uint64(0x9E3779B97F4A7C15) ^ s >> np.uint64(29))) if len(s) else 0 for s in sets]
        fps = np.fromiter((simhash.fingerprint(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(2), pa.array(fps.view(np.int64)), pa.array(np.array(digest, np.uint64).view(np.int64)), pa.array([len(s) for s in sets], pa.int32()),
             pa.array([keys(s).tolist() for s in sets], pa.list_(pa.int64()))], ["doc_id", "th", "fp", "digest", "n", "keys"])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sets is at least ``SIMILARITY``."""
    n, m = len(a), len(b)
    if min(n, m) < SIMILARITY * max(n, m):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= SIMILARITY * (n + m - both)


def joined(text: pa.ChunkedArray, ids: list[int], near: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of the rows that ``near`` allows and whose texts are similar enough; pairs that earlier ones or equal ids already join are not compared."""
    sets: dict[int, np.ndarray] = {}
    top = [ids.index(i) for i in ids]
    for y in range(len(top)):
        for x in np.flatnonzero(near[y, :y]).tolist():
            if top[x] == top[y]:
                continue
            for i in (x, y):
                if i not in sets:
                    sets[i] = shingle_set(text[i].as_py())
            if similar(sets[x], sets[y]):
                yield x, y
                old, new = top[y], top[x]
                top = [new if t == old else t for t in top]


def _edges(batches: Iterator[pa.RecordBatch], keys: list[str], near: Callable[[pa.Table, np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
    for table, gid in blocks(batches, [*keys, "pi", "pj"]):
        ids, part, cross = table["id"].to_numpy(), table["part"].to_numpy(), table["pi"].to_numpy() != table["pj"].to_numpy()
        out: list[tuple[int, int]] = []
        for g in np.unique(gid):
            at = np.flatnonzero(gid == g)
            some, own = table.slice(at[0], len(at)), ids[at].tolist()
            apart = (part[at][:, None] == part[at][None, :]) & cross[at[0]]
            out += [(own[x], own[y]) for x, y in joined(some["text"], own, near(some, apart))]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])


def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges ``(a, b)`` of the pairs within each bucket that are similar enough."""
    yield from _edges(batches, ["band", "key"], lambda _, apart: ~apart)


def near_linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges ``(a, b)`` of the pairs within each group whose fingerprints link and that are similar enough."""
    yield from _edges(batches, ["group"], lambda table, apart: simhash.near_pairs(table["fp"].to_numpy().view(np.uint64), apart))


def fingerprint_links(nodes: DataFrame, one: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges ``(a, b)`` of nodes ``(id, th, fp)`` whose SimHash fingerprints link and whose texts ``one`` (``th, text``) are similar enough.

    A pair can only link within a component of the fingerprints' links. In each, every two nodes whose fingerprints link, equal ones too, are checked on
    the whole texts unless edges already join them. A component with more than 512 nodes is dealt to parts that meet pairwise.
    """
    fps = scratch.keep(nodes.groupBy("fp").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("c")))
    comp = components(simhash.links(fps.select("fp", "id"), scratch).select("a", "b"), scratch)
    named = scratch.keep(fps.join(comp, F.col("id") == F.col("node"), "left").select("fp", "c", F.coalesce("component", "id").alias("group")))
    # only the texts of candidates are gathered
    several = named.groupBy("group").agg(F.sum("c").alias("c")).where("c > 1").select("group")
    rows = scratch.keep(nodes.join(named.join(several, "group").select("fp", "group"), "fp").select("group", "id", "th", "fp"))
    order = ["group", "pi", "pj"]
    full = deal(rows, ["group"], "id", PART_ROWS, scratch).join(one, "th").select(*order, "part", "id", "fp", "text")
    return full.repartition(*order).sortWithinPartitions(*order).mapInArrow(near_linked, "a long, b long")


def near_groups(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, th, component_id, keep_th``: one row a document; ``th`` is the hash of its text.

    Links join texts of Jaccard 0.8 or more. Shingles are five words of the whole text after lower-casing A to Z. A document is its id and
    text: rows that share an id but not the text are documents of their own. Of each group the one with the smallest id stays, then the
    smallest hash; null ids come last, so a null id stays only if its group has no other. Equal sets are one node, so copies cost nothing; texts
    without words are one group. Candidates are all pairs that the SimHash fingerprints link (``simhash.py``), and the banded minima for what these leave out,
    as pairs at 0.8 differ in more than 3 bits. Every candidate is checked on the whole sets unless others already join it. A bucket with more than 512 different sets
    is dealt to parts that meet pairwise. An empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.withColumn("th", F.xxhash64("text"))
    rows = scratch.keep(texts.select("doc_id", "text", "th").mapInArrow(signed, "doc_id long, th long, fp long, digest long, n int, keys array<long>"))
    least = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th").alias("s")
    # texts of one set can have several fingerprints
    nodes = rows.groupBy("digest", "n").agg(F.min(F.struct(least, "keys")).alias("a"), F.collect_set("fp").alias("fps"))
    nodes = scratch.keep(nodes.select("digest", "n", F.xxhash64("digest", "n").alias("id"), "a.s", F.col("a.s.th").alias("th"), "fps", "a.keys"))
    banded = nodes.select("id", "th", F.posexplode("keys").alias("band", "key"))
    # of buckets with the same members one is enough
    same = [F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("id", "th")).alias("x"), F.bit_xor(F.xxhash64("th", "id")).alias("y")]
    shared = banded.groupBy("band", "key").agg(*same).where("c > 1").dropDuplicates(["c", "x", "y"]).select("band", "key")
    dealt = deal(scratch.keep(banded.join(shared, ["band", "key"])), ["band", "key"], "th", PART_ROWS, scratch)
    one = texts.groupBy("th").agg(F.min("text").alias("text"))
    order = ["band", "key", "pi", "pj"]
    full = dealt.join(one, "th").select(*order, "part", "id", "text")
    edges = fingerprint_links(nodes.select("id", "th", F.explode("fps").alias("fp")), one, scratch).union(full.repartition(*order).sortWithinPartitions(*order).mapInArrow(linked, "a long, b long"))
    comp = components(edges, scratch)
    named = nodes.join(comp, F.col("id") == F.col("node"), "left").select("digest", "n", "s", F.coalesce("component", "id").alias("group"))
    kept = named.groupBy("group").agg(F.min("s").alias("keep"))
    named = named.join(kept, "group").select("digest", "n", F.col("keep.doc_id").alias("component_id"), F.col("keep.th").alias("keep_th"))
    return rows.join(named, ["digest", "n"]).select("doc_id", "th", "component_id", "keep_th")


def drop_near_duplicates(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all their columns, one of each group, as ``near_groups`` chooses; of rows that repeat its id and text one stays."""
    packed = docs.select(F.struct("*").alias("row"))
    packed = packed.withColumn("doc_id", F.col(f"row.`{id_col}`").cast("long")).withColumn("th", F.xxhash64(F.col(f"row.`{text_col}`").cast("string")))
    keep = near_groups(docs, scratch, id_col, text_col).where(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("th") == F.col("keep_th")))
    keep = keep.select(F.col("doc_id").alias("d2"), F.col("th").alias("t2")).distinct()
    kept = packed.join(keep, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("th") == F.col("t2")), "left_semi")
    return kept.groupBy("doc_id", "th").agg(F.first("row").alias("row")).select("row.*")
