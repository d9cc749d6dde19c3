"""SimHash near-dedup with a bit-sliced comparison of fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import Scratch, block_labels, blocks, components, deal

#: Two fingerprints that differ in at most 3 of 64 bits agree on at least two of these five bands.
RADIUS, BANDS = 3, (13, 13, 13, 13, 12)
#: Largest part of a hot bucket that one task compares at once.
PART_ROWS = 2048
SEED, SHINGLE = 42, 3


def hashes(text: str | None, seed: int = SEED, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """XXH64 of every shingle of the lower-cased (A to Z) words, in arrays of bounded length."""
    words = (text or "").encode().lower().split()
    if not words:
        return
    if len(words) < size:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
        return
    n = len(words) - size + 1
    joined = map(b" ".join, zip(*(words[i:] for i in range(size))))
    for at in range(0, n, 1 << 16):
        m = min(1 << 16, n - at)
        yield np.fromiter(map(xxhash.xxh64_intdigest, (next(joined) for _ in range(m)), repeat(seed)), np.uint64, m)


def fingerprint(text: str | None) -> int:
    """Bit i is 1 if it is set in over half of the shingle hashes; no words give 0."""
    counts, n = np.zeros(64, np.int64), 0
    for h in hashes(text):
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0]) if n else 0


def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(doc_id, text)`` to ``(doc_id, fp)`` with the fingerprint as a signed long."""
    for b in batches:
        fps = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])


def near_pairs(fps: np.ndarray, apart: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Boolean matrix of the rows within ``radius`` bits, where ``apart`` does not rule the pair out.

    The 64 bit planes of the block lie vertically, 64 rows a word. One plane updates the distances of 64 rows to a
    query row with a handful of word operations: two carry-save counters and a mark for four or more. A query
    row whose whole block is beyond the radius is abandoned.
    """
    assert radius == 3, "two carry-save counters hold distances to 3"
    n = len(fps)
    width = -(-n // 64)

    def packed(m: np.ndarray) -> np.ndarray:
        m = np.pad(m, ((0, 0), (0, width * 64 - n)), constant_values=True)
        return np.ascontiguousarray(np.packbits(m, axis=1, bitorder="little")).view(np.uint64)

    bits = np.unpackbits(fps.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").astype(bool)
    planes = packed(bits.T)
    over = packed(apart)
    ones, twos = np.zeros_like(over), np.zeros_like(over)
    full, zero = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0)
    rows = np.arange(n)
    result = over.copy()
    for b in range(64):
        if b % 8 == 0:
            live = (over != full).any(axis=1)
            if not live.all():
                result[rows[~live]] = full
                rows, over, ones, twos = rows[live], over[live], ones[live], twos[live]
                if not len(rows):
                    break
        differs = planes[b][None, :] ^ np.where(bits[rows, b], full, zero)[:, None]
        carry = ones & differs
        ones ^= differs
        over |= twos & carry
        twos ^= carry
    result[rows] = over
    far = np.unpackbits(np.ascontiguousarray(result).view(np.uint8).reshape(n, -1), axis=1, bitorder="little")[:, :n]
    return far == 0


def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Star edges ``(a, b)`` that span what is linked within each bucket."""
    for table, gid in blocks(batches, ["band", "key", "pi", "pj"]):
        fps, ids = table["fp"].to_numpy().view(np.uint64), table["id"].to_numpy()
        part, cross = table["part"].to_numpy(), table["pi"].to_numpy() != table["pj"].to_numpy()
        apart = gid[:, None] != gid[None, :]
        apart |= cross[:, None] & (part[:, None] == part[None, :])
        label = block_labels(near_pairs(np.ascontiguousarray(fps), apart))
        out = np.flatnonzero(label != np.arange(len(label)))
        if len(out):
            yield pa.RecordBatch.from_arrays([pa.array(ids[out]), pa.array(ids[label[out]])], ["a", "b"])


def links(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges ``(a, b)`` between the ids of different fingerprints ``(fp, id)`` that link.

    Buckets are the ten choices of two bands of 25 or 26 bits, so links are found without loss. A bucket with more
    than 2,048 different fingerprints is dealt to parts that meet pairwise.
    """
    masks, at = [], 0
    for w in BANDS:
        masks.append(((1 << w) - 1) << at)
        at += w
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in (masks[i] | masks[j] for i, j in combinations(range(len(BANDS)), 2))]
    bands = F.array(*[F.struct(F.lit(k).alias("band"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(signed)])
    banded = nodes.withColumn("b", F.explode(bands)).select("b.band", "b.key", "fp", "id")
    order = ["band", "key", "pi", "pj"]
    dealt = deal(banded, ["band", "key"], "id", PART_ROWS, scratch).select(*order, "part", "fp", "id")
    return dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(linked, "a long, b long")


def simhash_groups(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, fp`` (long) and ``component_id``, the smallest id reachable by links.

    Words and shingles are those of the whole text after lower-casing A to Z; a text without words, null ones too, has
    fingerprint zero and is linked like any other. Equal fingerprints are one node, so copies cost nothing. A row with a
    null id is a row like others, but never names a component: its component is that of its fingerprint, null if
    no row with an id has it. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = scratch.keep(rows.mapInArrow(fingerprints, "doc_id long, fp long"))
    nodes = scratch.keep(rows.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id")))
    comp = components(links(nodes, scratch), scratch)
    named = nodes.join(comp, F.col("id") == F.col("node"), "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return rows.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def fingerprint_hex(c):
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def drop_near_duplicates(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all their columns, one of each group: the one with the smallest id.

    Of rows that repeat this id one stays, whichever; rows with a null id stay.
    """
    packed = docs.select(F.struct("*").alias("row"))
    packed = packed.withColumn("doc_id", F.col(f"row.`{id_col}`").cast("long"))
    keep = simhash_groups(docs, scratch, id_col, text_col).where("doc_id = component_id").select("doc_id").distinct()
    null = packed.where("doc_id is null")
    kept = packed.join(keep, "doc_id", "left_semi")
    first = kept.groupBy("doc_id").agg(F.first("row").alias("row"))
    return first.select("row.*").union(null.select("row.*"))
