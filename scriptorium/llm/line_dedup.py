"""Line dedup on content-defined chunks of lines."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import Scratch

#: A boundary follows a line where the rolling hash over this many line hashes is 0 modulo the divisor; so a chunk has about
#: so many lines, and at least two.
WINDOW, DIVISOR, LEAST = 2, 3, 2
BASE = np.uint64(0x9E3779B97F4A7C15)


def cut(lines: list[bytes]) -> list[tuple[int, int]]:
    """Chunks ``(first, after)`` of consecutive lines.

    The rolling hash of a line is a polynomial over the hashes of the last ``WINDOW`` lines, so the boundaries depend on the
    lines around them alone: they shift along with insertions elsewhere. A chunk has no largest size.
    """
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, lines), np.uint64, len(lines))
    roll = h.copy()
    with np.errstate(over="ignore"):
        power = np.uint64(1)
        for k in range(1, WINDOW):
            power = power * BASE
            roll[k:] += h[:-k] * power
    ends = np.flatnonzero((roll >> np.uint64(20)) % np.uint64(DIVISOR) == 0) + 1
    out, start = [], 0
    for e in [*ends.tolist(), len(lines)]:
        if e - start >= LEAST or (e == len(lines) and e > start):
            out.append((start, e))
            start = e
    return out


def chunked(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    """``(id, th, text)`` to its chunks of two lines and more: ``(id, th, start, size, last, lines, h1, h2[, chunk])``.

    ``start`` and ``size`` count characters with the line breaks after the chunk's lines; ``chunk`` has no final break.
    """
    for b in batches:
        for at in range(0, b.num_rows, 500):
            part = b.slice(at, 500)
            rows: list[tuple] = []
            for i, th, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)):
                text = t.as_py()
                if text is None or "\n" not in text:
                    continue
                own = text.split("\n")
                lines = [x.encode() for x in own]
                offset = np.concatenate([[0], np.cumsum([len(x) + 1 for x in own])]).tolist()
                for a, e in cut(lines):
                    if e - a >= LEAST:
                        chunk = b"\n".join(lines[a:e])
                        last = e == len(lines)
                        rows.append((i, th, offset[a], offset[e] - offset[a] - last, last, e - a,
                                     xxhash.xxh64_intdigest(chunk) - (1 << 63), xxhash.xxh3_64_intdigest(chunk) - (1 << 63), chunk))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                names = ["id", "th", "start", "size", "last", "lines", "h1", "h2", "chunk"]
                n = 9 if with_text else 8
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in list(zip(zip(*rows), kinds))[:n]], names[:n])


def repeated_chunks(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str) -> DataFrame:
    """Chunks to remove: ``(id, th, start, size, last, lines)``, all but the first of each repeated chunk.

    The first is that of the smallest (id, hash of the text, position). Chunks are grouped by their bytes; copies are
    merged before the shuffle. Should two different chunks share both hashes, neither is removed.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("th"), F.col(text_col).cast("string").alias("text"))
    place = "id long, th long, start int, size int, last boolean, lines int, h1 long, h2 long"
    full = rows.mapInArrow(partial(chunked, with_text=True), place + ", chunk binary")
    first = F.min(F.struct("id", "th", "start")).alias("first")
    groups = full.groupBy("h1", "h2", "chunk").agg(first, F.count(F.lit(1)).alias("n"))
    keys = groups.groupBy("h1", "h2").agg(F.first("first").alias("first"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"))
    again = scratch.keep(keys.where("n > 1 and texts = 1").select("h1", "h2", "first"))
    narrow = rows.mapInArrow(partial(chunked, with_text=False), place).join(again, ["h1", "h2"])
    return narrow.where(~F.struct("id", "th", "start").eqNullSafe(F.col("first"))).select("id", "th", "start", "size", "last", "lines").distinct()


def kept_text(text: Column, gone: Column) -> Column:
    """The text without the ranges ``gone``, an array of ``(start, size, ...)`` sorted by start."""
    ends = F.concat(F.array(F.lit(0)), F.transform(gone, lambda r: r["start"] + r["size"]))
    starts = F.concat(F.transform(gone, lambda r: r["start"]), F.array(F.length(text)))
    pieces = F.transform(ends, lambda e, i: F.substring(text, e + 1, F.get(starts, i) - e))
    joined = F.array_join(pieces, "")
    return F.when(F.exists(gone, lambda r: r["last"]), F.rtrim(joined, F.lit("\n"))).otherwise(joined)


def dedup_lines(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document as ``(row, new_text, chunks_removed, lines_removed)``; ``row`` is a struct of all its columns.

    A multi-line chunk that occurs again, in another document or the same, is removed everywhere but at its first place. If
    the last lines of a document go, so do the line breaks before them. Texts of one line, empty and null ones are unchanged.
    Rows with the same id and text are one document and treated alike; a null id sorts first. Other columns pass.
    """
    gone = repeated_chunks(docs, scratch, id_col, text_col)
    gone = gone.groupBy("id", "th").agg(F.sort_array(F.collect_list(F.struct("start", "size", "last", "lines"))).alias("gone"))
    packed = docs.select(F.struct("*").alias("row"))
    text = F.col(f"row.`{text_col}`").cast("string")
    same = F.col(f"row.`{id_col}`").cast("long").eqNullSafe(F.col("id")) & (F.xxhash64(text) == F.col("th"))
    out = packed.join(gone, same, "left")
    return out.select("row", F.when(F.col("gone").isNull(), text).otherwise(kept_text(text, F.col("gone"))).alias("new_text"),
                      F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("chunks_removed"),
                      F.coalesce(F.aggregate("gone", F.lit(0), lambda a, r: a + r["lines"]), F.lit(0)).cast("long").alias("lines_removed"))
