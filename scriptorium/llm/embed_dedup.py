"""Embedding near-dedup: Euclidean p-stable hashing, then exact cosines."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import Scratch, block_labels, blocks, components, deal

COSINE = 0.95
#: Tables, quantised projections a table, cell width. Unit vectors with cosine 0.95 lie 0.316 apart and share a cell of one
#: projection with probability 0.83, a bucket with 0.16, some bucket of 28 tables with 0.99; closer ones more often.
TABLES, PROJECTIONS, WIDTH = 28, 10, 1.5
PART_ROWS = 1024


def projections(dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fixed Gaussian directions, offsets and mixing factors of a dimension."""
    rng = np.random.default_rng([20, dim])
    a = rng.standard_normal((dim, TABLES * PROJECTIONS))
    return a, rng.uniform(0, WIDTH, TABLES * PROJECTIONS), rng.integers(1, 1 << 62, PROJECTIONS, np.int64) * 2 + 1


def keys(unit: np.ndarray) -> np.ndarray:
    """Bucket of each unit vector in each table, as longs."""
    a, b, mix = projections(unit.shape[1])
    cells = np.floor((unit @ a + b) / WIDTH).astype(np.int64).reshape(len(unit), TABLES, PROJECTIONS)
    with np.errstate(over="ignore"):
        return (cells * mix).sum(axis=2)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(id, n, dim, v)`` to one row a table."""
    for b in batches:
        t = pa.Table.from_batches([b])
        for dim in set(t["dim"].to_pylist()):
            some = t.filter(pc.equal(t["dim"], dim)).combine_chunks()
            k = keys(unit(matrix(some["v"].chunk(0), dim)))
            for i in range(TABLES):
                yield from some.append_column("tab", pa.array(np.full(len(k), i, np.int32))).append_column("key", pa.array(k[:, i])).to_batches()


def matched(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """For every vector with a link in its bucket: ``(id, root, links)``.

    ``root`` spans the links of the bucket. A link counts only in the first table whose bucket the two share, so sums
    over tables count it once; ``links`` counts the copies that a linked vector stands for.
    """
    for table, gid in blocks(batches, ["tab", "dim", "key", "pi", "pj"], 256):
        ids, n, tab, part = (table[c].to_numpy() for c in ("id", "n", "tab", "part"))
        dims = table["dim"].to_numpy()
        cross = table["pi"].to_numpy() != table["pj"].to_numpy()
        for dim in np.unique(dims):
            own = np.flatnonzero(dims == dim)
            u = unit(matrix(table["v"].combine_chunks().take(pa.array(own)), int(dim)))
            near = u @ u.T >= least
            near &= gid[own][:, None] == gid[own][None, :]
            near &= ~(cross[own][:, None] & (part[own][:, None] == part[own][None, :]))
            np.fill_diagonal(near, False)
            if not near.any():
                continue
            links, sig = np.zeros(len(own), np.int64), keys(u)
            i, j = np.nonzero(near)
            for at in range(0, len(i), 1 << 16):
                a, b = i[at:at + (1 << 16)], j[at:at + (1 << 16)]
                first = (sig[a] == sig[b]).argmax(axis=1) == tab[own][a]
                np.add.at(links, a[first], n[own][b[first]])
            root = block_labels(near)
            out = np.flatnonzero(near.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(ids[own][out]), pa.array(ids[own][root[out]]), pa.array(links[out])],
                                             ["id", "root", "links"])


def embedding_groups(vectors: DataFrame, scratch: Scratch, id_col: str = "vec_id", vector_col: str = "embedding",
                     cosine: float = COSINE) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of different lengths
    do not link. Equal vectors are one node, so a third of all rows being copies costs one row a task. A row with a
    repeated id counts as a vector of its own; a null id links with nothing and has a null component. An empty
    table gives no rows. Pairs are verified by their cosine in double precision.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(good & F.col("vec_id").isNotNull(), F.lit(False)))
    nodes = rows.where("ok").groupBy("v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"))
    nodes = scratch.keep(nodes.withColumn("dim", F.size("v")))
    kind = dict(nodes.dtypes)["v"]
    order = ["tab", "dim", "key", "pi", "pj"]
    tabled = nodes.select("id", "n", "dim", "v").mapInArrow(hashed, f"id long, n long, dim int, v {kind}, tab int, key long")
    dealt = deal(tabled, ["tab", "dim", "key"], "id", PART_ROWS, scratch).select(*order, "part", "id", "n", "v")
    found = dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(partial(matched, least=cosine), "id long, root long, links long")
    found = scratch.keep(found.groupBy("id", "root").agg(F.sum("links").alias("links")))
    comp = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), scratch)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    named = nodes.join(links, "id", "left").join(comp, F.col("id") == F.col("node"), "left")
    named = named.select(F.col("v").alias("nv"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"),
                         F.coalesce("component", "id").alias("component"))
    out = rows.join(named, F.col("ok") & (F.col("v") == F.col("nv")), "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                     F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


SQL = """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, len(v) AS dim, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM e),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.dim = b.dim AND a.vec_id <> b.vec_id AND list_dot_product(a.u, b.u) >= 0.95),
r AS (WITH RECURSIVE w(x, y) AS (SELECT a, b FROM l UNION SELECT w.x, l.b FROM w JOIN l ON w.y = l.a) SELECT x, min(y) AS m FROM w GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id,
  vec_id IS NOT DISTINCT FROM least(vec_id, coalesce(m, vec_id)) AS kept
FROM embeddings LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) ON vec_id = a LEFT JOIN r ON vec_id = x
"""
