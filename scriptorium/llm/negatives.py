"""Hard-negative mining by Fagin's threshold algorithm over per-dimension sorted lists."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.llm.common import Scratch

#: Anchors are rows whose id is divisible by EVERY; positives of an anchor; negatives of a pair; least share of the positive's score in percent.
EVERY, POSITIVES, NEGATIVES, LEAST = 100, 5, 5, 80
#: Components become floor(SCALE * x).
SCALE = 256
#: Candidates and anchors of a cell, and the entries read from each list at first; every round reads twice as many.
CANDIDATES, ANCHORS, FIRST = 16_384, 4_096, 16


class Lists:
    """Candidates of a cell in order of id, and for each dimension their order by component."""

    def __init__(self, vectors: np.ndarray):
        self.exact = float if vectors.size == 0 or float(np.abs(vectors).max()) ** 2 * vectors.shape[1] < 2.0 ** 52 else np.int64
        self.rows = vectors.astype(self.exact)
        self.order = np.argsort(self.rows, axis=0, kind="stable").T.astype(np.int32)
        self.scored = 0

    def search(self, anchor: np.ndarray, allowed: np.ndarray, lows: np.ndarray, highs: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For every window of scores the first ``k`` allowed candidates by score, then by place: their places and scores.

        Sorted access goes down the lists of positive anchor components and up those of negative ones; each candidate met is
        scored whole. No candidate not yet met scores above the threshold, the sum over the lists of the last component read
        times the anchor's. A window closes when the threshold lies strictly below its k-th score, or below its low end.
        """
        n, a = len(self.rows), anchor.astype(self.exact)
        up, down = np.flatnonzero(a < 0), np.flatnonzero(a > 0)
        found = [(np.zeros(0, np.int64), np.zeros(0, self.exact)) for _ in lows]
        is_open, met, depth, step = [True] * len(lows), np.zeros(n, bool), 0, FIRST
        if not len(up) and not len(down):
            step = n
        while depth < n and any(is_open):
            to = min(n, depth + step)
            before = met.copy()
            met[self.order[up, depth:to].ravel()] = True
            met[self.order[down, n - to:n - depth].ravel()] = True
            if to == n:
                met[:] = True
            new = np.flatnonzero(met & ~before & allowed)
            score = self.rows[new] @ a
            self.scored += len(new)
            most = (a[up] * self.rows[self.order[up, to - 1], up]).sum() + (a[down] * self.rows[self.order[down, n - to], down]).sum()
            for w, (low, high) in enumerate(zip(lows, highs)):
                if not is_open[w]:
                    continue
                at, have = found[w]
                fit = (score <= high) & (score >= (max(low, have[-1]) if len(at) == k else low))
                if fit.any():
                    at, have = np.concatenate([at, new[fit]]), np.concatenate([have, score[fit]])
                    best = np.lexsort((at, -have))[:k]
                    found[w] = at, have = at[best], have[best]
                is_open[w] = not (most < low or (len(at) == k and most < have[-1]))
            depth, step = to, 2 * step
        return [(at, have.astype(np.int64)) for at, have in found]


def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one cell after the other from a stream sorted by cell."""
    held: list[pa.Table] = []
    for b in batches:
        t = pa.Table.from_batches([b])
        if not t.num_rows:
            continue
        cell = np.stack([t[c].to_numpy() for c in ("dim", "g", "b")])
        cuts = np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(axis=0)) + 1
        for i, (x, y) in enumerate(zip([0, *cuts], [*cuts, t.num_rows])):
            part = t.slice(x, y - x)
            if held and (i or any(held[0][c][0].as_py() != part[c][0].as_py() for c in ("dim", "g", "b"))):
                yield pa.concat_tables(held).combine_chunks()
                held = []
            held.append(part)
    if held:
        yield pa.concat_tables(held).combine_chunks()


def matrix(table: pa.Table, dim: int) -> np.ndarray:
    flat = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64).reshape(table.num_rows, dim)


def searched(batches: Iterator[pa.RecordBatch], same: bool, k: int) -> Iterator[pa.RecordBatch]:
    """Cells of candidates and anchors to ``(anchor, window, row, id, score)``: the first candidates of each window of each anchor."""
    for t in cells(batches):
        dim = t["dim"][0].as_py()
        is_anchor = t["anchor"].to_numpy(zero_copy_only=False)
        anchors, cands = t.filter(pa.array(is_anchor)), t.filter(pa.array(~is_anchor))
        if not anchors.num_rows or not cands.num_rows:
            continue
        cands = cands.take(pa.array(np.lexsort((cands["row"].to_numpy(), cands["id"].to_numpy()))))
        lists, ids, rows, labels = Lists(matrix(cands, dim)), *(cands[c].to_numpy() for c in ("id", "row", "label"))
        vectors, wins = matrix(anchors, dim), anchors["windows"].to_pylist()
        cols: list[list[np.ndarray]] = [[], [], [], [], []]
        for i, (row, label) in enumerate(zip(anchors["row"].to_pylist(), anchors["label"].to_pylist())):
            w = wins[i]
            allowed = (labels == label) & (rows != row) if same else labels != label
            low, high = np.array([x["low"] for x in w]), np.array([x["high"] for x in w])
            for x, (at, score) in zip(w, lists.search(vectors[i], allowed, low, high, k)):
                for c, value in zip(cols, (np.full(len(at), row), np.full(len(at), x["window"]), rows[at], ids[at], score)):
                    c.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in cols], ["anchor", "window", "row", "id", "score"])


def first(rows: DataFrame, anchors: DataFrame, blocks: int, groups: int, same: bool, k: int) -> DataFrame:
    """The first ``k`` candidates over all blocks: ``(anchor, window, row, id, score, rank)``.

    Candidates are cut into blocks and anchors into groups by a hash of the row, so a cell's size does not depend on labels or
    copies; every group meets every block, and only the first ``k`` of a block leave it.
    """
    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    group = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(groups)).cast("int")
    none = F.array().cast("array<struct<window:bigint,low:bigint,high:bigint>>")
    cands = rows.select("dim", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), block.alias("b"), F.lit(False).alias("anchor"),
                        "row", "id", "label", "v", none.alias("windows"))
    asked = anchors.select("dim", group.alias("g"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), F.lit(True).alias("anchor"),
                           "row", "id", "label", "v", "windows")
    dealt = cands.union(asked).repartition("dim", "g", "b").sortWithinPartitions("dim", "g", "b")
    found = dealt.mapInArrow(partial(searched, same=same, k=k), "anchor long, window long, row long, id long, score long")
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, scratch: Scratch, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   least: int = LEAST, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: the hard negatives of all anchors.

    Scores are integer inner products of floor(256 x), exact up to 2^63. Anchors are rows whose id is divisible by ``every``; their
    positives are the ``positives`` other rows of their label that score highest, their negatives rows of other labels that
    score at least ``least`` percent of the positive and no more than it. Higher scores come first, ties by smaller id.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part. Vectors meet those of
    their own length; an empty one scores zero. A repeated row is a row of its own and may be a positive of its copy; rows that share an id
    rank by score alone and then arbitrarily, but repeatably. An empty table gives no rows; other columns are not read.
    """
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform("v", lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("long"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).where(good)
    rows = scratch.keep(rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", F.size("v").alias("dim"), whole.alias("v")))
    asked = rows.where(F.col("id") % every == 0)
    blocks, groups = (-(-n // most) or 1 for n, most in ((rows.count(), CANDIDATES), (asked.count(), ANCHORS)))
    whole_range = F.array(F.struct(F.lit(0).cast("long").alias("window"), F.lit(-(1 << 62)).alias("low"), F.lit(1 << 62).alias("high")))
    best = first(rows, asked.withColumn("windows", whole_range), blocks, groups, True, positives)
    best = scratch.keep(best.select("anchor", F.col("row").alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    # a window's low end: 100 * negative >= least * positive
    low = F.ceil(F.col("positive_score") * least / F.lit(100).cast("decimal(3,0)")).cast("long")
    wins = best.groupBy("anchor").agg(F.collect_list(F.struct("window", low.alias("low"), F.col("positive_score").alias("high"))).alias("windows"))
    mined = first(rows, asked.join(wins, F.col("row") == F.col("anchor")), blocks, groups, False, negatives)
    names = asked.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    out = mined.select("anchor", "window", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = out.join(best, ["anchor", "window"]).join(names, "anchor")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


SQL = f"""
WITH e AS (SELECT row_number() OVER () AS k, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.k AS ak, a.id AS aid, b.k, b.id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON len(a.v) = len(b.v) AND a.k <> b.k WHERE a.id % {EVERY} = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY ak ORDER BY score DESC, id, k) <= {POSITIVES})
SELECT p.aid AS anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.ak, p.k ORDER BY s.score DESC, s.id, s.k) AS INTEGER) AS rank,
  s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.ak = p.ak AND NOT s.same AND {LEAST} * p.score <= 100 * s.score AND s.score <= p.score
QUALIFY row_number() OVER (PARTITION BY p.ak, p.k ORDER BY s.score DESC, s.id, s.k) <= {NEGATIVES}
"""
