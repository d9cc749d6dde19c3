"""Vector and list top-k (G)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as tx
from scriptorium.session import broadcast_if_small, compute_partitions, fits, reuse

#: Most rows and bytes of a query block, least rows of a vector block.
Q_BLOCK, Q_BYTES, V_BLOCK = 32_768, 32 << 20, 4096
#: Queries that travel to the vectors; scores that a task holds at once, and the queries among them.
MAX_LOCAL_QUERIES, MAX_CELLS, Q_TILE = 20_000, 4_000_000, 1024


def _keep_top(ids: np.ndarray, raw: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best by score at 9 decimals, then by lower id; exact on ties at the edge."""
    s = np.round(raw, 9)
    if len(s) > k:
        at = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
    else:
        at = np.arange(len(s))
    return at[np.lexsort((ids[at], -s[at]))[:k]]


def _scan_stores(queries: list, batches):
    """Running top-k of every query over the vectors of one partition, in constant memory per query.

    A query with its k found keeps their least score as a floor; one comparison of the score matrix with the floors leaves
    the few scores that can still matter.
    """
    stores: dict[str, tuple] = {}
    for store in {q["__s"] for q in queries}:
        mine = [q for q in queries if q["__s"] == store]
        stores[store] = (mine, np.array([q["embedding"] for q in mine], dtype="float64"),
                         [(np.empty(0, "int64"), np.empty(0)) for _ in mine], np.full(len(mine), -np.inf))
    for pdf in batches:
        for store, part in pdf.groupby("__s"):
            if store not in stores:
                continue
            mine, matrix, best, floor = stores[store]
            ids, vectors = part["vec_id"].to_numpy("int64"), np.array(part["embedding"].tolist(), dtype="float64")
            width = max(1, MAX_CELLS // len(mine))
            for at in range(0, len(ids), width):
                scores = matrix @ vectors[at:at + width].T
                may = ~(scores < floor[:, None])
                for i in np.flatnonzero(may.any(axis=1)):
                    new, k = np.flatnonzero(may[i]), int(mine[i]["k"])
                    all_ids = np.concatenate([best[i][0], ids[at:at + width][new]])
                    all_raw = np.concatenate([best[i][1], scores[i][new]])
                    keep = _keep_top(all_ids, all_raw, k)
                    best[i] = (all_ids[keep], all_raw[keep])
                    if len(keep) == k > 0:
                        # scores compare at 9 decimals, so one that ties after rounding lies above this
                        floor[i] = all_raw[keep].min() - 2e-9
    for store, (mine, _, best, _) in stores.items():
        rows = [(store, q["query_id"], int(q["k"]), vs, rs) for q, (vs, rs) in zip(mine, best) if len(vs)]
        yield pd.DataFrame(rows, columns=["__s", "query_id", "k", "vec_id", "raw"])


def knn(queries: DataFrame, vectors: DataFrame, store: str | None = None) -> DataFrame:
    """G-01: exact top-k by inner product, which is L2 order for unit vectors.

    ``queries``: query_id, embedding, k [, store]. ``vectors``: vec_id, embedding [, store]. A query set within
    the size bound travels to the vectors, which are scanned where they lie and never shuffled; a larger one
    meets them in cells. Either way one row with the k best per query and task goes on to the final ranking. Ties
    go to the lower vec_id; scores compare at 9 decimals.
    """
    q = queries.select(F.col(store) if store else F.lit("all"), "query_id", "embedding", F.col("k").cast("long").alias("k")).toDF("__s", "query_id", "embedding", "k")
    v = vectors.select(F.col(store) if store else F.lit("all"), "vec_id", "embedding").toDF("__s", "vec_id", "embedding")
    qtype = dict(queries.dtypes)["query_id"]
    if fits(q, MAX_LOCAL_QUERIES):
        local = queries.sparkSession.sparkContext.broadcast([r.asDict() for r in q.collect()])
        tops = v.mapInPandas(lambda batches: _scan_stores(local.value, batches),
                             f"__s string, query_id {qtype}, k long, vec_id array<long>, raw array<double>")
    else:
        tops = _deal(q, v).mapInArrow(_scan_cells, f"__s string, query_id {qtype}, k long, vec_id array<long>, raw array<double>")
    # the lists are shuffled whole, and ranked where they arrive
    hits = tops.repartition("__s", "query_id").select("__s", "query_id", "k", F.explode(F.arrays_zip("vec_id", "raw")).alias("h")).select("__s", "query_id", "k", "h.*")
    w = Window.partitionBy("__s", "query_id").orderBy(F.desc(F.round("raw", 9)), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= F.col("k"))
    return ranked.select("query_id", *([F.col("__s").alias(store)] if store else []), "vec_id", "rank", F.round("raw", 6).alias("score"))


def _deal(q: DataFrame, v: DataFrame) -> DataFrame:
    """Rows of both sides dealt to cells ``(__s, qb, vb)`` in which every query of a store meets every vector of it once.

    A query block holds what one task may keep; the vectors of a cell are streamed past it, so their number is bound only from below. A store
    gets its share of the partitions by the pairs it compares, and of the grids with so many cells the one that sends the fewest bytes: queries and
    what is found for them travel once per block of vectors, vectors once per block of queries.
    """
    parts = compute_partitions(q.sparkSession)
    width = lambda df: F.size("embedding").cast("long") * (4 if df.schema["embedding"].dataType.elementType.typeName() == "float" else 8)
    nq = q.groupBy("__s").agg(F.count(F.lit(1)).alias("__qn"), F.sum(width(q) + 32).alias("__qb"), F.sum("k").alias("__k"),
                              F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / Q_BLOCK), F.ceil(F.sum(F.size("embedding").cast("long") * 8) / Q_BYTES)).alias("__least"))
    nv = v.groupBy("__s").agg(F.count(F.lit(1)).alias("__vn"), F.sum(width(v) + 32).alias("__vb"), F.ceil(F.count(F.lit(1)) / V_BLOCK).alias("__most"))
    sizes = reuse(nq.join(nv, "__s"))
    pairs = sizes.agg(F.sum(F.col("__qn").cast("double") * F.col("__vn"))).first()[0] or 1.0
    cells = F.ceil(F.lit(parts) * F.col("__qn") * F.col("__vn") / F.lit(pairs))

    def grid(n: Column) -> Column:
        queries = F.greatest("__least", F.least("__qn", F.ceil(cells / n)))
        sent = n * (F.col("__qb") + 16 * F.least("__k", F.col("__qn") * F.col("__vn"))) + queries * F.col("__vb")
        return F.struct(F.greatest(F.lit(0), cells - queries * n).alias("short"), sent.alias("sent"), queries.alias("__nq"), n.alias("__nv"))

    best = F.array_min(F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1), F.least("__most", cells))), grid))
    grids = broadcast_if_small(sizes.select("__s", best.alias("g")).select("__s", "g.__nq", "g.__nv"))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = q.join(grids, "__s").select("__s", own("query_id", "__nq").alias("qb"), every("__nv").alias("vb"), "__nv", F.lit(0).alias("side"), "embedding", "query_id", "k",
                                       F.lit(None).cast("long").alias("vec_id"))
    right = v.join(grids, "__s").select("__s", every("__nq").alias("qb"), own("vec_id", "__nv").alias("vb"), "__nv", F.lit(1).alias("side"), "embedding",
                                        F.lit(None).cast(q.schema["query_id"].dataType).alias("query_id"), F.lit(None).cast("long").alias("k"), F.col("vec_id").cast("long").alias("vec_id"))
    # the cells of a store lie in partitions that follow each other
    at = F.pmod(F.xxhash64("__s") + F.col("qb") * F.col("__nv") + F.col("vb"), F.lit(parts)).cast("int")
    return left.unionByName(right).repartitionById(parts, at).drop("__nv").sortWithinPartitions("__s", "qb", "vb", "side")


def _matrix(col: pa.Array) -> np.ndarray:
    flat = np.asarray(col.flatten(), dtype="float64")
    width = len(col[0]) if len(col) and col[0].is_valid else 0
    if col.null_count or len(flat) != len(col) * width:
        raise ValueError("embeddings must be given and of one length")
    return flat.reshape(len(col), width)


class _Tops:
    """Running top-k of the queries of a cell, a tile of queries against a run of vectors at a time.

    A query with its k found keeps their least score as a floor, so few scores of a later run are looked at.
    """

    def __init__(self, matrix: np.ndarray, k: np.ndarray):
        self.matrix, self.k = matrix, k
        self.floor = np.where(k > 0, -np.inf, np.inf)
        self.best = {lo: (np.empty(0, "int64"), np.empty(0, "int64"), np.empty(0)) for lo in range(0, len(k), Q_TILE)}

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        width = MAX_CELLS // Q_TILE
        for at in range(0, len(ids), width):
            some, run = ids[at:at + width], vectors[at:at + width].T
            for lo in self.best:
                self._merge(lo, some, self.matrix[lo:lo + Q_TILE] @ run)

    def _merge(self, lo: int, ids: np.ndarray, scores: np.ndarray) -> None:
        floor, ks, n = self.floor[lo:lo + Q_TILE], self.k[lo:lo + Q_TILE], scores.shape[1]
        first = np.isneginf(floor)
        for k in np.unique(ks[first & (ks <= n)]).tolist():
            of = np.flatnonzero(first & (ks == k))
            # scores compare at 9 decimals, so one that ties after rounding lies above this
            floor[of] = np.partition(scores[of], n - k, axis=1)[:, n - k] - 2e-9
        row, col = np.nonzero(~(scores < floor[:, None]))
        if not len(row):
            return
        at, vec, raw = (np.concatenate(x) for x in zip(self.best[lo], (row, ids[col], scores[row, col])))
        order = np.lexsort((vec, -np.round(raw, 9), at))
        at, vec, raw = at[order], vec[order], raw[order]
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        rank = np.arange(len(at)) - np.repeat(starts, np.diff(np.r_[starts, len(at)]))
        keep = rank < ks[at]
        at, vec, raw = at[keep], vec[keep], raw[keep]
        self.best[lo] = (at, vec, raw)
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        full = np.diff(np.r_[starts, len(at)]) == ks[at[starts]]
        floor[at[starts][full]] = np.minimum.reduceat(raw, starts)[full] - 2e-9

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query places, vector ids and scores of all that is kept."""
        at = np.concatenate([lo + a for lo, (a, _, _) in self.best.items()])
        return at, *(np.concatenate([b[i] for b in self.best.values()]) for i in (1, 2))


def _scan_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells in order, the queries of each before its vectors, to a row with the top-k of every query within its cell."""
    names = ["__s", "query_id", "k", "vec_id", "raw"]

    def found(store, held, tops):
        at, vec, raw = tops.rows()
        ids, k = pa.concat_arrays([x[0] for x in held]), np.concatenate([x[1] for x in held])
        edges = np.r_[np.flatnonzero(np.r_[True, at[1:] != at[:-1]]), len(at)] if len(at) else np.zeros(1, "int64")
        a = 0
        while a < len(edges) - 1:
            z = max(a + 1, int(np.searchsorted(edges, edges[a] + 50_000, side="right")) - 1)
            some, lo, hi, cuts = at[edges[a:z]], edges[a], edges[z], pa.array((edges[a:z + 1] - edges[a]).astype("int32"))
            yield pa.RecordBatch.from_arrays([pa.array([store] * len(some), pa.string()), ids.take(pa.array(some)), pa.array(k[some]),
                                              pa.ListArray.from_arrays(cuts, pa.array(vec[lo:hi])), pa.ListArray.from_arrays(cuts, pa.array(raw[lo:hi]))], names)
            a = z

    cell, held, tops = None, [], None
    for b in batches:
        store, qb, vb, side = b.column(0), *(b.column(i).to_numpy() for i in (1, 2, 3))
        new = (qb[1:] != qb[:-1]) | (vb[1:] != vb[:-1]) | (side[1:] != side[:-1])
        new |= pc.not_equal(store.slice(1), store.slice(0, max(0, len(store) - 1))).to_numpy(zero_copy_only=False).astype(bool)
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), b.num_rows]
        for x, y in zip(cuts, cuts[1:]):
            if x == y:
                continue
            here = (store[x].as_py(), int(qb[x]), int(vb[x]))
            if here != cell:
                if tops is not None:
                    yield from found(cell[0], held, tops)
                cell, held, tops = here, [], None
            part = b.slice(x, y - x)
            if side[x] == 0:
                held.append((part.column(5), part.column(6).to_numpy(), _matrix(part.column(4))))
            elif held:
                if tops is None:
                    tops = _Tops(np.concatenate([h[2] for h in held]), np.concatenate([h[1] for h in held]))
                    held = [h[:2] for h in held]
                tops.add(part.column(7).to_numpy(), _matrix(part.column(4)))
    if tops is not None:
        yield from found(cell[0], held, tops)


def retrieval_plan(k_main: int = 18, k_figs: int = 10, k_sup: int = 10, k_lit: int = 8, use_figs: bool = True,
                   use_sup: bool = False, use_lit: bool = False) -> list[tuple[int, str, str, int]]:
    """G-02: (pass, store, kind of query, k) in evidence order."""
    third, half = max(4, k_main // 3), max(4, k_main // 2)
    plan = [("main", "plan", third), ("main", "bullets", third), ("main", "combo", k_main), ("main", "intent", half)]
    if use_figs:
        plan.append(("figs", "combo", k_figs))
    if use_sup:
        plan.append(("sup", "intent", k_sup))
    if use_lit:
        plan += [("lit", "plan", max(3, k_lit // 2)), ("lit", "combo", k_lit)]
    return [(i, *p) for i, p in enumerate(plan)]


def retrieve_evidence(queries: DataFrame, vectors: DataFrame, dedupe: bool = True, **ks) -> DataFrame:
    """G-02: evidence of each slide over all passes, in pass order then rank.

    ``queries``: slide_uid, kind (plan, bullets, combo, intent), embedding. ``vectors``: store, vec_id, text, embedding.
    With ``dedupe`` a text is kept where it first occurs for the slide.
    """
    from scriptorium.operators.sets import dedupe_evidence

    spark = queries.sparkSession
    plan = spark.createDataFrame(retrieval_plan(**ks), "pass_no int, store string, kind string, k int")
    q = queries.join(F.broadcast(plan), "kind").withColumn("query_id", F.struct("slide_uid", "pass_no"))
    # Queries take the embedding type of the vectors' store; one block join serves every pass.
    hits = knn(q.select("query_id", "embedding", "k", "store"), vectors, "store").select("query_id.*", "store", "vec_id", "rank", "score")
    texts = vectors.select("store", "vec_id", "text")
    if fits(texts):
        # the hits of a slide meet once, and neither they nor the texts move again
        hits, texts = hits.repartition("slide_uid"), F.broadcast(texts)
    out = hits.join(texts, ["store", "vec_id"])
    out = out.select("slide_uid", "pass_no", "rank", F.upper(F.when(F.col("store") == "figs", "fig").otherwise(
        F.col("store"))).alias("source"), "vec_id", "text", "score")
    return dedupe_evidence(out, ["slide_uid"], ["pass_no", "rank"]) if dedupe else out


def top_papers(papers: DataFrame, n: int = 4, notion: str = "notion", year: str = "year", tie: Sequence[str] = ()) -> DataFrame:
    """G-05: the ``n`` newest papers of each notion; a year that is no number counts as 0."""
    y = F.coalesce(F.expr(f"try_cast({year} AS int)"), F.lit(0))
    w = Window.partitionBy(notion).orderBy(y.desc(), *tie)
    return papers.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def natural_key(c: Column | str) -> Column:
    """G-06: digits in a name padded, so that text order is natural order."""
    parts = F.regexp_extract_all(tx.col(c), F.lit("\\d+|\\D+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^\\d"), F.lpad(p, 20, "0")).otherwise(p)), "")


def natural_order(df: DataFrame, key: str) -> DataFrame:
    """G-06: a total, range-partitioned sort by natural key; for sinks, not between operators."""
    return df.orderBy(natural_key(key))


def snippet(df: DataFrame, n: int, side: str = "head", column: str = "text", out: str = "snippet") -> DataFrame:
    """G-07: first or last ``n`` characters."""
    return df.withColumn(out, F.left(column, F.lit(n)) if side == "head" else F.right(column, F.lit(n)))
