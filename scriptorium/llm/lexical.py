"""Ranked lexical search: MaxScore over blocks of documents, its bounds tightened by precomputed term pairs."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.llm.common import Scratch

#: Documents returned for an item.
TOP = 20
#: Item terms searched in one pass over the documents (a longer item has a pass of its own), documents and postings of a block (a block
#: has one document more than these), and bytes of text read at a time (or one longer text).
ITEM_TERMS, DOCS, POSTINGS, SLICE = 200_000, 4096, 1_000_000, 8 << 20

#: ASCII letters, digits and all other characters make terms; A to Z are lower-cased, everything else is a gap.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)


def terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Terms of texts without nulls, end to end, and how many each text has."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = FOLD[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]]
    ends = ends - ends[0]
    keep = data != 32
    begin = keep.copy()
    begin[1:] &= ~keep[:-1]
    starts = ends[:-1][ends[:-1] < len(data)]
    begin[starts] = keep[starts]
    upto = np.concatenate([[0], np.cumsum(begin)])
    kept = np.ascontiguousarray(data[keep])
    offsets = np.append(np.flatnonzero(begin[keep]), len(kept)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(kept)), np.diff(upto[ends])


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``SLICE`` bytes or one longer text."""
    upto = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))])
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + SLICE, side="right")) - 1)
        yield at, to
        at = to


def counted(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    """``(doc_id, text)`` to ``(doc_id, n, terms, tfs)``: all terms counted, those of the vocabulary listed by their place in it."""
    known: pa.Array = vocabulary.value
    for b in batches:
        texts = b.column(1).fill_null("")
        for at, to in slices(texts):
            words, n = terms(texts.slice(at, to - at))
            place = pc.index_in(words, known)
            hit = np.flatnonzero(pc.is_valid(place).to_numpy(zero_copy_only=False))
            doc = np.repeat(np.arange(to - at), n)[hit]
            pair, tf = np.unique(doc * np.int64(len(known)) + place.drop_null().to_numpy(), return_counts=True)
            bounds = np.searchsorted(pair, np.arange(to - at + 1) * np.int64(len(known))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(x.astype(np.int32))) for x in (pair % max(1, len(known)), tf)]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(at, to - at), pa.array(n.astype(np.int64)), *lists], ["doc_id", "n", "terms", "tfs"])


def item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(item, item_id, text)`` to ``(item, item_id, term, q)``."""
    for b in batches:
        texts = b.column(2).fill_null("")
        for at, to in slices(texts):
            words, n = terms(texts.slice(at, to - at))
            row = pa.array(np.repeat(np.arange(at, to), n))
            t = pa.table({"row": row, "term": words}).group_by(["row", "term"]).aggregate([("term", "count")]).combine_chunks()
            if t.num_rows:
                rows = t["row"].combine_chunks()
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), t["term"].combine_chunks().cast(pa.string()),
                                                  t["term_count"].combine_chunks()], ["item", "item_id", "term", "q"])


@dataclass
class Query:
    """An item: its terms by rising weight, how often each occurs, and the places of the pairs of neighbours in that order."""

    item: int
    terms: np.ndarray
    q: np.ndarray
    pairs: np.ndarray


@dataclass
class Index:
    """A block of documents in order of id: postings of each term with impacts, and for each term pair of the items the size and
    joint maximum of its intersection list with the documents at the head of that list."""

    doc_ids: np.ndarray
    starts: np.ndarray
    docs: np.ndarray
    impacts: np.ndarray
    maxima: np.ndarray
    pair_n: np.ndarray
    pair_max: np.ndarray
    heads: np.ndarray

    KINDS = {"doc_ids": "i8", "starts": "i8", "docs": "i4", "impacts": "i8", "maxima": "i8", "pair_n": "i4", "pair_max": "i8", "heads": "i4"}

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, z = self.starts[term], self.starts[term + 1]
        return self.docs[a:z], self.impacts[a:z]


def build(doc_ids: np.ndarray, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, weights: np.ndarray, pairs: np.ndarray,
          documents: int, length: int, top: int) -> Index:
    """The index of a block; ``doc`` are places in ``doc_ids``, which ascend."""
    order = np.lexsort((doc, term))
    doc, term, tf = doc[order], term[order], tf[order].astype(np.int64)
    m = 75 + (25 * n * documents) // max(1, length)
    impacts = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
    starts = np.searchsorted(term, np.arange(len(weights) + 1))
    maxima = np.zeros(len(weights), np.int64)
    np.maximum.at(maxima, term, impacts)
    index = Index(doc_ids, starts, doc.astype(np.int32), impacts, maxima, np.zeros(len(pairs), np.int32), np.zeros(len(pairs), np.int64),
                  np.full((len(pairs), top), -1, np.int32))
    sizes = np.diff(starts)
    live = np.flatnonzero((sizes[pairs] > 0).all(axis=1)) if len(pairs) else np.zeros(0, int)
    longer = np.where(sizes[pairs[live, 0]] >= sizes[pairs[live, 1]], pairs[live, 0], pairs[live, 1])
    dense, last = np.full(len(doc_ids), -1, np.int64), -1
    for i in np.argsort(longer, kind="stable"):
        p, a = live[i], longer[i]
        b = pairs[p].sum() - a
        if a != last:
            if last >= 0:
                dense[index.postings(last)[0]] = -1
            docs, imp = index.postings(a)
            dense[docs], last = imp, a
        docs, imp = index.postings(b)
        other = dense[docs]
        both = np.flatnonzero(other >= 0)
        if len(both):
            joint = other[both] + imp[both]
            index.pair_n[p], index.pair_max[p] = len(both), joint.max()
            best = np.argpartition(-joint, top)[:top] if len(both) > top else np.arange(len(both))
            index.heads[p, :len(best)] = docs[both[best]]
    return index


def indexed(batches: Iterator[pa.RecordBatch], plan, documents: int, length: int, top: int) -> Iterator[pa.RecordBatch]:
    """Counted documents to blocks, one row each."""
    weights, pairs = plan.value[0], plan.value[1]

    def block(t: pa.Table) -> pa.RecordBatch:
        t = t.sort_by("doc_id").combine_chunks()
        lists = t["terms"].combine_chunks()
        size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        index = build(t["doc_id"].to_numpy(), t["n"].to_numpy(), np.repeat(np.arange(t.num_rows), size), lists.flatten().to_numpy(),
                      t["tfs"].combine_chunks().flatten().to_numpy(), weights, pairs, documents, length, top)
        return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(getattr(index, c), k).tobytes()], pa.binary()) for c, k in Index.KINDS.items()],
                                          list(Index.KINDS))

    held, rows, postings = [], 0, 0
    for b in batches:
        size = np.cumsum(pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            done = size[at - 1] if at else 0
            room = max(1, int(np.searchsorted(size[at:] - done, POSTINGS - postings, side="right")))
            to = min(b.num_rows, at + room, at + DOCS - rows)
            held.append(pa.Table.from_batches([b.slice(at, to - at)]))
            rows, postings, at = rows + to - at, postings + int(size[to - 1] - done), to
            if rows >= DOCS or postings >= POSTINGS or at < b.num_rows:
                yield block(pa.concat_tables(held))
                held, rows, postings = [], 0, 0
    if held:
        yield block(pa.concat_tables(held))


class Searcher:
    """The best documents of every item over the blocks that it has read."""

    def __init__(self, queries: list[Query], top: int):
        self.queries, self.top, self.best = queries, top, [[] for _ in queries]
        self.read, self.all = 0, 0

    def bounds(self, index: Index, query: Query) -> np.ndarray:
        """``bounds[i]``: no document scores more by the first ``i`` terms. Either the i-th term adds its maximum, or the last two
        together add the joint maximum of their pair, or the larger of their maxima where no document holds both."""
        single = (query.q * index.maxima[query.terms]).tolist()
        q, one = query.q.tolist(), index.maxima[query.terms].tolist()
        joint, size = index.pair_max[query.pairs].tolist(), index.pair_n[query.pairs].tolist()
        out = [0]
        for i, u in enumerate(single):
            best = out[-1] + u
            if i:
                both = 0
                if size[i - 1]:
                    common = min(q[i - 1], q[i])
                    both = common * joint[i - 1] + (q[i - 1] - common) * one[i - 1] + (q[i] - common) * one[i]
                best = min(best, out[-2] + max(both, u, single[i - 1]))
            out.append(best)
        return np.array(out, np.int64)

    def complete(self, index: Index, query: Query, docs: np.ndarray, score: np.ndarray, upto: int, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Add the first ``upto`` terms to the scores of documents, heaviest first, dropping those that can't reach ``least``."""
        for i in range(upto - 1, -1, -1):
            reach = score + bounds[i + 1] >= least
            if not reach.all():
                docs, score = docs[reach], score[reach]
            if not len(docs):
                break
            held, impacts = index.postings(query.terms[i])
            if len(held):
                at = np.minimum(np.searchsorted(held, docs), len(held) - 1)
                score = score + np.where(held[at] == docs, query.q[i] * impacts[at], 0)
        return docs, score

    def search(self, index: Index) -> None:
        total = np.zeros(len(index.doc_ids), np.int64)
        for query, best in zip(self.queries, self.best):
            bounds, k = self.bounds(index, query), len(query.terms)
            least = max(1, best[0][0]) if len(best) == self.top else 1
            if bounds[-1] < least:
                continue
            if len(best) < self.top:
                # the heads of the pair lists are likely to score high: whole scores of theirs raise the least score to begin with
                seeds = np.unique(index.heads[query.pairs])
                seeds = seeds[seeds >= 0]
                _, score = self.complete(index, query, seeds, np.zeros(len(seeds), np.int64), k, bounds, 0)
                have = sorted([s for s, _ in best] + score.tolist(), reverse=True)
                if len(have) >= self.top:
                    least = max(least, have[self.top - 1])
            essential = int(np.searchsorted(bounds, least)) - 1  # the last prefix of terms that cannot reach the least score alone
            essential = max(0, essential)
            seen = []
            for i in range(essential, k):
                docs, impacts = index.postings(query.terms[i])
                self.read += len(docs)
                total[docs] += query.q[i] * impacts
                seen.append(docs)
            self.all += int(sum(index.starts[t + 1] - index.starts[t] for t in query.terms))
            if not seen:
                continue
            hit = np.flatnonzero(total)
            score = total[hit]
            total[hit] = 0
            docs, score = self.complete(index, query, hit, score, essential, bounds, least)
            good = score >= least
            docs, score = docs[good], score[good]
            if len(docs) > self.top:
                kth = -np.partition(-score, self.top - 1)[self.top - 1]
                docs, score = docs[score >= kth], score[score >= kth]
            for s, d in zip(score.tolist(), index.doc_ids[docs].tolist()):
                heapq.heappush(best, (s, -d))
                if len(best) > self.top:
                    heapq.heappop(best)


def searched(batches: Iterator[pa.RecordBatch], plan, top: int) -> Iterator[pa.RecordBatch]:
    """Blocks to the best documents of every item among those of the task: ``(item, doc_id, score)``."""
    s = Searcher(plan.value[2], top)
    for b in batches:
        for row in range(b.num_rows):
            parts = {c: np.frombuffer(b.column(i)[row].as_buffer(), k) for i, (c, k) in enumerate(Index.KINDS.items())}
            parts["heads"] = parts["heads"].reshape(-1, top)
            s.search(Index(**parts))
    for query, best in zip(s.queries, s.best):
        if best:
            score, doc = zip(*best)
            yield pa.RecordBatch.from_arrays([pa.array([query.item] * len(best), pa.int64()), pa.array([-d for d in doc], pa.int64()), pa.array(score, pa.int64())],
                                             ["item", "doc_id", "score"])


def planned(items: list, vocabulary: list[str], df: dict[int, int], documents: int) -> tuple[np.ndarray, np.ndarray, list[Query]]:
    """Term weights, term pairs, and the items with their terms by rising weight times occurrences."""
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(vocabulary))], np.int64)
    place = {t: i for i, t in enumerate(vocabulary)}
    by: dict[int, list[tuple[int, int, int]]] = {}
    for r in items:
        t = place[r["term"]]
        if df.get(t):
            by.setdefault(r["item"], []).append((int(weights[t]) * r["q"], t, r["q"]))
    pairs: dict[tuple[int, int], int] = {}
    queries = []
    for item, found in sorted(by.items()):
        found.sort()
        ts = [t for _, t, _ in found]
        at = [pairs.setdefault((min(a, b), max(a, b)), len(pairs)) for a, b in zip(ts, ts[1:])]
        queries.append(Query(item, np.array(ts), np.array([q for _, _, q in found], np.int64), np.array(at, int)))
    return weights, np.array(list(pairs), int).reshape(-1, 2), queries


def ranked_search(docs: DataFrame, items: DataFrame, scratch: Scratch, top: int = TOP, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents for each item by integer score, ties by smaller id.

    Every whole document is counted; its terms that occur in items become postings, in blocks of bounded size. A block also holds
    the intersection list of each pair of terms that are neighbours in some item by weight: its joint maximum impact tightens
    the bounds by which MaxScore leaves out lists and documents. Each task keeps the best of each item over its blocks, and only those are
    ranked over all tasks, so nothing depends on how the documents are dealt. Items are searched in passes of about ``ITEM_TERMS`` terms,
    which are all that the driver and broadcasts hold.

    A null text has no terms; a null id takes no part as a result, though its text counts. Repeated rows of documents are documents of
    their own, repeated rows of items one item; items that share an id but not the text are ranked each for itself. Items
    without a term that occurs get no rows; empty tables give none; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).distinct()
    asked = scratch.keep(asked.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"))
    asked = scratch.keep(asked.mapInArrow(item_terms, "item long, item_id long, term string, q long"))
    passes = -(-asked.count() // ITEM_TERMS) or 1
    out = None
    for no in range(passes):
        some = asked.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == no)
        wanted = some.collect()
        vocabulary = sorted({r["term"] for r in wanted})
        words = spark.sparkContext.broadcast(pa.array(vocabulary, pa.large_string()))
        counts = scratch.keep(rows.mapInArrow(partial(counted, vocabulary=words), "doc_id long, n long, terms array<int>, tfs array<int>"))
        total = counts.where("n > 0").agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
        df = {r["t"]: r["n"] for r in counts.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}
        plan = spark.sparkContext.broadcast(planned(wanted, vocabulary, df, total["documents"]))
        made = counts.where(F.col("doc_id").isNotNull() & (F.size("terms") > 0))
        index = scratch.keep(made.mapInArrow(partial(indexed, plan=plan, documents=total["documents"], length=total["length"], top=top),
                                             ", ".join(f"{c} binary" for c in Index.KINDS)))
        found = index.mapInArrow(partial(searched, plan=plan, top=top), "item long, doc_id long, score long")
        order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        names = some.select("item", "item_id").distinct()
        found = found.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = found if out is None else out.union(found)
    return out


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
i AS (SELECT row_number() OVER () AS ik, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM (SELECT DISTINCT item_id, text FROM benchmark)),
q AS (SELECT ik, item_id, term, count(*) AS q FROM (SELECT ik, item_id, unnest(t) AS term FROM i) GROUP BY ALL),
c AS (SELECT count(*) AS docs, CAST(sum(len(t)) AS BIGINT) AS total FROM d WHERE len(t) > 0),
p AS (SELECT k, doc_id, n, term, count(*) AS tf FROM (SELECT k, doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term, docs),
s AS (SELECT ik, item_id, k, doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term), c WHERE doc_id IS NOT NULL GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY ik ORDER BY score DESC, doc_id, k) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY ik ORDER BY score DESC, doc_id, k) <= {TOP}
"""
