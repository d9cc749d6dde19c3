"""Toxicity by a learned lexicon, a Levenshtein automaton over its trie, and scores of the context of each hit."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.llm.common import Scratch, crc_bucket

#: Bound of the training sample: labelled rows of each class, taken by a hash of the id.
SAMPLE = 8000
#: Lexicon: at most so many terms, so many times likelier in toxic rows, and with this evidence: the chance that a term of no
#: meaning looks like it is at most exp(-15), as very many terms are tried.
TERMS, LIFT, EVIDENCE = 2000, 8.0, 15.0
#: Learned stems have this length; a longer word that starts with one is a hit.
STEM = (4, 8)
#: Words on either side of a hit that make its context, and words a worker remembers.
CONTEXT, MEMORY = 6, 400_000

WORD = re.compile(r"[^\W_]+(?:['’@$*!0-9][^\W_]+)*")
TOKEN = re.compile(r"[\"“”„«»]|" + WORD.pattern)
QUOTES = set("\"“”„«»")
#: Words that report speech, in the languages of the corpus.
REPORTING = frozenset("said says quote quoted wrote reported called alleged sagte sagt zitat schrieb dijo dice cita escribió dit cite écrit".split())


def train_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled rows to learn from: ``(doc_id, toxic, text)`` where crc32 of the id modulo 5 is not 0, at most ``SAMPLE`` a class."""
    lab = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    lab = lab.where(crc_bucket("doc_id", 5) != 0)
    # in slices, so that no window holds a class and each keeps its share; the bound is SAMPLE + 64 a class
    slice_ = F.pmod(F.xxhash64("doc_id"), F.lit(64))
    own = Window.partitionBy("toxic", slice_).orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id")
    lab = lab.withColumn("__k", F.row_number().over(own)).where(F.col("__k") <= -(-SAMPLE // 64)).drop("__k")
    texts = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    # at most 2 (SAMPLE + 64) pairs of numbers, so they travel to the texts and no text is shuffled
    return texts.join(F.broadcast(lab), "doc_id")


def terms(text: str) -> set[str]:
    """Words as ``=word`` and their stems as they are."""
    found: set[str] = set()
    for w in set(WORD.findall((text or "").lower())):
        found.add("=" + w)
        found.update(w[:k] for k in range(STEM[0], min(STEM[1], len(w) - 1) + 1))
    return found


def term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(toxic, text)`` to ``(term, pos, neg)``, rows of the partition with the term by class."""
    count = (Counter(), Counter())
    for b in batches:
        for y, t in zip(b.column(0).to_pylist(), b.column(1)):
            count[1 if y else 0].update(terms(t.as_py()))
    # a term never seen in a toxic row of the partition only matters if another partition has it
    names = list(count[1].keys() | count[0].keys())
    for at in range(0, len(names), 50_000):
        some = names[at:at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([count[1][w] for w in some], pa.int64()),
                                          pa.array([count[0][w] for w in some], pa.int64())], ["term", "pos", "neg"])


def prune(rows: Iterable[tuple[str, int, int]]) -> list[str]:
    """Drop a stem that one longer stem explains, then all terms that a shorter stem covers."""
    seen = {t: (p, n) for t, p, n in rows}
    drop = {s for t in seen if t[0] != "=" for s in (t[:-1],) if s in seen and seen[t][0] >= 0.95 * seen[s][0]}
    left = [t for t in seen if t not in drop]
    stems = {t for t in left if t[0] != "="}
    covered = lambda t: any(t.lstrip("=")[:k] in stems for k in range(STEM[0], len(t.lstrip("=")) + (t[0] == "=")))
    return sorted(t for t in left if not covered(t))


class Matcher:
    """The lexicon's trie walked together with Levenshtein automata of the words of a text.

    A state is the set of trie nodes that can be reached with the fewest edits; states and their transitions
    are made when a word first needs them, so a word costs one look-up a character and most die early. Terms of five
    to eight letters allow one edit, longer ones two.
    """

    def __init__(self, lexicon: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.word, self.stem, self.allow = [0], [0], [0]
        for t in lexicon:
            whole, s, at, path = t[0] == "=", t.lstrip("="), 0, [0]
            edits = 0 if len(s) < 5 else 1 if len(s) < 9 else 2
            for c in s:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.word.append(0)
                    self.stem.append(0)
                    self.allow.append(0)
                at = self.next[at][c]
                path.append(at)
            (self.word if whole else self.stem)[at] = edits + 1
            for node in path:
                self.allow[node] = max(self.allow[node], edits)
        self.states: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.hits: list[tuple[int, int]] = []
        self.steps: list[dict[str, int]] = []
        self.start = self.state({0: 0})
        self.known: dict[str, int] = {}

    def state(self, nodes: dict[int, int]) -> int:
        """Number of the state after leaving letters of terms out; -1 if it is empty."""
        todo = list(nodes.items())
        while todo:
            node, e = todo.pop()
            for child in self.next[node].values():
                if e + 1 <= self.allow[child] and e + 1 < nodes.get(child, 99):
                    nodes[child] = e + 1
                    todo.append((child, e + 1))
        if not nodes:
            return -1
        key = tuple(sorted(nodes.items()))
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            best = lambda ends: min((e for n, e in key if ends[n] and e < ends[n]), default=9)
            self.hits.append((best(self.word), best(self.stem)))
            self.steps.append({})
        return self.states[key]

    def step(self, state: int, c: str) -> int:
        nodes: dict[int, int] = {}

        def put(n: int, e: int) -> None:
            if e <= self.allow[n] and e < nodes.get(n, 99):
                nodes[n] = e

        for n, e in self.sets[state]:
            put(n, e + 1)
            for d, child in self.next[n].items():
                put(child, e + (d != c))
        new = self.steps[state][c] = self.state(nodes)
        return new

    def kind(self, word: str) -> int:
        """0: no hit; 1: a term, 2: starts with a stem, 3: a misspelled term, 4: starts with a misspelled stem."""
        known = self.known.get(word)
        if known is not None:
            return known
        at, stem, steps = self.start, 9, self.steps
        for c in word:
            new = steps[at].get(c)
            at = self.step(at, c) if new is None else new
            if at < 0:
                break
            if self.hits[at][1] < stem:
                stem = self.hits[at][1]
        whole = self.hits[at][0] if at >= 0 else 9
        kind = 1 if whole == 0 else 2 if stem == 0 else 3 if whole < 9 else 4 if stem < 9 else 0
        if len(self.known) >= MEMORY:
            self.known.clear()
        if len(word) <= 64:
            self.known[word] = kind
        return kind


#: By kind of hit: hits, hits outside quotation without a reporting word near, hits with another hit near; and the share of hits.
N_FEATURES = 4 * 4


def features(text: str | None, m: Matcher) -> np.ndarray:
    """Logarithmic counts of hits of each kind, all, and those whose context speaks for abuse."""
    out = np.zeros(N_FEATURES)
    low = (text or "").lower()
    words = WORD.findall(low)
    kind = m.kind
    known = m.known
    if not any([known[w] if w in known else kind(w) for w in set(words)]):
        return out
    tokens = TOKEN.findall(low)
    kinds, quoted, inside = [], [], False
    plain: list[str] = []
    for t in tokens:
        if t in QUOTES:
            inside = t in "“„«" or (t == '"' and not inside)
        else:
            kinds.append(kind(t))
            quoted.append(inside)
            plain.append(t)
    where = [i for i, k in enumerate(kinds) if k]
    for j, i in enumerate(where):
        k = kinds[i] - 1
        near = plain[max(0, i - CONTEXT):i + CONTEXT + 1]
        reported = quoted[i] or any(w in REPORTING for w in near)
        another = (j > 0 and i - where[j - 1] <= CONTEXT) or (j + 1 < len(where) and where[j + 1] - i <= CONTEXT)
        out[k] += 1
        out[4 + k] += not reported
        out[8 + k] += another
    out[12:] = out[:4] * 100 / max(len(plain), 1)
    return np.log1p(out)


def featured(batches: Iterator[pa.RecordBatch], lexicon) -> Iterator[pa.RecordBatch]:
    m = Matcher(lexicon.value)
    for b in batches:
        x = [features(t.as_py(), m).tolist() for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], ["y", "x"])


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic weights by Newton steps; the last is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        penalty = np.full(len(w), ridge)
        penalty[-1] = 1e-6
        grad = x.T @ (p - y) + penalty * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    """Lexicon and weights; both are bounded by parameters."""

    def __init__(self, lexicon: list[str], weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights

    def scores(self, texts: Iterable[str | None], m: Matcher) -> np.ndarray:
        x = np.array([features(t, m) for t in texts]).reshape(-1, N_FEATURES)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def sketched(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """``(y, text)`` with the least of several hashes of the three-word shingles."""
    factor = np.random.default_rng(4).integers(1, 1 << 62, keys, np.uint64) * np.uint64(2) + np.uint64(1)
    for b in batches:
        out = []
        for t in b.column(1):
            ws = t.as_py().lower().split()
            h = np.array([xxhash.xxh3_64_intdigest(" ".join(ws[i:i + 3])) for i in range(max(1, len(ws) - 2))], np.uint64)
            with np.errstate(over="ignore"):
                out.append([(h * f).min() for f in factor])
        cols = np.array(out, np.uint64).reshape(-1, keys).view(np.int64)
        yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c) for c in cols.T)], ["y", "text", *(f"k{k}" for k in range(keys))])


def independent(rows: DataFrame, keys: int = 4) -> DataFrame:
    """Rows of the sample without near copies of others: copies would pass one chance word off as evidence.

    A row goes if an earlier one, in the order of the texts' hashes, shares one of ``keys`` least hashes of its three-word shingles.
    """
    names = [f"k{k}" for k in range(keys)]
    rows = rows.mapInArrow(partial(sketched, keys=keys), "y double, text string, " + ", ".join(f"{n} long" for n in names))
    rows = rows.groupBy(F.xxhash64("text").alias("h")).agg(F.max("y").alias("y"), F.first(F.struct("text", *names)).alias("r"))
    seen = rows.select("h", F.posexplode(F.array(*[f"r.{n}" for n in names])).alias("i", "k"))
    first = seen.groupBy("i", "k").agg(F.min("h").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(first.where(F.col("n") == keys), "h", "left_semi").select("y", "r.text")


def choose(rows: DataFrame) -> list[str]:
    """The lexicon of ``(y, text)`` rows: terms that are far likelier in toxic rows."""
    total = rows.agg(F.sum((F.col("y") > 0).cast("int")), F.count(F.lit(1))).first()
    pos = total[0] or 0
    neg = total[1] - pos
    counts = rows.select((F.col("y") > 0).cast("int").alias("y"), "text").mapInArrow(term_counts, "term string, pos long, neg long")
    counts = counts.groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    lift = ((F.col("pos") + 0.5) / (pos + 1)) / ((F.col("neg") + 0.5) / (neg + 1))
    n, share = F.col("pos") + F.col("neg"), max(pos, 1) / max(total[1], 1)
    part = lambda k, q: F.when(k > 0, k * F.log(k / (n * F.lit(max(q, 1e-9))))).otherwise(0.0)
    evidence = part(F.col("pos"), share) + part(F.col("neg"), 1 - share)
    counts = counts.where((lift >= LIFT) & (evidence >= EVIDENCE))
    return prune([tuple(r) for r in counts.orderBy(F.desc("pos"), "term").limit(TERMS).collect()])


def train(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> Model:
    """Learn the lexicon and the context weights from the training rows.

    Without training rows the lexicon is empty and every score 0; with one class only, the score is its share.
    """
    spark = docs.sparkSession
    rows = train_rows(docs, labels).where("text is not null").select(F.col("toxic").cast("double").alias("y"), "text")
    rows = scratch.keep(rows.repartition(spark.sparkContext.defaultParallelism * 2))
    rows = scratch.keep(independent(rows).repartition(spark.sparkContext.defaultParallelism * 2))
    sizes = {r["y"]: r["n"] for r in rows.groupBy((F.col("y") > 0).alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = sizes.get(True, 0), sizes.get(False, 0)
    if not pos + neg:
        return Model([], np.append(np.zeros(N_FEATURES), -30.0))
    # weights are fitted on rows that the lexicon was not chosen from, or its terms would seem surer than they are
    fold = F.pmod(F.xxhash64("text"), F.lit(2))
    half = spark.sparkContext.broadcast(choose(rows.where(fold == 0)))
    seen = rows.where(fold == 1).select("y", "text").mapInArrow(partial(featured, lexicon=half), "y double, x array<double>").toPandas()
    lexicon = choose(rows)
    y = (seen["y"].to_numpy() > 0).astype(float)
    if not 0 < y.sum() < len(y):
        return Model(lexicon, np.append(np.zeros(N_FEATURES), 30.0 if y.all() else -30.0))
    return Model(lexicon, fit(np.array(seen["x"].tolist()), y))


def scored(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    m = Matcher(model.value.lexicon)
    for b in batches:
        s = model.value.scores((t.as_py() for t in b.column(1)), m)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], ["doc_id", "score"])


def toxicity(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    A null or empty text has no hits and gets the score of a text without hits. Repeated rows and null ids are scored
    like others; of labels that disagree on an id, toxic wins; null labels teach nothing. An empty table
    gives no rows; other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, scratch))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(partial(scored, model=model), "doc_id long, score double")
    return out.select("doc_id", (crc_bucket("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """The documents with a score below 0.5, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, scratch))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = Matcher(model.value.lexicon)
        for s in batches:
            yield pd.Series(model.value.scores((t if isinstance(t, str) else None for t in s), m))

    return docs.where(score(F.col("text").cast("string")) < 0.5)
