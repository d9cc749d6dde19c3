"""Packing, hard negatives and ranked search against brute force, with odd inputs and small blocks."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scriptorium.llm import lexical, negatives, packing
from scriptorium.llm.common import Scratch

CLASH = ["row", "rank", "part", "b", "g", "id", "dim", "n", "item", "term", "score", "length", "offset", "own", "base", "anchor", "__n"]
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture
def scratch(spark):
    return Scratch(spark)


def clashing(df):
    for c in CLASH:
        if c not in df.columns:
            df = df.withColumn(c, F.lit("x"))
    return df


def texts(spark, rows, names="doc_id long, text string"):
    return clashing(spark.createDataFrame(rows, names))


ODD = [None, "", " \n\t", "a", "Hello, World. don't IT'S. é. É, ẞ. ΣΣ. 漢字 🙂", "H̱, Å K. \x1c\x1da\x1fb\x00c  ..  .,. x.. 12.5, a.b, c", "word, " * 5000,
       "x" * 20_000, "<|endoftext|> <|EndOfText|>. a<|startoftext|>.", "tail ."]


def library(vocabulary):
    tok = Tokenizer.from_file(vocabulary)
    return lambda t: tok.encode(t, add_special_tokens=False).ids


def packed_well(rows, pieces, encode, size, end=1):
    """Every id once, checksums right, sequences gapless; returns the number of sequences and the share of padding."""
    left = Counter()
    for doc_id, text in rows:
        ids = encode(text or "") + [end]
        left[(doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()) if len(ids) <= size else 0)] += 1
    by, seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by[p["doc_id"]].append(p)
        seq[p["sequence_id"]].append((p["offset"], p["length"]))
    want = defaultdict(Counter)
    for doc_id, text in rows:
        ids = encode(text or "") + [end]
        want[doc_id][len(ids), tuple(ids)] += 1
    for doc_id, found in by.items():
        spans = Counter((p["doc_tokens"], p["start"], p["length"], p["ids_crc32"]) for p in found)
        starts = {(p["doc_tokens"], p["start"], p["length"]) for p in found}
        for (n, ids), times in want[doc_id].items():
            mine = sorted((a, k) for m, a, k in starts if m == n)
            assert sum(k for _, k in mine) >= n
            for a, k in mine:
                spans[n, a, k, zlib.crc32(np.array(ids[a:a + k], "<u4").tobytes())] -= times
        if len(want[doc_id]) == 1:
            assert not +spans and not -spans, doc_id
        assert sum(p["length"] for p in found) == sum(n * t for (n, _), t in want[doc_id].items())
    assert set(by) == {i for i, _ in rows}
    assert sorted(seq) == list(range(len(seq)))
    pad = total = 0
    for parts in seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= size
        total, pad = total + at, pad + (size - at if at & (at - 1) else 0)
    return len(seq), pad / max(1, total + pad)


def test_packing_equals_the_library(spark, scratch):
    encode = library(VOCABULARY)
    rng = random.Random(1)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "null id"), (3, "a"), (3, "a")]
    rows += [(100 + i, " ".join(rng.choice(["The", "of.", "naïve,", "Straße", "it's", "x1"]) for _ in range(rng.randint(0, 300)))) for i in range(60)]
    for size in (2048, 64):
        got = packing.pack(texts(spark, rows), VOCABULARY, scratch, size=size)
        packed_well(rows, got.pieces.collect(), encode, size)
        full = packing.sequences(got, size).collect()
        ids = {r["sequence_id"]: r["ids"] for r in full}
        assert all(len(x) == size or not len(x) & (len(x) - 1) for x in ids.values())
        for p in got.pieces.collect():
            some = ids[p["sequence_id"]][p["offset"]:p["offset"] + p["length"]]
            assert zlib.crc32(np.array(some, "<u4").tobytes()) == p["ids_crc32"]


def test_packing_with_another_tokenizer_reads_whole_texts(spark, scratch):
    voc = public_tokenizers.path("byte_bpe_50k.json")
    encode = library(voc)
    rows = [(i, t) for i, t in enumerate(ODD) if t != "x" * 20_000]
    packed_well(rows, packing.pack(texts(spark, rows), voc, scratch, size=256, end=50256).pieces.collect(), encode, 256, 50256)


def test_packing_one_length_for_a_third_of_all_rows(spark, scratch, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 50)
    rows = [(i, "same words here") for i in range(400)] + [(400 + i, "w " * (i % 90)) for i in range(800)]
    encode = library(VOCABULARY)
    n, padding = packed_well(rows, packing.pack(texts(spark, rows), VOCABULARY, scratch, size=128).pieces.collect(), encode, 128)
    assert padding < 0.02


def test_packing_cuts_where_nothing_fits(spark, scratch):
    rows = [(i, "the " * 1100) for i in range(101)]
    encode = library(VOCABULARY)
    got = packing.pack(texts(spark, rows), VOCABULARY, scratch)
    n, padding = packed_well(rows, got.pieces.collect(), encode, 2048)
    assert padding < 0.03 and n <= 56
    assert packing.sequences(got).count() == n


def test_packing_plan_places_every_rank_once():
    rng = random.Random(2)
    for _ in range(60):
        size = rng.choice([16, 64, 2048])
        hist = {rng.randint(1, size): rng.randint(1, 50) for _ in range(rng.randint(0, 40))}
        if rng.random() < 0.3:
            hist = {rng.randint(size // 2 + 1, size): 1000}
        p = packing.plan(hist, size, cut=max(1, size // 32))
        rows = [(k, r) for k, n in hist.items() for r in range(n)]
        batch = pa.RecordBatch.from_pydict({"row": list(range(len(rows))), "doc_id": [0] * len(rows), "start": pa.array([0] * len(rows), pa.int64()),
                                            "length": pa.array([k for k, _ in rows], pa.int64()), "ids_crc32": [0] * len(rows),
                                            "doc_tokens": [k for k, _ in rows], "rank": pa.array([r for _, r in rows], pa.int64())})

        class Held:
            value = p

        out = [r for b in packing.place([batch], Held) for r in b.to_pylist()] if rows else []
        fill, whole = defaultdict(list), Counter()
        for r in out:
            fill[r["sequence_id"]].append((r["offset"], r["length"]))
            whole[r["row"]] += r["length"]
        assert all(whole[i] == k for i, (k, _) in enumerate(rows))
        for parts in fill.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= size
        assert sorted(fill) == list(range(len(fill)))


def test_packing_empty_table(spark, scratch):
    got = packing.pack(texts(spark, []), VOCABULARY, scratch)
    assert got.pieces.count() == 0 and packing.sequences(got).count() == 0


# hard negatives

def mined(rows, every=100, k=5, most=5, least=80):
    good = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows
            if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, label, v) in enumerate(good):
        if i % every:
            continue
        score = [(-sum(x * y for x, y in zip(v, w)), j, n, lab) for n, (j, lab, w) in enumerate(good) if n != a and len(w) == len(v)]
        for s, j, n, _ in sorted(x for x in score if x[3] == label)[:k]:
            hard = sorted(x for x in score if x[3] != label and least * -s <= 100 * -x[0] <= 100 * -s)[:most]
            out += [(i, j, rank + 1, h[1], -s, -h[0]) for rank, h in enumerate(hard)]
    return sorted(out)


NAMES = "vec_id long, embedding array<float>, label int"
OUT = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("candidates", [7, 60, 16_384])
def test_hard_negatives_against_brute_force(spark, scratch, monkeypatch, candidates):
    monkeypatch.setattr(negatives, "CANDIDATES", candidates)
    monkeypatch.setattr(negatives, "ANCHORS", 3 if candidates < 100 else 4096)
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((4, 12))
    rows = []
    for i in range(300):
        v = centre[i % 4] + 0.8 * rng.standard_normal(12)
        rows.append((i * 5, [float(np.float32(x)) for x in np.round(v / np.linalg.norm(v), 1 if i % 3 else 5)], int(rng.integers(0, 5))))
    rows += [(5000 + i, rows[7][1], i % 3) for i in range(120)]  # ties: one vector very often
    rows += [(None, rows[0][1], 1), (100, None, 1), (200, rows[1][1], None), (300, [None] * 12, 1), (400, [float("nan")] * 12, 1),
             (500, [float("inf")] + [0.0] * 11, 1), (600, [0.0] * 12, 1), (700, [1.0, 0.0], 1), (701, [0.5, 0.5], 2), (702, [0.9, 0.1], 1), (800, [], 1), (803, [], 1), (805, [], 2),
             (-100, rows[2][1], 2), (1100, [300.0] * 12, 1), (1101, [300.0] * 12, 2), (1103, [301.0] * 12, 1)]
    got = negatives.hard_negatives(clashing(spark.createDataFrame(rows, NAMES)), scratch)
    assert sorted(tuple(r[c] for c in OUT) for r in got.collect()) == mined(rows)


def test_hard_negatives_repeated_rows_and_empty_table(spark, scratch):
    rows = [(i, [1.0, i / 10], i % 2) for i in range(0, 12)] * 2 + [(100, [1.0, 0.5], 0)] * 2
    got = negatives.hard_negatives(spark.createDataFrame(rows, NAMES), scratch)
    assert sorted(tuple(r[c] for c in OUT) for r in got.collect()) == mined(rows)
    assert negatives.hard_negatives(spark.createDataFrame([], NAMES), scratch).count() == 0


def test_threshold_stops_before_the_end_of_the_lists():
    rng = np.random.default_rng(4)
    v = rng.integers(-20, 20, (5000, 4))
    v[:10] = [200, 200, 200, 200]
    lists = negatives.Lists(v)
    (at, score), = lists.search(np.array([3, 2, 5, 1]), np.ones(5000, bool), np.array([-(1 << 62)]), np.array([1 << 62]), 5)
    assert at.tolist() == [0, 1, 2, 3, 4] and score.tolist() == [2200] * 5
    assert lists.scored < 1000


# ranked search

def ranked(docs, items, top=20):
    found = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counts = [(i, Counter(found(t))) for i, t in docs]
    total, documents = sum(sum(c.values()) for _, c in counts), sum(1 for _, c in counts if c)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in sorted(set(items), key=str):
        scores = []
        for i, c in counts:
            if i is None:
                continue
            n = sum(c.values())
            s = sum(math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * (75 + (25 * n * documents) // total)))
                    for t in found(text) if c[t])
            if s > 0:
                scores.append((-s, i))
        out += [(item, rank + 1, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize("block, item_terms", [(4096, 200_000), (5, 200_000), (37, 12)])
def test_ranked_search_against_brute_force(spark, scratch, monkeypatch, block, item_terms):
    monkeypatch.setattr(lexical, "DOCS", block)
    monkeypatch.setattr(lexical, "ITEM_TERMS", item_terms)
    monkeypatch.setattr(lexical, "POSTINGS", 10 * block)
    rng = random.Random(5)
    voc = [f"w{i}" for i in range(60)] + ["Ärger", "ärger", "naïve", "漢字", "x_y", "a b"]
    weights = [1 / (i + 1) for i in range(len(voc))]
    docs = [(i, " ".join(rng.choices(voc, weights, k=rng.randint(0, 40)))) for i in range(300)]
    docs += [(1000 + i, "W1 w2. w3-w4") for i in range(60)] + [(None, "w1 w2"), (2000, None), (2001, ""), (2002, " \n.,;"), (5, "w1 w1"), (5, "w1 w1"),
                                                               (2003, "w1 " * 20_000), (2004, "w7\x00w8\x1fw9")]
    items = [(i, " ".join(rng.choices(voc, weights, k=rng.randint(1, 25)))) for i in range(12)]
    items += [(20, "w1 w2 w3 w4"), (21, None), (22, "none-such"), (23, ".."), (20, "w1 w2 w3 w4"), (20, "w59 w58"), (None, "w3")]
    got = lexical.ranked_search(texts(spark, docs), texts(spark, items, "item_id long, text string"), scratch)
    assert sorted((tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()), key=str) == ranked(docs, items)


def test_ranked_search_empty_tables(spark, scratch):
    none, one = texts(spark, []), texts(spark, [(1, "a b")])
    for docs, items in ((none, one), (one, none), (none, none), (texts(spark, [(1, None)]), one)):
        assert lexical.ranked_search(docs, items.withColumnRenamed("doc_id", "item_id"), scratch).count() == 0


def test_pair_bounds_are_tighter_and_never_too_low():
    rng = np.random.default_rng(6)
    n, terms = 400, 12
    held = rng.random((n, terms)) < np.linspace(0.02, 0.6, terms)
    doc, term = np.nonzero(held)
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * held[:, t].sum() + 1))) for t in range(terms)])
    pairs = np.array([(a, b) for a in range(terms) for b in range(a + 1, terms)])
    where = {tuple(p): i for i, p in enumerate(pairs.tolist())}
    index = lexical.build(np.arange(n), rng.integers(5, 50, n), doc, term, rng.integers(1, 4, len(doc)), weights, pairs, n, 27 * n, 20)
    tighter = 0
    for _ in range(50):
        ts = rng.permutation(terms)[:6]
        q = rng.integers(1, 4, 6)
        query = lexical.Query(0, ts, q, np.array([where[min(a, b), max(a, b)] for a, b in zip(ts, ts[1:])]))
        bounds = lexical.Searcher([query], 20).bounds(index, query)
        dense = np.zeros((6, n), np.int64)
        for i, t in enumerate(ts):
            d, imp = index.postings(t)
            dense[i, d] = q[i] * imp
        real = np.concatenate([[0], dense.cumsum(axis=0).max(axis=1)])
        alone = np.concatenate([[0], np.cumsum(q * index.maxima[ts])])
        assert (real <= bounds).all() and (bounds <= alone).all()
        tighter += bounds[-1] < alone[-1]
    assert tighter > 25
