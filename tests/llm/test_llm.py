"""Operators against brute force, and odd inputs: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from scriptorium.llm import (bpe, embed_dedup, exact_dedup, language, line_dedup, minhash, mixing, sharding, simhash, substring,
                             toxicity)
from scriptorium.llm.common import Scratch, components, deal

DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, as extra columns of the input.
CLASH = ["h", "g", "key", "row", "rank", "slot", "shard", "part", "pi", "fp", "gone", "start", "score", "th", "k", "n", "id", "__n"]


@pytest.fixture
def scratch(spark):
    return Scratch(spark)


def frame(spark, rows, clash=True):
    df = spark.createDataFrame([(i, t, lang, src, None if t is None else len(t)) for i, t, lang, src in rows], DOC)
    for c in CLASH if clash else []:
        df = df.withColumn(c, F.lit("x"))
    return df


def odd_rows():
    long = " ".join(f"word{i % 977} of{i % 31}" for i in range(30_000))
    return [(1, None, None, None), (2, "", "en", ""), (3, "a", "en", "s"), (4, long, "en", "s"), (4, long, "en", "s"), (5, "a", "fr", None),
            (None, "a", "en", "s"), (None, None, None, None), (6, "  \n\t ", "en", "s"), (7, "\n\n\n", "en", "t"), (8, "漢字 é 🙂", "zh", "t")]


def words(rng, n, alphabet="abcdefgh"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 7))) for _ in range(n))


def union_find(pairs, nodes):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


def test_components_and_dealt_buckets(spark, scratch):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 300)] + [(rng.randint(500, 700), rng.randint(500, 700)) for _ in range(90)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long"), scratch).collect())
    want = union_find([e for e in edges if e[0] != e[1]], {n for e in edges for n in e if e[0] != e[1]})
    assert got == want
    rows = spark.createDataFrame([(0 if i % 3 else 1, i) for i in range(300)], "key int, id long")
    met = Counter()
    blocks = defaultdict(list)
    for r in deal(rows, ["key"], "id", 40, scratch).collect():
        blocks[r["key"], r["pi"], r["pj"]].append((r["id"], r["part"]))
    for (_, i, j), members in blocks.items():
        met.update(frozenset((a, b)) for (a, x), (b, y) in combinations(members, 2) if i == j or x != y)
    assert set(met.values()) == {1} and len(met) == 200 * 199 // 2 + 100 * 99 // 2


def test_exact_dedup(spark, scratch):
    rng = random.Random(2)
    rows = odd_rows() + [(100 + i, rng.choice(["Same", "sAME", "É", "é", words(rng, 3)]), "en", "s") for i in range(300)]
    out = exact_dedup.exact_dedup(frame(spark, rows), scratch, capacity=8).collect()
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[low(t)].append(i)
    want = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want.update((i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in out) == want
    assert len({(r["bucket"], r["depth"]) for r in out}) > 8
    assert exact_dedup.exact_dedup(frame(spark, []), scratch).count() == 0


def test_exact_dedup_answers_through_the_index(spark, scratch):
    """Texts of one hash share a chain; without its bucket a row has no answer."""
    h = [0, 0, 0, 1 << 62, -1, -(1 << 62)]
    entries = spark.createDataFrame([(x, bytes([i]) * 32, i, 1) for i, x in enumerate(h)], "h long, sha binary, keep_id long, group_size long")
    slots = scratch.keep(exact_dedup.directory(entries, 2, 3, scratch))
    buckets = scratch.keep(exact_dedup.index(entries, slots, 3))
    assert sorted(len(r["chain"]) for r in buckets.collect()) == [1, 1, 1, 3]
    rows = entries.select(F.col("keep_id").alias("doc_id"), "h", "sha")
    out = exact_dedup.lookup(rows, slots, buckets, 3).collect()
    assert all(r["keep_id"] == r["doc_id"] and r["kept"] for r in out) and len(out) == 6
    gone = next(r["bucket"] for r in out if r["doc_id"] == 0)
    left = exact_dedup.lookup(rows, slots, buckets.where(F.col("bucket") != gone), 3).collect()
    assert sorted(r["doc_id"] for r in left) == [r["doc_id"] for r in sorted(out) if r["bucket"] != gone] and len(left) < 6


def test_line_dedup(spark, scratch):
    rng = random.Random(3)
    lines = lambda n: [words(rng, 6) for _ in range(n)]
    shared, own = lines(12), [lines(8) for _ in range(6)]
    texts = ["\n".join(o[:4] + shared + o[4:]) for o in own] + ["\n".join(own[0])]
    rows = odd_rows() + [(50 + i, t, "en", "s") for i, t in enumerate(texts)] + [(49, texts[3], "en", "s")] * 2
    df = frame(spark, rows)
    out = [(r["row"]["doc_id"], r["row"]["text"], r["new_text"]) for r in line_dedup.dedup_lines(df, scratch).collect()]
    assert len(out) == len(rows)
    # brute force over chunks, the first by (id, hash of the text, position) stays
    places = defaultdict(list)
    for i, t in {(i, t) for i, t, *_ in rows if t is not None and "\n" in t}:
        own_lines = t.encode().split(b"\n")
        th = xxhash.xxh64_intdigest(t.encode(), 42)
        for a, e in line_dedup.cut(own_lines):
            if e - a >= 2:
                places[b"\n".join(own_lines[a:e])].append(((i is not None, i or 0), th - (1 << 64) if th >> 63 else th, a, e, t))
    gone = defaultdict(set)
    for p in places.values():
        for (_, i), _, a, e, t in sorted(p)[1:]:
            gone[i, t].update(range(a, e))
    assert gone
    for i, t, new in out:
        if t is None:
            assert new is None
        else:
            cut = gone.get((i or 0, t), set())
            kept = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in cut)
            assert new == kept or (len(t.split("\n")) - 1 in cut and new == kept.rstrip("\n")), i
    # boundaries shift with insertions
    a = line_dedup.cut([x.encode() for x in own[1] + shared])
    b = line_dedup.cut([x.encode() for x in own[2] + own[3] + shared])
    assert {e - 8 for _, e in a} & {e - 16 for _, e in b} - {12}
    assert line_dedup.dedup_lines(frame(spark, []), scratch).count() == 0


def test_simhash(spark, scratch):
    rng = random.Random(4)
    rows = odd_rows()
    for g in range(12):
        base = words(rng, 150).split()
        for c in range(6):
            own = list(base)
            for _ in range(c % 3):
                own[rng.randrange(len(own))] = "zz"
            rows.append((1000 + g * 10 + c, " ".join(own), "en", "s"))
    got = {(r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.simhash_groups(frame(spark, rows), scratch).collect()}

    def slow(text):
        ws = (text or "").encode().lower().split()
        if not ws:
            return 0
        sh = [b" ".join(ws[i:i + 3]) for i in range(max(1, len(ws) - 2))]
        hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    fps = {t: slow(t) for _, t, *_ in rows}
    nodes = sorted({(i, fps[t]) for i, t, *_ in rows if i is not None})
    link = [(a[0], b[0]) for a, b in combinations(nodes, 2) if bin(a[1] ^ b[1]).count("1") <= 3]
    comp = union_find(link, {i for i, _ in nodes})
    by_fp = {f: comp[i] for i, f in nodes}
    assert got == {(i, fps[t], by_fp.get(fps[t])) for i, t, *_ in rows}
    x = np.array([rng.getrandbits(64) for _ in range(150)], np.uint64)
    x = np.concatenate([x, x ^ np.uint64(7), x ^ np.uint64(15)])
    want = np.array([[bin(int(a) ^ int(b)).count("1") <= 3 for b in x] for a in x])
    assert (simhash.near_pairs(x, np.zeros_like(want)) == want).all()
    kept = simhash.drop_near_duplicates(frame(spark, rows), scratch)
    assert set(kept.columns) == set(frame(spark, []).columns)
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for _, _, c in got if c is not None})
    assert simhash.simhash_groups(frame(spark, []), scratch).count() == 0


def test_embeddings(spark, scratch, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 16))
    vs = [(base[i % 40] + rng.standard_normal(16) * 0.06).astype(np.float32).tolist() for i in range(400)]
    rows = list(enumerate(vs)) + [(1000 + i, vs[0]) for i in range(50)] + [
        (2000, None), (2001, [0.0] * 16), (2002, [1.0, None] * 8), (2003, [float("nan")] * 16), (2004, [float("inf")] * 16), (None, vs[1]), (2005, []),
        (2006, [1.0, 2.0]), (2007, [2.0, 4.0]), (7, vs[7])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(1)).withColumn("v", F.lit("x"))
    monkeypatch.setattr(embed_dedup, "PART_ROWS", 20)
    got = sorted((r["vec_id"] if r["vec_id"] is not None else -1, r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.embedding_groups(df, scratch).collect())
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    unit = [(i, v / np.linalg.norm(v)) for i, v in ok]
    pairs = [(a, b) for a, b in combinations(range(len(unit)), 2) if len(unit[a][1]) == len(unit[b][1]) and unit[a][1] @ unit[b][1] >= 0.95]
    n = Counter(x for p in pairs for x in p)
    comp = union_find([(unit[a][0], unit[b][0]) for a, b in pairs], {i for i, _ in unit})
    links = defaultdict(list)
    for k, (i, _) in enumerate(unit):
        links[i].append(n[k])
    want = [(i, c, comp[i], i == comp[i]) for i, cs in links.items() for c in cs]
    want += [(-1 if i is None else i, 0, i, True) for i, v in rows if i is None or i in (2000, 2001, 2002, 2003, 2004, 2005)]
    found = sum(g[1] for g in got) / sum(w[1] for w in want)
    assert len(got) == len(want) and 0.98 < found <= 1
    assert sum(a != b for a, b in zip(got, sorted(want))) <= 0.1 * len(want)
    assert embed_dedup.embedding_groups(df.limit(0), scratch).count() == 0


def test_mixing(spark, scratch):
    rows = odd_rows() + [(100 + i, f"t{i}", "en", f"s{min(i // 60, 4)}") for i in range(500)]
    out = mixing.mix(frame(spark, rows), scratch, block=4).select("row.doc_id", "row.source", "epoch", "slot", "place").collect()
    first = Counter((r["doc_id"], r["source"]) for r in out if r["epoch"] == 0)
    assert first == Counter((i, s) for i, _, _, s in rows)
    assert set(Counter((r["slot"], r["place"]) for r in out).values()) == {1}
    by_slot = {r["slot"]: r["source"] for r in out}
    assert sorted(by_slot) == list(range(len(by_slot)))
    some = mixing.mix(frame(spark, rows), scratch, {"s1": 3.0, "s4": 1.0, "s0": 0.0}, block=4).select("row.source", "slot").distinct().collect()
    assert {r["source"] for r in some} == {"s1", "s4"}  # sources without weight are not used
    assert mixing.mix(frame(spark, rows), scratch, {"none": 1.0}).count() == 0
    assert mixing.mix(frame(spark, []), scratch).count() == 0


@pytest.mark.parametrize("sizes, weights", [
    ([(f"s{i:02d}", 32 * (700 if i == 3 else 90)) for i in range(20)], None),  # one source with a third of all rows
    ([("a", 64_000), ("b", 64_000), ("c", 3200), (None, 320)], {"a": 0.6180339887, "b": 0.3, "c": 0.07, "": 0.011}),
    ([("a", 100_000), ("b", 1)], {"a": 0.5, "b": 0.5})])
def test_mix_stays_within_a_block_of_the_weights(spark, sizes, weights):
    """Every prefix of the whole schedule, thousands of slots, against the target weights themselves."""
    table = spark.createDataFrame(sizes, "source string, n long")
    plan = mixing.weighed(table, weights, 0.8, 32, 200_000)
    by = {r["k"]: r for r in plan.collect()}
    want = {r["source"]: (r["n"] ** 0.8 if weights is None else weights[r["source"] or ""]) for r in by.values()}
    slots = [r["k"] for r in mixing.schedule(plan).orderBy("slot").collect()]
    assert len(slots) == next(iter(by.values()))["slots"] and len(slots) > 3000
    hits = np.zeros((len(by), len(slots)))
    hits[slots, np.arange(len(slots))] = 1
    share = np.array([want[by[k]["source"]] for k in sorted(by)]) / sum(want.values())
    off = np.abs(hits.cumsum(axis=1) - share[:, None] * np.arange(1, len(slots) + 1))
    assert off.max() < 1.0001


def test_mix_of_many_documents_has_a_bounded_schedule(spark):
    table = spark.createDataFrame([("a", 10**12), ("b", 10**10), ("c", 10**9)], "source string, n long")
    plan = mixing.weighed(table, None, 0.8, 32, 2000)
    assert plan.first()["slots"] <= 2100 and mixing.schedule(plan).count() == plan.first()["slots"]


def test_sharding(spark, scratch):
    rng = random.Random(6)
    rows = odd_rows() + [(100 + i, "copy" if i % 3 == 0 else rng.choice(["p", "q", "r"]) * rng.randint(1, 60), "en", "s") for i in range(600)]
    out = sharding.shard(frame(spark, rows), scratch, shards=7).collect()
    text = {i: t or "" for i, t, *_ in rows}
    assert Counter(r["doc_id"] for r in out) == Counter(i for i, *_ in rows)
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
        if r["doc_id"] is not None:
            import zlib
            assert r["size"] == len(text[r["doc_id"]].encode()) + 16 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode())
    assert set(slots) == set(range(7)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    # pairs of linked rows lie together far more often than by chance, even with no unlinked rows to give way; and a group
    # larger than a shard is spread
    where = defaultdict(Counter)
    for r in out:
        where[text.get(r["doc_id"], "")][r["shard"]] += 1
    hot = where.pop("copy")
    assert sum(hot.values()) == 200 and max(hot.values()) > 40
    together = sum(n * (n - 1) for c in where.values() for n in c.values())
    assert together > 0.9 * sum(sum(c.values()) * (sum(c.values()) - 1) for c in where.values())
    assert sharding.shard(frame(spark, []), scratch).count() == 0


def test_alignment_in_linear_memory(monkeypatch):
    """Halved alignments are as long as whole ones; two texts of 200,000 words fit in little memory, equal ones cost nothing."""
    import tracemalloc

    rng = random.Random(33)
    for k in range(300):
        a, b = ([rng.choice("abcd"[:rng.randint(1, 4)]) for _ in range(rng.randint(0, 30))] for _ in range(2))
        if k % 3 == 0:
            b = a[:5] + b + a[-4:]
        dp = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                dp[i + 1][j + 1] = dp[i][j] + 1 if x == y else max(dp[i][j + 1], dp[i + 1][j])
        assert substring.common(a, b) == dp[-1][-1]
        for table in (1, 40, 1 << 25):
            monkeypatch.setattr(substring, "TABLE", table)
            left, right = substring.traced(a, b)
            both = (left >= 0) & (right >= 0)
            assert both.sum() == dp[-1][-1] and all(a[i] == b[j] for i, j in zip(left[both], right[both]))
            assert left[left >= 0].tolist() == list(range(len(a))) and right[right >= 0].tolist() == list(range(len(b)))
    long = words(rng, 200_000).split()
    edited = [w if i % 97 else "other" for i, w in enumerate(long)]
    assert substring.common(long, list(long)) == 200_000 and substring.alike(" ".join(long), " ".join(edited))
    some, changed = long[:40_000], edited[:40_000]
    tracemalloc.start()
    left, right = substring.traced(some, changed)
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()
    assert ((left >= 0) & (right >= 0)).sum() >= sum(x == y for x, y in zip(some, changed))


@pytest.mark.parametrize("size, single", [(2, 0), (5, 0), (2, 1500)])
def test_sharding_keeps_groups_together(spark, scratch, size, single):
    """All rows in pairs, in fives, and pairs beside unlinked rows: a perfect assignment exists, and nearly all of it is found."""
    n = 1200 * size
    rows = [(i, f"t{i // size}", "en", "s") for i in range(n)] + [(10_000 + i, f"alone {i}", "en", "s") for i in range(single)]
    out = sharding.shard(frame(spark, rows, clash=False), scratch).select("doc_id", "shard").collect()
    at = {r["doc_id"]: r["shard"] for r in out}
    sizes = Counter(at.values())
    assert len(at) == len(rows) and max(sizes.values()) - min(sizes.values()) <= 1
    groups = [Counter(at[i] for i in range(k, k + size)) for k in range(0, n, size)]
    kept = sum(n * (n - 1) for c in groups for n in c.values())
    assert kept >= 0.95 * n * (size - 1)


def test_sharding_quotas():
    flows = sharding.quotas({(0, 1): 50, (1, 0): 30, (2, 1): 40}, [100, 100, 100], 110)
    load = [100 - flows[1] + flows[3], 100 + flows[1] + flows[7] - flows[3], 100 - flows[7]]
    assert max(load) <= 110 and sum(load) == 300 and flows[3] == 30 and flows[1] + flows[7] == 40


def test_bpe(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    tk = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(7)
    texts = ["".join(rng.choice("aab 's\n\t é漢🙂12.-_\x1c\x85\xa0 ") for _ in range(rng.randint(0, 50))) for _ in range(2000)]
    texts += ["a" * 20_000, " " * 9000, "ab" * 9000, "don't  stop\n\n now ", "<|endoftext|>"]
    assert bpe.encode(texts, ranks, public_tokenizers.PATTERN) == [tk.encode_ordinary(t) for t in texts]
    rows = odd_rows()
    for r, (i, t, *_) in zip(bpe.bpe_digests(frame(spark, rows).coalesce(1), path, public_tokenizers.PATTERN).collect(), rows):
        ids = tk.encode_ordinary(t or "")
        assert tuple(r) == (i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert bpe.bpe_digests(frame(spark, []), path, public_tokenizers.PATTERN).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_levenshtein_matcher():
    rng = random.Random(8)
    lexicon = ["=idiot", "=moron", "stupi", "=worthlessness", "=cad"]
    m = toxicity.Matcher(lexicon)
    edits = lambda s: 0 if len(s) < 5 else 1 if len(s) < 9 else 2
    for _ in range(3000):
        w = list(rng.choice(lexicon).lstrip("=") + rng.choice(["", "", "x", "ness"]))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w)):rng.randrange(len(w)) + 1] = rng.choice(["", "i", "o", "ab"])
            w = w or ["z"]
        w = "".join(w)
        whole = min((distance(t[1:], w) for t in lexicon if t[0] == "=" and distance(t[1:], w) <= edits(t[1:])), default=9)
        stem = min((d for t in lexicon if t[0] != "=" for k in range(len(w) + 1) if (d := distance(t, w[:k])) <= edits(t)), default=9)
        want = 1 if whole == 0 else 2 if stem == 0 else 3 if whole < 9 else 4 if stem < 9 else 0
        assert m.kind(w) == want, w


def test_toxicity(spark, scratch):
    rng = random.Random(9)
    bad, rows, labels = ["scumbag", "vermins", "loathsome"], odd_rows(), []
    for i in range(100, 700):
        ws, toxic = words(rng, 40, "aeioustrn").split(), i % 4 == 0
        if toxic:
            for _ in range(3):
                ws[rng.randrange(40)] = rng.choice(bad)
        elif i % 7 == 0:
            ws += ["he", "said", '"' + rng.choice(bad) + '"']
        rows.append((i, " ".join(ws), "en", "s"))
        labels.append((i, 1, int(toxic)))
    rows.append((900, "such a scumbga and loathsme vermins", "en", "s"))
    labels += [(100, 1, None), (None, 0, 1), (100, 1, 1)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))
    df = frame(spark, rows)
    got = {r["doc_id"]: r for r in toxicity.toxicity(df, lab, scratch).collect()}
    assert len(got) == len({i for i, *_ in rows})
    truth = {i: t for i, _, t in labels if t is not None and i is not None}
    held = [i for i in truth if got[i]["held_out"]]
    assert len(held) > 60 and sum(got[i]["predicted"] == truth[i] for i in held) >= 0.97 * len(held)
    assert got[900]["predicted"] == 1 and got[1]["predicted"] == 0 and all(0 <= r["score"] <= 1 for r in got.values())
    kept = toxicity.keep_clean(df, lab, scratch)
    assert kept.columns == df.columns
    assert Counter(r["doc_id"] for r in kept.select("doc_id").collect()) == Counter(i for i, *_ in rows if got[i]["predicted"] == 0)
    assert toxicity.toxicity(frame(spark, []), lab, scratch).count() == 0
    assert {r["predicted"] for r in toxicity.toxicity(df, lab.limit(0), scratch).collect()} == {0}


def test_language_gradients():
    net = language.Network(3, seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, mask = language.pack([b"abc", b"z", b"hello", b"ba"])
    y = np.array([0, 1, 2, 1])
    _, grad = net.gradients(x, mask, y)
    rng = np.random.default_rng(0)
    for k, v in net.p.items():
        for _ in range(5):
            at = tuple(rng.integers(0, s) for s in v.shape) if not k.startswith("x") else (int(x[rng.integers(0, 3), 2]), int(rng.integers(0, v.shape[1])))
            old = v[at]
            v[at] = old + 1e-3
            up = net.gradients(x, mask, y)[0]
            v[at] = old - 1e-3
            down = net.gradients(x, mask, y)[0]
            v[at] = old
            assert abs((up - down) / 2e-3 - grad[k][at]) < 2e-4, (k, at)


def test_language(spark, scratch):
    rng = random.Random(10)
    kinds = {"aa": "aeinst", "bb": "oukrlm", "cc": "aouxzq"}
    rows = odd_rows() + [(100 + i, words(rng, 30, kinds[k]), k, "s") for i, k in enumerate(list(kinds) * 80)]
    rows += [(5000, "12 34 --", "aa", "s"), (5001, words(rng, 2000, kinds["bb"]).replace(" ", ""), None, "s")]
    got = [(r["doc_id"], r["held_out"], r["lang_pred"], r["score"]) for r in language.language_id(frame(spark, rows), scratch).collect()]
    assert len(got) == len(rows)
    lang = {i: k for i, _, k, _ in rows if i is not None and 100 <= i < 5000}
    held = [(lang[i], p) for i, h, p, _ in got if i in lang and h]
    assert len(held) > 50 and sum(a == b for a, b in held) >= 0.95 * len(held)
    by = {i: (p, s) for i, _, p, s in got}
    assert by[1] == by[2] == by[6] == by[5000] == ("und", 0.0) and by[5001][0] == "bb" and all(0 <= s <= 1 for *_, s in got)
    assert language.language_id(frame(spark, []), scratch).count() == 0
    assert {r["lang_pred"] for r in language.language_id(frame(spark, [(1, "abc", None, None)]), scratch).collect()} == {"und"}


def test_substring(spark, scratch):
    rng = random.Random(11)
    passage = words(rng, 70).split()
    docs = {}
    for i in range(100, 112):
        own = list(passage)
        for _ in range(i % 3):
            own[rng.randrange(70)] = "changed"
        docs[i] = " ".join([words(rng, rng.randint(20, 200)), *own, words(rng, rng.randint(20, 200))])
    clean = {i: words(rng, 300) for i in range(200, 230)}
    short = " ".join(passage[:30])
    rows = [r for r in odd_rows() if r[0] != 4] + [(i, t, "en", "s") for i, t in (docs | clean).items()]
    rows += [(300, clean[200], "en", "s"), (301, words(rng, 60) + " " + short, "en", "s")]
    got = substring.repeated_passages(frame(spark, rows), scratch).collect()
    ids = {r["doc_id"] for r in got} | {r["other_id"] for r in got}
    assert ids == set(docs) | {200, 300}
    text = {i: t for i, t, *_ in rows}
    for r in got:
        a, b = text[r["doc_id"]][r["start"]:r["stop"]].split(), text[r["other_id"]][r["other_start"]:r["other_stop"]].split()
        assert len(a) == r["words"] >= 50 and r["similarity"] >= 0.8
        assert r["doc_id"] == 300 or len(set(a) & set(passage)) >= 60
    # bit-parallel subsequence against the table
    for _ in range(200):
        a, b = [rng.choice("abc") for _ in range(rng.randint(0, 12))], [rng.choice("abc") for _ in range(rng.randint(0, 12))]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert substring.common(a, b) == t[-1][-1]
    assert substring.repeated_passages(frame(spark, []), scratch).count() == 0


def test_substring_passages_of_one_chain(spark, scratch):
    """Two passages with 30 to 80 other words between them, and a passage with a chance seed after it."""
    rng, rows, want = random.Random(21), [], {}
    for n, gap in enumerate((30, 40, 60, 80)):
        one, two = words(rng, 60), words(rng, 60)
        for d in (0, 1):
            rows.append((2 * n + d, " ".join([words(rng, 80), one, words(rng, gap), two, words(rng, 80)]), "en", "s"))
        want[2 * n] = [one, two]
    one, seed = words(rng, 60), words(rng, 5)
    rows += [(10 + d, " ".join([words(rng, 80), one, words(rng, 40), seed, words(rng, 80)]), "en", "s") for d in (0, 1)]
    want[10] = [one]
    got, text = substring.repeated_passages(frame(spark, rows), scratch).collect(), {i: t for i, t, *_ in rows}
    for i, passages in want.items():
        found = [text[i + 1][r["start"]:r["stop"]].split() for r in got if (r["doc_id"], r["other_id"]) == (i + 1, i)]
        for p in passages:
            assert any(substring.common(p.split(), f) >= 58 for f in found), (i, len(found))
    for r in got:
        a, b = text[r["doc_id"]][r["start"]:r["stop"]].split(), text[r["other_id"]][r["other_start"]:r["other_stop"]].split()
        assert min(len(a), len(b)) >= 50 and 2 * substring.common(a, b) >= 0.8 * (len(a) + len(b))
    for _ in range(100):
        a, b = [rng.choice("abc") for _ in range(rng.randint(0, 12))], [rng.choice("abc") for _ in range(rng.randint(0, 12))]
        i, j = substring.traced(a, b)
        both = [(x, y) for x, y in zip(i.tolist(), j.tolist()) if x >= 0 and y >= 0]
        assert len(both) == substring.common(a, b) and all(a[x] == b[y] for x, y in both)
        assert i[i >= 0].tolist() == list(range(len(a))) and j[j >= 0].tolist() == list(range(len(b)))


@pytest.mark.parametrize("step", [1, 1000, 10**12])
def test_substring_neighbours_at_any_spacing(spark, scratch, monkeypatch, step):
    """Two documents with a passage meet although the first occurrences of its seeds are scattered, near or far apart in ids."""
    rng = random.Random(22)
    one = words(rng, 60).split()
    rows = [(k, " ".join([words(rng, 20), *one[5 * k:5 * k + 9], words(rng, 20)]), "en", "s") for k in range(12)]
    rows += [(k, words(rng, 60), "en", "s") for k in range(12, 60)]
    rows += [(i, " ".join([words(rng, 60), *one, words(rng, 60)]), "en", "s") for i in (60, 75, 90)]
    rows = [(i * step - 7 * step, *r) for i, *r in rows]
    for hot in (1024, 2):
        monkeypatch.setattr(substring, "HOT", hot)
        got = substring.repeated_passages(frame(spark, rows), scratch).collect()
        pairs = {((r["doc_id"] // step) + 7, (r["other_id"] // step) + 7) for r in got}
        assert {(75, 60), (90, 75)} <= pairs <= {(75, 60), (90, 75), (90, 60)}


def test_substring_every_partner(spark, scratch, monkeypatch):
    """Pairs meet although other documents hold each of their seeds, first of all and between them; copies are linked whole."""
    rng = random.Random(24)
    one = words(rng, 60).split()
    pieces = [one[5 * k:5 * k + 9] for k in range(12)]
    rows = [(at + k, " ".join([words(rng, 20), *piece, words(rng, 20)]), "en", "s") for at in (0, 100, 200) for k, piece in enumerate(pieces)]
    rows += [(i, " ".join([words(rng, 60), *one, words(rng, 60)]), "en", "s") for i in (50, 150, 250)]
    # the first place of these seeds is followed by other words, a later one by the passage
    twice = words(rng, 60)
    start = " ".join(twice.split()[:12])
    rows += [(i, " ".join([start, words(rng, 200), twice, words(rng, 60)]), "en", "s") for i in (300, 310)] + [(299, start + " " + words(rng, 60), "en", "s")]
    rows += [(400, rows[-2][1], "en", "s")]
    for cell in (4096, 2):
        monkeypatch.setattr(substring, "CELL", cell)
        got = substring.repeated_passages(frame(spark, rows), scratch).collect()
        assert {(r["doc_id"], r["other_id"]) for r in got} == {(150, 50), (250, 50), (250, 150), (310, 300), (400, 310)}, cell
        copy = next(r for r in got if r["doc_id"] == 400)
        assert (copy["start"], copy["stop"], copy["similarity"]) == (0, len(rows[-1][1]), 1.0)


def test_substring_previous_document(spark):
    rng = random.Random(23)
    rows = [(h, d, p, p + 5) for h in range(4) for d in rng.sample(range(-300, 300), 40) for p in rng.sample(range(1000), rng.randint(1, 3))]
    df = spark.createDataFrame(rows, "h long, doc long, p int, e int")
    for hot, width in ((False, 1), (True, 1), (True, 50), (True, 10**6)):
        for r in substring.before(df, ["h"], F.lit(hot), width).collect():
            docs = [d for h, d, *_ in rows if h == r["h"] and d < r["doc"]]
            want = min((d, p, e) for h, d, p, e in rows if h == r["h"] and d == max(docs)) if docs else None
            assert (tuple(r["prev"]) if r["prev"] else None) == want


def test_substring_changed_and_periodic(spark, scratch):
    """Passages with a word changed in every 5 to 10, and those that repeat 1 to 16 words over and over."""
    rng, rows, every = random.Random(24), [], []
    for step in (5, 6, 8, 10):
        for _ in range(25):
            one = words(rng, 60).split()
            two = [words(rng, 1, "xyz") if k % step == step - 1 else w for k, w in enumerate(one)]
            every.append((step, len(rows)))
            rows += [(len(rows) + d, " ".join([words(rng, 50), *ws, words(rng, 50)]), "en", "s") for d, ws in enumerate((one, two))]
    for period in (1, 3, 8, 12, 16):
        one = " ".join((words(rng, period).split() * 64)[:64])
        every.append((0, len(rows)))
        rows += [(len(rows) + d, " ".join([words(rng, 50), one, words(rng, 50)]), "en", "s") for d in (0, 1)]
    got = {(r["doc_id"], r["other_id"]) for r in substring.repeated_passages(frame(spark, rows), scratch).collect()}
    assert got <= {(i + 1, i) for _, i in every}
    found = Counter(step for step, i in every if (i + 1, i) in got)
    assert found[0] == 5 and found[10] == found[8] == 25 and found[6] >= 24 and found[5] >= 22, found


def five_words(text):
    ws = (text or "").lower().split()
    return frozenset(tuple(ws[i:i + 5]) for i in range(max(1, len(ws) - 4))) if ws else frozenset()


def test_near_copies_of_the_pipeline(spark, scratch, monkeypatch):
    """Groups against five-word Jaccard 0.8 over all pairs, with hot buckets dealt to small parts too."""
    import corpus_pipeline as cp

    rng, rows = random.Random(25), odd_rows()
    for g in range(30):
        base = words(rng, 150).split()
        for c in range(8):
            own = list(base)
            for k in rng.sample(range(150), c if g % 2 else c // 2):
                own[k] = words(rng, 1, "xyz")
            rows.append((1000 + g * 10 + c, " ".join(own), "en", "s"))

    sets = {i: five_words(t) for i, t, *_ in rows if i is not None}
    near = [(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = union_find(near, set(sets))
    for part in (512, 3):
        monkeypatch.setattr(minhash, "PART_ROWS", part)
        got = {r["doc_id"]: r["component_id"] for r in minhash.near_groups(frame(spark, rows), scratch).collect() if r["doc_id"] is not None}
        assert got == want
    kept = cp.drop_near_duplicates(spark, frame(spark, rows), "")
    assert set(kept.columns) == set(frame(spark, []).columns)
    assert sorted(i for i in (r["doc_id"] for r in kept.collect()) if i is not None) == sorted(set(want.values()))
    assert minhash.near_groups(frame(spark, []), scratch).count() == 0


def test_near_copies_with_repeated_and_null_ids(spark, scratch):
    """No text is lost because another row has its id; copies under a null id go, but not the last of a group."""
    rng = random.Random(31)
    a, b, c, d = (words(rng, 80) for _ in range(4))
    edited = a.rsplit(" ", 2)[0] + " other end"
    rows = [(7, a, "en", "s"), (7, b, "en", "s"), (7, a, "en", "s"), (3, edited, "en", "s"), (None, b, "en", "s"), (None, c, "en", "s"), (None, c, "en", "s"),
            (9, d, "en", "s"), (8, d, "en", "t")]
    out = minhash.drop_near_duplicates(frame(spark, rows), scratch).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in out) == sorted([("3", edited), ("7", b), ("None", c), ("8", d)])


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage on its own input, on a fixture of all kinds of documents."""
    import corpus_pipeline as cp

    rng = random.Random(12)
    rows = []
    for i in range(240):
        ws = words(rng, 60, "aeioustrn").split()
        if i % 6 == 0:
            for _ in range(4):
                ws[rng.randrange(60)] = "scumbag"
        lines = [" ".join(ws[k:k + 10]) for k in range(0, 60, 10)]
        rows.append((i, "\n".join(lines), "en", f"s{i % 3}"))
    rows += [(300 + i, rows[i][1], "en", "s0") for i in range(40)] + [(400, None, None, None), (401, "", "en", "s1")]
    df = frame(spark, rows, clash=False)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(cp.STAGES) - 1:
            assert out.dtypes == df.dtypes
        out.write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        seen.append([tuple(r) for r in docs.collect()])
    clean, lined, near, mixed, last = seen
    assert {r[0] for r in clean} == {i for i, t, *_ in rows if "scumbag" not in (t or "")}
    assert sorted(r[0] for r in lined) == sorted(r[0] for r in clean)
    assert all(r[4] == (None if r[1] is None else len(r[1])) for r in lined)
    assert sum(len(r[1] or "") for r in lined) < sum(len(r[1] or "") for r in clean)
    sets = {r[0]: five_words(r[1]) for r in lined}
    comp = union_find([(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])], set(sets))
    assert sorted(r[0] for r in near) == sorted(set(comp.values()))
    assert {r[:2] for r in mixed} == {r[:2] for r in near}
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    text = {r[0]: r[1] for r in mixed}
    assert Counter(r[0] for r in last) == Counter(r[0] for r in mixed)
    for i, n, _, back in last:
        assert n == len(bpe.encode([text[i]], ranks, public_tokenizers.PATTERN)[0])
        assert back == hashlib.sha256((text[i] or "").encode()).hexdigest()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in cp.run(spark, str(tmp_path)).collect()) == Counter(r[:2] for r in last)


@pytest.mark.parametrize("name", ["op4_embedding_dedup", "op5_mix_sources", "op8_exact_dedup"])
def test_query_against_sql(spark, name):
    import duckdb
    from oracle_check import compare

    from scriptorium.llm.queries import QUERIES, SQL

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    ok, note = compare(spark, con, QUERIES[name], SQL[name], "/root/testdata/sf0.001")
    assert ok, note


def test_near_copies_by_fingerprints(spark, scratch):
    """The near-copy stage links by SimHash fingerprints; what these propose is checked on the whole texts."""
    rng = random.Random(44)
    apart = lambda x, y: (simhash.fingerprint(x) ^ simhash.fingerprint(y)).bit_count()
    while True:
        base = words(rng, 300)
        edited = base.rsplit(" ", 1)[0] + " end"
        if 0 < apart(base, edited) <= 3:
            break
    # one three-word shingle, so one fingerprint, but no five words in common
    rows = [(1, base, "en", "s"), (2, edited, "en", "s"), (3, "a a a", "en", "s"), (4, "a a a a a", "en", "s"), (5, words(rng, 80), "en", "s")]
    docs = frame(spark, rows).select("doc_id", "text", F.xxhash64("text").alias("th"))
    nodes = docs.mapInArrow(minhash.signed, "doc_id long, th long, fp long, digest long, n int, keys array<long>").select(F.col("doc_id").alias("id"), "th", "fp")
    assert {tuple(r) for r in minhash.fingerprint_links(nodes, docs.select("th", "text"), scratch).collect()} <= {(1, 2), (2, 1)}
    assert minhash.fingerprint_links(nodes, docs.select("th", "text"), scratch).count() == 1
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_groups(frame(spark, rows), scratch).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_every_pair_of_linked_fingerprints(spark, scratch, monkeypatch):
    """A pair is checked although an unlike text, with the same fingerprint or a linked one, comes first."""
    rng = random.Random(45)
    apart = lambda x, y: (simhash.fingerprint(x) ^ simhash.fingerprint(y)).bit_count()
    while True:
        # the order of the blocks leaves the three-word shingles alone, but not those of five words
        blocks = words(rng, 80).split()
        text = lambda bs: "p q " + " ".join(f"{b} p q" for b in bs)
        other, swapped = rng.sample(blocks, 80), [*blocks[:40], blocks[41], blocks[40], *blocks[42:]]
        ends = [text(bs) + " end" for bs in (blocks, swapped)]
        if 0 < apart(text(other), ends[0]) <= 3 and len({*map(five_words, (text(blocks), text(swapped), *ends))}) == 4:
            break
    texts = [text(other), text(blocks), text(swapped), *ends]
    assert len({simhash.fingerprint(t) for t in texts}) == 2
    rows = [(i, t, "en", "s") for i, t in enumerate(texts, 1)]
    docs = frame(spark, rows).select("doc_id", "text", F.xxhash64("text").alias("th"))
    nodes = docs.mapInArrow(minhash.signed, "doc_id long, th long, fp long, digest long, n int, keys array<long>").select(F.col("doc_id").alias("id"), "th", "fp")
    for part in (512, 2):
        monkeypatch.setattr(minhash, "PART_ROWS", part)
        got = {tuple(sorted(r)) for r in minhash.fingerprint_links(nodes, docs.select("th", "text"), scratch).collect()}
        assert union_find(got, range(1, 6)) == {1: 1, 2: 2, 3: 2, 4: 2, 5: 2}
    # one set with two fingerprints: the second one links with a text that the first one misses
    while True:
        base = words(rng, 40).split()
        once, twice = " ".join(base + base), " ".join(base + base + base[:30])
        edited = twice.rsplit(" ", 1)[0] + " end"
        if apart(twice, edited) <= 3 < apart(once, edited) and five_words(once) == five_words(twice) != five_words(edited):
            break
    monkeypatch.setattr(minhash, "linked", lambda batches: (b.select([]) for b in ()))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_groups(frame(spark, [(1, once, "en", "s"), (2, twice, "en", "s"), (3, edited, "en", "s")]), scratch).collect()}
    assert got == {1: 1, 2: 1, 3: 1}


def test_substring_meetings_in_batches(monkeypatch):
    """Places of a seed meet without a table of their own for each pair, and the pairs that have enough words in common are the same."""
    rng, names = random.Random(46), ["h", "pi", "pj", "part", "doc", "p", "pe", "ep", "e", "linked", "words"]
    vocab, rows = list(range(60_000, 60_040)), []
    for h in range(3):
        bases = [[rng.choice(vocab) for _ in range(n)] for n in (30, 60, 64, 128, 200)]
        for d in range(40):
            own = [w if rng.random() < 0.8 else rng.choice(vocab) for w in bases[d % 5]]
            rows.append((h, 0, int(h == 2), d % 2 if h == 2 else 0, d // 2 if d < 8 else d, d, d + 5, d, d + 5, d % 7 == 0, own))
    kinds = [pa.int64(), *[pa.int32()] * 2, pa.int32(), pa.int64(), *[pa.int32()] * 4, pa.bool_()]
    cols = list(zip(*rows))
    batch = pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds)), pa.array([np.array(w, np.uint16).tobytes() for w in cols[-1]])], names)
    want = set()
    for h in range(3):
        for x, y in combinations([r for r in rows if r[0] == h], 2):
            if x[4] != y[4] and not (x[9] and y[9]) and (h < 2 or x[3] != y[3]) and substring.common(x[10], y[10]) >= 40:
                x, y = max(x, y, key=lambda r: r[4]), min(x, y, key=lambda r: r[4])
                want.add((x[4], y[4], x[5], x[6], y[5], y[6]))
    assert 100 < len(want) < 1500
    calls = []
    whole = substring.common
    monkeypatch.setattr(substring, "common", lambda a, b: calls.append(1) or whole(a, b))
    for size in (4096, 40):
        monkeypatch.setattr(substring, "BATCH", size, raising=False)
        got = {tuple(c.as_py() for c in r) for b in substring.meetings(iter([batch[:50], batch[50:]])) for r in zip(*b.columns)}
        assert got == want and len(calls) < len(want)
    pairs = [([rng.choice(vocab[:k]) for _ in range(rng.randint(0, 150))], [rng.choice(vocab[:k]) for _ in range(rng.randint(0, 150))]) for k in (1, 3, 40) for _ in range(40)]
    flat = [np.array(r, np.uint16) for p in pairs for r in p]
    assert substring.subsequences(flat, np.arange(0, 240, 2), np.arange(1, 240, 2)).tolist() == [whole(a, b) for a, b in pairs]


def test_substring_word_bounds():
    """Word places by all white space there is, the same as those of the pattern."""
    rng, space = random.Random(47), [chr(i) for i in range(0x3001) if chr(i).isspace()]
    for _ in range(300):
        t = "".join(rng.choice(space + ["a", "é", "漢", "🙂", "Σ", "İ"] * 8) for _ in range(rng.randint(0, 60)))
        starts, stops = substring.bounds(t)
        assert list(zip(starts.tolist(), stops.tolist())) == [m.span() for m in substring.WORD.finditer(t)]
