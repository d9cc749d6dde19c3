"""Joins against brute force over all pairs on small inputs."""

import random
from difflib import SequenceMatcher

import pandas as pd
import pytest
from pyspark.sql import functions as F

from scriptorium.functions import similarity as sim
from scriptorium.operators import link, resolve

RNG = random.Random(11)
WORDS = ["laser", "cavity", "atom", "field", "photon", "loss", "gain", "mirror", "beam", "pump", "mode", "line"]


def sentence(n=None):
    return " ".join(RNG.choice(WORDS) for _ in range(n or RNG.randint(3, 9)))


def edit(s):
    k = RNG.randrange(len(s))
    return s[:k] + RNG.choice("xyz") * RNG.randint(0, 6) + s[k + RNG.randint(0, 4):]


def sides(n_keys=4, n=23):
    left, right = [], []
    for k in range(n_keys):
        rs = [sentence() for _ in range(n)]
        right += [(k, i, t) for i, t in enumerate(rs)]
        left += [(k, i, edit(RNG.choice(rs)) if i % 3 else RNG.choice(rs) if i % 2 else "zzz qqq") for i in range(n)]
    # One key holds most rows.
    hot = [sentence() for _ in range(70)]
    right += [(99, i, t) for i, t in enumerate(hot)]
    left += [(99, i, edit(RNG.choice(hot))) for i in range(60)]
    return left, right


def ratio(a, b):
    return SequenceMatcher(None, a.lower(), b.lower()).ratio()


SCHEMA = "pair_id long, num long, text string"


def test_best_match_and_claims(spark):
    left, right = sides()
    want = {}
    for k, i, t in left:
        best = max(((ratio(t, u), -j) for kk, j, u in right if kk == k), default=(0, 0))
        if best[0] >= 0.25:
            want[k, i] = (-best[1], round(best[0], 4))
    l, r = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)
    for size in (4, 256):
        m = link.best_match(l, r, "pair_id", size=size)
        got = {(x.pair_id, x.num): (x.right_num, x.score) for x in m.collect()}
        assert got.keys() == want.keys()
        assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-4 for k in want)
    res = link.resolve_claims(l, m, "pair_id").collect()
    assert len(res) == len(left)
    winners = [(x.pair_id, x.right_num) for x in res if x.status == "match"]
    assert len(winners) == len(set(winners)) == len({(k, v[0]) for (k, _), v in want.items()})
    for x in res:
        assert (x.status == "not_found") == ((x.pair_id, x.num) not in want)
    strong = {r.strength for r in resolve.match_strength(link.resolve_claims(l, m, "pair_id")).collect()}
    assert strong <= {"STRONG", "WEAK", "VERY WEAK", None} and "STRONG" in strong


def test_ratio_block_is_exact():
    rights = [sentence() for _ in range(40)] + ["", "é" * 9, "a" * 250]
    block = sim.RatioBlock(rights)
    for left in [sentence() for _ in range(30)] + ["", "a" * 230, edit(rights[3])]:
        all_ = [SequenceMatcher(None, left, r).ratio() for r in rights]
        assert all(b + 1e-12 >= a for a, b in zip(all_, block.bounds(left)))
        first = next((j for j, a in enumerate(all_) if a > 0.7), None)
        assert (block.first_over(left, 0.7) or (None,))[0] == first
        top = max(all_)
        best = block.best(left, 0.25)
        assert best == (all_.index(top), top) if top >= 0.25 else best is None


def test_sequence_diff(spark):
    right = [(1, i, sentence(8)) for i in range(30)]
    left = [(1, i, t if i % 4 else edit(t) + " plus quite a few more words" if i % 8 else "nothing like it #%$") for _, i, t in right]
    left += [(1, 30, right[5][2]), (1, 31, right[5][2])]
    want = {}
    spare = {}
    for _, _, t in right:
        spare[t] = spare.get(t, 0) + 1
    lost = []
    for k, i, t in left:
        if spare.get(t, 0) > 0:
            spare[t] -= 1
        else:
            lost.append((i, t))
    used = {}
    for _, _, t in left:
        used[t] = used.get(t, 0) + 1
    extra = []
    for _, j, u in right:
        if used.get(u, 0) > 0:
            used[u] -= 1
        else:
            extra.append((j, u))
    for i, t in lost:
        near = next((j for j, u in extra if ratio(t, u) > 0.7), None)
        if near is None:
            want[i] = ("missing", None)
        elif sim.py_changed_chars(t, right[near][2]) >= 3:
            want[i] = ("possible_misplaced", near)
    for size in (3, 256):
        got = link.sequence_diff(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), "pair_id", min_chars=3, size=size).collect()
        assert {x.num: (x.kind, x.right_num) for x in got} == want
    assert sim.py_changed_chars("abcdef", "abc") == 0 and sim.py_changed_chars("abc", "abcdef") == 3


def norm(s):
    import re

    return re.sub(r"[^a-z0-9\s]", "", s.lower().replace("-", " "))


def test_link_notions_both_ways(spark):
    notions = [(" ".join(RNG.sample(WORDS, RNG.randint(1, 3))), i) for i in range(25)] + [("X-ray Beam", 90), ("a", 91)]
    sents = [sentence() + RNG.choice(["", ".", " x ray beams"]) for _ in range(40)] + ["Lasers", "pump", "beam ray x", "gain mirror", notions[0][0] + "z"]
    norms = {}
    for n, line in notions:
        norms[norm(n)] = (n, line)
    want = {(i, n) for i, s in enumerate(sents) for k, (n, _) in norms.items()
            if sim.py_partial_ratio(k, norm(s)) >= 90 or sim.py_token_set_ratio(k, norm(s)) >= 90}
    nd = spark.createDataFrame(notions, "notion string, line int")
    sd = spark.createDataFrame(list(enumerate(sents)), "sent_no long, sentence string")
    for kw in ({}, {"max_local": 3, "block": 5}):
        got = [(r.sent_no, r.notion) for r in link.link_notions(nd, sd, **kw).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_fuzzy_definitions():
    assert sim.py_partial_ratio("laser", "two lasers here") == 100.0
    assert sim.py_token_set_ratio("beam laser", "a laser beam in use") == 100.0
    assert sim.py_token_set_ratio("abc", "xyz") == 0.0
    assert abs(sim.py_partial_ratio("abcd", "xxabxd") - 75.0) < 1e-9


def test_citations_at_borders(spark):
    s = spark.createDataFrame([(1, 1, 0, 100), (1, 2, 101, 50), (1, 3, 5000, 10)], "doc_id long, sent_no int, start long, length int")
    r = spark.createDataFrame([(1, "a", 99), (1, "b", 129), (1, "c", 130), (1, "d", 181), (1, "e", 180), (1, "f", 5039), (1, "g", 5040)], "doc_id long, bib_id string, pos long")
    got = {(x.sent_no, x.bib_id) for x in link.link_citations(r, s).collect()}
    assert got == {(1, "a"), (1, "b"), (2, "b"), (2, "c"), (2, "e"), (3, "f")}


def test_titles(spark):
    papers = spark.createDataFrame([(1, "Laser cooling of atoms"), (2, "Nothing")], "paper_id int, title string")
    c = spark.createDataFrame([(1, 0, "Laser cooling of an atom"), (1, 1, "Laser cooling of atoms"), (2, 0, "qqq")], "paper_id int, cand_rank int, cand_title string")
    assert [(r.paper_id, r.cand_rank) for r in link.resolve_title(papers, c, "best>", 0.6).collect()] == [(1, 1)]
    assert [(r.paper_id, r.cand_rank) for r in link.resolve_title(papers, c, "first>", 0.62).collect()] == [(1, 0)]
    pages = spark.createDataFrame([("laser cooling", 0, "Cooling"), ("laser cooling", 1, "Laser cooling"), ("laser cooling", 9, "laser cooling"), ("zz", 0, "qq")], "notion string, cand_rank int, title string")
    assert [(r.notion, r.title) for r in link.match_page(pages).collect()] == [("laser cooling", "Laser cooling")]


def test_containing_and_anchor(spark):
    paras = spark.createDataFrame([(1, 0, "a b  c"), (1, 1, "x a b c y"), (1, 2, "tail")], "doc_id int, pos int, text string")
    sents = spark.createDataFrame([(1, 0, "a b c"), (1, 1, "c y"), (1, 2, "none")], "doc_id int, num int, text string")
    assert {r.num: r.para for r in link.containing_paragraph(sents, paras, size=2).collect()} == {0: 0, 1: 1, 2: None}
    stream = spark.createDataFrame([(1, 1, "the gain of the mode is given by"), (1, 2, "where the loss rate is small."), (1, 3, "last one here")], "doc_id int, num long, text string")
    f = spark.createDataFrame([(1, 1, "mode is given by"), (1, 2, "where the los rate is smalll"), (1, 3, "zzzz"), (1, 4, "")], "doc_id int, formula_no long, anchor string")
    got = {r.formula_no: (r.num, r.how) for r in link.anchor_formulas(f, stream, size=2).collect()}
    assert got == {1: (1, "contained"), 2: (2, "similar"), 3: (3, "last"), 4: (3, "last")}


def test_assign_figures(spark):
    row = [("g", "about cavity gain", "why", [(1, "Intro"), (2, "Explain Figure 1 well"), (3, "the mirror coating details")], ["Figure 1", "Mirror coating picture", "Experimental setup", "Gain curve", "Other thing"])]
    df = spark.createDataFrame(row, "group string, content_scope string, purpose string, slides array<struct<slide_id:int,plan:string>>, available_figures array<string>")
    got = sorted(link.assign_figures(df).collect(), key=lambda r: r.slide_id)
    # Setup figures go after the first slide, gain figures to the middle, the rest to the end.
    assert [r.figure_used for r in got] == [None, "Experimental setup", "Gain curve", "Figure 1", "Mirror coating picture", "Other thing"]
    assert [r.forced for r in got] == [False, True, True, False, False, True]
    assert all(r.slide_id == i + 1 for i, r in enumerate(got)) and got[-1].plan.startswith("Explain Other thing: what it shows")


def test_resolve_keys(spark):
    slides = spark.createDataFrame([("d", "A::Slide_1", "A", 0, "Intro part", 1), ("d", "A::Slide_2", "A", 0, "Intro part", 2), ("d", "B::Slide_1", "B", 1, "Main part", 1)],
                                   "deck_id string, slide_uid string, group_id string, group_index int, group_name string, slide_id int")
    req = [("u", "A::Slide_2", None, None, None, None, "ok"), ("x", "nope", None, None, None, None, "not found"), ("n", None, None, None, None, None, "slide_id required"),
           ("g", None, "B", 1, None, None, "ok"), ("g2", None, "B", 2, None, None, "not found"), ("i", None, None, 2, 0, None, "ok"), ("i2", None, None, 1, 9, None, "group_index out of range"),
           ("c", None, None, 1, None, "MAIN", "ok"), ("c2", None, None, 1, None, "part", "ambiguous group"), ("c3", None, None, 1, None, "zz", "no group matches"),
           ("s", None, None, 2, None, None, "ok"), ("s2", None, None, 1, None, None, "ambiguous slide"), ("s3", None, None, 7, None, None, "no slide")]
    df = spark.createDataFrame([("d", *r[:-1]) for r in req], "deck_id string, req_id string, slide_uid string, group_id string, slide_id int, group_index int, name_contains string")
    got = {r.req_id: (r.status, r.resolved_uid) for r in link.resolve_keys(df, slides).collect()}
    assert {k: v[0] for k, v in got.items()} == {r[0]: r[-1] for r in req}
    assert got["c"][1] == "B::Slide_1" and got["s"][1] == "A::Slide_2"


def test_majority(spark):
    rows = [("F1", i, f) for i, f in enumerate(["FIG1", "FIG1", None, None, None])] + [("F2", i, f) for i, f in enumerate(["FIG1", None, None])]
    got = {r.block: r.majority for r in link.majority_figure(spark.createDataFrame(rows, "block string, num int, partner_fig string")).collect()}
    assert got == {"F1": "FIG1", "F2": None}


def test_passages(spark):
    body = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, " ".join(body[:12]) + "\n" + " ".join(body[12:])), (2, "other")], "doc_id long, text string")
    p = spark.createDataFrame([(7, "zz " + " ".join(body[10:21]).upper()), (8, "short")], "item_id long, text string")
    assert [(r.item_id, r.doc_id, r.word_at, r.line_no, r.n_windows) for r in link.match_passages(p, docs).collect()] == [(7, 1, 10, 0, 2)]


def test_blocks_with_sparse_positions_and_a_hot_key(spark):
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    left = spark.range(900).select(F.when(F.col("id") < 300, 0).otherwise(F.col("id")).alias("k"), (F.col("id") * 1000).alias("num"),
                                   F.concat(F.lit("row "), F.col("id").cast("string"), F.lit(" "), F.element_at(F.array(*map(F.lit, words)), (F.col("id") % 5 + 1).cast("int"))).alias("text"))
    blocks = link.blocks(left, ["k"], "num", ["text"], "l", 50).filter("k = 0").collect()
    assert len(blocks) <= 6 and sum(len(b.l_items) for b in blocks) == 300
    found = link.best_match(left, left, "k", 0.25, 50).collect()
    assert len(found) == 900 and all(r.num == r.right_num and r.score == 1.0 for r in found)
    pairs = link.block_pairs(left, left, ["k"], "num", "num", ["text"], ["text"], 50)
    assert pairs.filter("k = 0").count() == len(blocks) ** 2


def test_equal_texts_are_scored_once_and_answer_for_all(spark):
    left = spark.createDataFrame([("a", i, "blue ring" if i % 2 else "red bolt") for i in range(600)] + [("a", 600, None), (None, 1, "blue ring")], "k string, num long, text string")
    right = spark.createDataFrame([("a", i, "Blue ring!" if i % 3 else "red bolts") for i in range(600, 0, -1)], "k string, num long, text string")
    got = {r.num: (r.right_num, r.score) for r in link.best_match(left, right, "k").collect()}
    assert got == {i: (1, 0.9474) if i % 2 else (3, 0.9412) for i in range(600)}
    pairs = link.block_pairs(left, right, ["k"], "num", "num", ["text"], ["text"], 64, link.CHARS).collect()
    assert len(pairs) == 4 and sum(len(r.l_items) * len(r.r_items) for r in pairs) == 601 * 600


def test_sequence_diff_broadcasts_no_counts(spark):
    s = spark.createDataFrame([(i, 0, f"text {i}") for i in range(50)], "id long, num long, text string")
    plan = link.sequence_diff(s, s.filter("id < 9"), "id")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_ratio_from_spares_only_lower_ratios(monkeypatch):
    rng, calls = random.Random(7), []
    text = lambda: "".join(rng.choice("abC é漢") for _ in range(rng.randint(0, 14)))
    a, b = [None, "", "x", *(text() for _ in range(3000))], ["", None, "", *(text() for _ in range(3000))]
    exact = [sim.py_ratio(x, y) for x, y in zip(a, b)]
    monkeypatch.setattr(sim, "py_ratio", lambda x, y, real=sim.py_ratio: calls.append(1) or real(x, y))
    for least in (0.0, 0.5, 0.6, 0.70, 1.0):
        got = sim.ratio_from(least).func(pd.Series(a), pd.Series(b)).tolist()
        assert [None if g != g or g is None else g for g in got] == [e if e >= least else None for e in exact]
        calls.clear()
    sim.ratio_from(0.7).func(pd.Series(a), pd.Series(b))
    assert len(calls) < 1000


def counting(spark):
    """A column function that counts how often a row's value is computed."""
    seen = spark.sparkContext.accumulator(0)

    def same(x):
        seen.add(1)
        return x

    return seen, F.udf(same, "string").asNondeterministic()


def test_sequence_diff_reads_each_side_twice(spark):
    seen, same = counting(spark)
    s = spark.createDataFrame([(i % 4, i, f"sentence number {i} of a text") for i in range(40)], "id long, num long, text string")
    right = s.filter("num % 5 <> 4").withColumn("text", F.when(F.col("num") % 7 == 3, F.concat("text", F.lit(" with some more words"))).otherwise(F.col("text")))
    out = link.sequence_diff(s.withColumn("text", same("text")), right, "id").collect()
    assert {r.num for r in out if r.kind == "missing"} >= {i for i in range(40) if i % 5 == 4 and i % 7 != 3} - {r.num for r in out if r.right_num is not None}
    assert seen.value == 80  # for the counts and for the rows


def test_ratio_of_a_held_string_needs_no_matcher():
    a, long = "a sentence that was kept as it is", "x" * 120 + " some letters that are frequent " * 4
    for left, right in ((a, "opening words " + a), ("opening words " + a, a), (a, a), ("", a), ("", ""), ("letters", long), (long, "x " + long)):
        block = sim.RatioBlock([right])
        assert block.ratio(left, 0) == sim.py_ratio(left, right)
        assert bool(block.matchers) == (len(right) >= sim.POPULAR)
        ops = SequenceMatcher(None, left, right).get_opcodes()
        assert sim.py_changed_chars(left, right) == sum(j2 - j1 for tag, _, _, j1, j2 in ops if tag != "equal")


def test_first_over_spares_blocks_of_other_lengths(monkeypatch):
    block = sim.RatioBlock(["short", "a" * 90])
    assert block.first_over("a" * 88, 0.7) == (1, sim.py_ratio("a" * 88, "a" * 90))
    monkeypatch.setattr(sim.RatioBlock, "bounds", lambda *_: pytest.fail("bounds are not needed"))
    assert block.first_over("b" * 30, 0.7) is None


def test_anchor_formulas_computes_formulas_once(spark):
    seen, same = counting(spark)
    f = spark.createDataFrame([(1, 1, "beta gamma"), (1, 2, "delta epsilon zetas"), (1, 3, "%%%%"), (2, 1, None)], "doc_id long, formula_no int, anchor string")
    s = spark.createDataFrame([(1, 0, "alpha beta gamma"), (1, 1, "delta epsilon zeta"), (1, 2, "the end"), (2, 0, "only")], "doc_id long, num int, text string")
    got = {(r.doc_id, r.formula_no): (r.num, r.how) for r in link.anchor_formulas(f.withColumn("anchor", same("anchor")), s).collect()}
    assert got == {(1, 1): (0, "contained"), (1, 2): (1, "similar"), (1, 3): (2, "last"), (2, 1): (0, "last")}
    assert seen.value == 4


def test_link_notions_makes_the_normal_form_once(spark):
    n = spark.createDataFrame([("Cold-Plate!", 1)], "notion string, line int")
    s = spark.createDataFrame([(1, "the COLD-plate, was ***used***"), (2, "?!"), (3, None), (4, "nothing here")], "id long, sentence string")
    out = link.link_notions(n, s)
    assert [(r.id, r.notion) for r in out.collect()] == [(1, "Cold-Plate!")]
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("regexp_replace(") == 1


def test_word_windows_cut_words_once(spark):
    df = spark.createDataFrame([(1, "One two\nTHREE  four\n\nfive"), (2, "short"), (3, None)], "doc_id long, text string")
    out = link.word_windows(df, 3)
    assert [(r.doc_id, r["at"], r.line) for r in out.sort("doc_id", "at").collect()] == [(1, 0, 0), (1, 1, 0), (1, 2, 1)]
    other = link.word_windows(spark.createDataFrame([(1, "two three four")], "doc_id long, text string"), 3).first()
    assert [r["at"] for r in out.collect() if (r.h1, r.h2) == (other.h1, other.h2)] == [1]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "transform(slice(" not in plan and plan.count("lower(") == 1
