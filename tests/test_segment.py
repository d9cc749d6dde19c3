"""Generators against plain restatements of their contracts and small fixtures."""

import random
import re

from pyspark.sql import functions as F

from scriptorium.operators import segment as seg


def docs(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id long, text string")


def by_doc(df, value, order="chunk_no"):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.doc_id, r[order])):
        out.setdefault(r.doc_id, []).append(r[value])
    return out


def random_texts(n=25):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé😀") for _ in range(rng.randint(1, 9)))
    return ["", "a", "x" * 97] + [" ".join(word() + rng.choice(["", "", ".", "!", "\n", "\n\n"]) for _ in range(rng.randint(1, 90))) for _ in range(n)]


def test_sliding_and_overlap(spark):
    ts = random_texts()
    for size, lap in ((50, 10), (20, 15), (7, 1)):
        got = by_doc(seg.sliding_chunks(docs(spark, *ts), size, lap), "chunk")
        for i, t in enumerate(ts):
            assert got[i] == [t[k:k + size] for k in range(0, max(len(t) - lap, 1), size - lap)]
        got = by_doc(seg.overlap_chunks(docs(spark, *ts), size, lap), "chunk")
        for i, t in enumerate(ts):
            t = t.strip()
            chunks = got.get(i, [])
            assert "".join([c if k == 0 else c[lap:] for k, c in enumerate(chunks)]) == t
            assert all(len(c) <= size for c in chunks) and (len(t) > size or len(chunks) == bool(t))


def pack(sents, size, prefix):
    done, cur = [], ""
    room = size - len(prefix)
    for s in (s[k:k + room] for s in sents for k in range(0, len(s), room)):
        joined = f"{cur} {s}" if cur else s
        if len(joined) <= room:
            cur = joined
            continue
        done += [prefix + cur] if cur else []
        cur = s
    return done + ([prefix + cur] if cur else [])


def test_packing(spark):
    ts = random_texts()
    got = by_doc(seg.pack_sentences(docs(spark, *ts), 60, "Notion: n\n\n"), "chunk")
    for i, t in enumerate(ts):
        sents = [s.strip() for s in re.split(r"(?<=[.!?])\s+", t) if s.strip()]
        assert got.get(i, []) == pack(sents, 60, "Notion: n\n\n")
    giant = " ".join(f"w{k}" for k in range(3000))
    chunks = by_doc(seg.pack_sentences(docs(spark, giant), 500), "chunk")[0]
    assert "".join(chunks) == giant and max(map(len, chunks)) <= 500
    got = by_doc(seg.pack_sentences_simple(docs(spark, *ts), 40), "chunk")
    for i, t in enumerate(ts):
        kept = "".join(" ".join(got.get(i, [])).split())
        assert kept == "".join(t.split())


def test_pack_blocks(spark):
    blocks = [("head", "Intro", []), ("p", "a" * 30, ["fig_1: 1"]), ("p", "b" * 30, []), ("head", "Next", []), ("p", "w" * 150 + " " + "z" * 120, ["fig_2: 2"]), ("formula", "Formula: x", [])]
    df = spark.createDataFrame([(1, [dict(kind=k, text=t, figures=f) for k, t, f in blocks])], f"doc_id long, blocks {seg.BLOCK}")
    rows = sorted(seg.pack_blocks(df, 200, 5).collect(), key=lambda r: r.chunk_no)
    assert rows[0].text.startswith("Intro\n" + "a" * 30) and rows[0].text.endswith("Figures used in this chunk: fig_1: 1")
    assert rows[0].section_title == "Next" and rows[0].figures == ["fig_1: 1"]
    # The long block is cut at the space and carries the tail of the chunk before it.
    assert rows[1].text == "\nNext"[-5:].strip().rjust(5, "\n")[-5:] + "w" * 150 + "\n\nFigures used in this chunk: fig_2: 2\n"
    assert rows[2].text.startswith("wwwww" + "z" * 120)
    assert rows[-1].text.endswith("Formula: x")


def test_recursive_chunks(spark):
    ts = random_texts()
    rows = seg.recursive_chunks(docs(spark, *ts), size=40, overlap=10).collect()
    for r in rows:
        assert 0 < len(r.chunk) <= 40 and ts[r.doc_id][r.start:r.start + len(r.chunk)] == r.chunk
    for i, t in enumerate(ts):
        covered = set()
        for r in rows:
            if r.doc_id == i:
                covered |= set(range(r.start, r.start + len(r.chunk)))
        assert all(k in covered for k, ch in enumerate(t) if not ch.isspace())
    assert seg.recursive_chunks(docs(spark, "x" * 9000), "all-MiniLM-L6-v2").agg(F.max(F.length("chunk"))).first()[0] == 1000


def recursive(text, base, size, overlap, seps):
    """The recursion as it is defined, character by character at the end."""
    sep, rest = next((s, seps[i + 1:]) for i, s in enumerate(seps) if s in text)
    pieces = [sep * (i > 0) + p for i, p in enumerate(text.split(sep))] if sep else list(text)
    out, run, at = [], [], base
    chunk = lambda: [(run[0][0] + len(b) - len(b.lstrip()), b.strip()) for b in ["".join(p for _, p in run)] if b.strip()]
    for p in pieces:
        total = sum(len(x) for _, x in run)
        if len(p) >= size and rest:
            out += chunk() + recursive(p, at, size, overlap, rest)
            run = []
        elif p:
            if run and total + len(p) > size:
                out += chunk()
                while run and (sum(len(x) for _, x in run) > overlap or sum(len(x) for _, x in run) + len(p) > size):
                    run.pop(0)
            run.append((at, p))
        at += len(p)
    return out + chunk()


def test_recursive_chunks_against_the_recursion(spark):
    rng = random.Random(8)
    ts = ["".join(rng.choice(["a", "bc", "defg" * 9, " ", "  ", ". ", "\n", "\n\n", "\t", "é🙂"]) for _ in range(rng.randint(0, 90))) for _ in range(120)] + ["", "x" * 95, " " * 50]
    for size, overlap in ((12, 4), (25, 0), (40, 30)):
        got = {}
        for r in seg.recursive_chunks(docs(spark, *ts), size=size, overlap=overlap).orderBy("doc_id", "chunk_no").collect():
            got.setdefault(r.doc_id, []).append((r.start, r.chunk))
        for i, t in enumerate(ts):
            assert got.get(i, []) == recursive(t, 0, size, overlap, ("\n\n", "\n", ". ", " ", "")), (i, t)


def test_safe_sentences(spark):
    t = "See Fig. 3 and e.g. this one of Dr. Smith et al. in the text. It works well here now.\nNo end here (ok sure it is.)\nlower start goes on and on"
    got = by_doc(seg.split_sentences_safe(docs(spark, t), 3), "sentence", "sent_no")[0]
    assert got == ["See Fig. 3 and e.g. this one of Dr. Smith et al. in the text.", "It works well here now.", "No end here (ok sure it is.)"]


def test_overmerged(spark):
    long_line = "This is a long first line of a paragraph that goes on for a while"
    t1 = f"Title\nShort author\nReal sentence begins here and is long enough\nand ends."
    df = seg.repair_overmerged(docs(spark, t1, f"{long_line}\nThe next line follows a long one and stays where it is", "one line"))
    got = [r.text for r in df.orderBy("doc_id").collect()]
    assert got == ["Real sentence begins here and is long enough and ends.", f"{long_line} The next line follows a long one and stays where it is", "one line"]


CORPUS = """Intro text here [12] and [3], [12].

Fig. 1 | A caption (a) left panel shows it (b) right panel shows that
second line

Supplementary Fig. 2: more
text after

References
1. First entry
wraps here
2) Second entry
3. Third entry
Supplementary notes
tail"""


def test_captions_panels(spark):
    out = seg.extract_captions(docs(spark, CORPUS))
    rows = sorted(seg.caption_rows(out).collect(), key=lambda r: r.caption_no)
    assert [(r.label, r.body.split("\n")[0]) for r in rows] == [("Fig. 1", "| A caption (a) left panel shows it (b) right panel shows that"), ("Supplementary Fig. 2:", "more")]
    assert "caption" not in out.first().text and "tail" in out.first().text
    p = seg.split_panels(docs(spark, "whole figure text (a) left panel shows it (b) right panel (c) no")).collect()
    assert [(r.label, r.panel) for r in sorted(p, key=lambda r: r.panel_no)] == [("part1", "whole figure text"), ("a", "a) left panel shows it"), ("b", "b) right panel")]


def test_reference_blocks(spark):
    r = seg.find_reference_block(docs(spark, CORPUS, "References\nno numbers\nat all")).orderBy("doc_id").collect()
    assert CORPUS[r[0].block_start:r[0].block_end] == "References\n1. First entry\nwraps here\n2) Second entry\n3. Third entry\n"
    assert r[1].block_start is None and r[1].block_end is None
    refs = seg.parse_numbered_refs(docs(spark, "junk\n1. a\nb\n2) c\n1. again")).collect()
    assert {x.num: x.ref for x in refs} == {1: "again", 2: "c"}
    s = seg.split_references(docs(spark, "body\nReferences\n1. a", "0123456789")).orderBy("doc_id").collect()
    assert [(x.body, x.refs) for x in s] == [("body\nReferences\n", "1. a"), ("01234567", "89")]


def test_citations_figures(spark):
    assert seg.bracket_citations(docs(spark, CORPUS)).first().citations == [3, 12]
    assert seg.figure_tokens(docs(spark, "Fig. 3a, figure 2, Supplementary Fig. 1 and Supp Fig 4")).first().figures == [
        "Figure 1", "Figure 2", "Figure 3a", "Figure 4", "Supplementary Figure 1", "Supplementary Figure 4"]


def test_exercises(spark):
    t = "Intro text\n1. Calculer x\n2. Montrer y\n1. Autre exercice 2. Fin"
    rows = sorted(seg.split_exercises(docs(spark, t), "A").collect(), key=lambda r: (r.grp, r.item_no))
    assert [(r.grp, r.item_no, r.placement, r.item) for r in rows] == [
        (1, 0, None, "Intro text"), (1, 1, 1, "1. Calculer x"), (1, 2, 2, "2. Montrer y"), (2, 1, 1, "1. Autre exercice"), (2, 2, 2, "2. Fin")]


def test_json(spark):
    raws = ['```json\n{"a": 1}\n```', 'text {"a": 2} more', "[1, 2]", '{"a": "x\ny"}', '{"a": 3} trailing } brace', "", None, "no json"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "id long, raw string")
    got = [r.json for r in seg.extract_json(df).orderBy("id").collect()]
    assert got[0] == '{"a": 1}' and got[1] == '{"a": 2}' and got[2] is None and got[3] == '{"a": "x\\ny"}' and got[4] == '{"a": 3}' and got[5:] == [None, None, None]
    items = seg.extract_json_items(spark.createDataFrame([('a [1, {"b": 2}] {"c": 3} [bad',)], "raw string")).first()["items"]
    assert items == ["1", '{"b": 2}', '{"c": 3}']
    flat = seg.flatten_variant(spark.createDataFrame([('[{"a": 1, "b": [{"c": 2}, "d"]}, "e"]',)], "raw string"), "raw").first()["lines"]
    assert flat == "a: 1\nb: c: 2\nd\ne"


def test_plan_blocks(spark):
    t = "===SLIDE_GROUP: One | Slides 1–2===\nPURPOSE: p\nCONTENT_SCOPE: s\nKEY_TRANSITIONS: go on\nKEY_TERMS: a, b\nSlide 1: first\nSlide 2: second\nInclude: Figure 1\nTransition: next\n[SupMat] note\n===SLIDE_GROUP: Two | Slides 4-5===\nPURPOSE: q"
    rows = sorted(seg.parse_plan_blocks(seg.split_plan_blocks(docs(spark, t))).collect(), key=lambda r: r.block_no)
    assert [(r.group_name, r.slide_from, r.slide_to, r.purpose) for r in rows] == [("One", 1, 2, "p"), ("Two", 4, 5, "q")]
    assert rows[0].key_terms == ["a", "b"] and [(s.slide_id, s.plan) for s in rows[0].slides] == [(1, "first"), (2, "second")]
    assert rows[0].available_figures == ["Figure 1"] and rows[0].supmat_notes == "note" and rows[0].transition == "next"


def test_doi_and_candidates(spark):
    d = seg.extract_doi(docs(spark, "see doi:10.1103/PhysRev.1 x", "none")).orderBy("doc_id").collect()
    assert [(r.doi, r.prefix) for r in d] == [("10.1103/PhysRev.1", "10.1103"), (None, None)]
    assert [r.v for r in docs(spark, " https://doi.org/10.1/a", "DOI: 10.2/b").select("doc_id", seg.normalize_doi("text").alias("v")).orderBy("doc_id").collect()] == ["10.1/a", "10.2/b"]
    p = spark.createDataFrame([(1, "10.1038/abc", ["https://arxiv.org/abs/2301.01234v2"], None, "PLOS"), (2, None, None, "https://x", None)],
                              "paper_id long, doi string, links array<string>, url string, publisher string")
    rows = by_doc(seg.pdf_candidates(p).withColumnRenamed("paper_id", "doc_id"), "pdf_url", "cand_rank")
    assert rows[1][:2] == ["https://arxiv.org/abs/2301.01234v2", "https://arxiv.org/pdf/2301.01234v2.pdf"]
    assert "https://www.nature.com/articles/abc.pdf" in rows[1] and rows[2] == ["https://x"] and len(set(rows[1])) == len(rows[1])


def test_tagged_lines(spark):
    df = spark.createDataFrame([("1) [MAIN] a\n- [fig] b\nc",), ("x\n\ny",)], "raw string")
    assert [r["lines"] for r in seg.tagged_lines(df, ["MAIN", "FIG"]).collect()] == [["[MAIN] a", "[fig] b"], ["x", "y"]]


def test_absurd_numbers_do_not_stop_a_job(spark):
    big = "9" * 30
    t = f"===SLIDE_GROUP: One | Slides {big}-{big}===\nSlide {big}: x"
    r = seg.parse_plan_blocks(seg.split_plan_blocks(docs(spark, t))).first()
    assert r.slide_from is None and r.slides[0].slide_id is None
    assert seg.split_exercises(docs(spark, f"a {big}. Bcd"), "A").filter("item_no = 1").first().placement is None
    assert seg.find_reference_block(docs(spark, f"References\n{big}. a\n2. b\n3. c")).first().block_start == 0


def packed_blocks(blocks, size, overlap):
    """C-08 by its definition: texts that grow until the next block would not fit, with the tail of the chunk before."""
    chunks, text, figs, title, carry = [], "", set(), None, ""
    tail = lambda t: t[-overlap:] if overlap else ""
    lead = lambda: carry if chunks else ""

    def close():
        nonlocal text, figs, title, carry
        if text.strip():
            used = sorted(figs)
            note = "\nFigures used in this chunk: " + ", ".join(used) if used else ""
            chunks.append(((lead() + text.rstrip() + note).strip(), used, title))
            carry, text, figs, title = tail(text.strip()), "", set(), None

    for kind, body, own in blocks:
        own = sorted(set(own or []))
        if kind == "head" and not body:
            continue
        if kind != "head" and len(body) > size:
            close()
            at = 0
            while at < len(body):
                part = body[at:at + size]
                if at + size < len(body) and part.rfind(" ") > 100:
                    part = part[:part.rfind(" ")]
                note = "\n\nFigures used in this chunk: " + ", ".join(own) + "\n" if own else ""
                chunks.append((lead() + part.strip() + note, own, title))
                carry, at = tail(part.strip()), at + len(part)
            continue
        if text and len(text) + len(body) + (2 if kind == "head" else 1) > size:
            close()
        text += ("\n" if text and kind == "head" else "") + body + "\n"
        if kind == "head":
            title = body
        else:
            figs |= set(own)
    close()
    return chunks


def test_pack_blocks_against_brute_force(spark):
    rng = random.Random(9)
    kinds = ["head", "p", "p", "formula"]
    cases = []
    for k in range(60):
        blocks = [(rng.choice(kinds), " ".join("x" * rng.randint(1, 9) for _ in range(rng.choice([0, 3, 20, 120]))), rng.choice([None, [], ["f2", "f1", "f2"]]))
                  for _ in range(rng.randint(0, 9))]
        cases.append((k, blocks))
    df = spark.createDataFrame(cases, "doc_id long, blocks array<struct<kind:string,text:string,figures:array<string>>>")
    for size, overlap in ((150, 0), (60, 7), (300, 20)):
        got = {k: [] for k, _ in cases}
        for r in sorted(seg.pack_blocks(df, size, overlap).collect(), key=lambda r: (r.doc_id, r.chunk_no)):
            got[r.doc_id].append((r.text, r.figures, r.section_title))
        for k, blocks in cases:
            assert got[k] == packed_blocks(blocks, size, overlap), (k, size)
