"""Scans and sinks on small files and a hand-written TEI document."""

from pyspark.sql import functions as F

from scriptorium.operators import report, segment
from scriptorium.plans.source_queries import deck_tables
from scriptorium.plans.registry import Tables
from scriptorium.sources import files, plan, tei

TEI = """<?xml version="1.0" encoding="UTF-8"?>
<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>Running title</title></titleStmt>
<sourceDesc><biblStruct><analytic><title level="a" type="main">Main <hi>title</hi></title>
<author><persName><forename type="first">Ann</forename><forename type="middle">B</forename><surname>Lee</surname></persName></author>
<author><persName><surname>May</surname></persName></author></analytic></biblStruct></sourceDesc></fileDesc>
<profileDesc><abstract><p>First part.</p><p>Second part.</p></abstract></profileDesc></teiHeader>
<text><body>
<div><head>Introduction</head><p>The laser emits a narrow line <ref type="bibr" target="#b1">[2]</ref>. The sentence that</p>
<p>spans two paragraphs ends here. See Fig. 3 for the whole setup of it all.</p>
<formula xml:id="formula_0">g(2) = 1 + exp(-t)<label>(1)</label></formula></div>
<div><p>Results are shown in <ref type="figure" target="#fig_0">1(a)</ref> with care. Too short.</p>
<figure xml:id="fig_0"><head>Fig. 1</head><figDesc>Setup of <hi>it</hi>.</figDesc></figure>
<figure><head>Fig. 2</head><figDesc>Second.</figDesc></figure><formula>tiny</formula></div></body>
<back><div type="annex"><head>Supplementary Material</head><p>Extra text of the supplement part.</p></div>
<div type="references"><listBibl>
<biblStruct xml:id="b0"><analytic><title level="a" type="main">First work</title><author><persName><forename type="first">Al</forename><surname>Poe</surname></persName></author></analytic>
<monogr><title level="j">Journal A</title><imprint><date type="published" when="1999">in 1999</date></imprint></monogr><idno type="DOI">10.1/a</idno></biblStruct>
<biblStruct xml:id="b1"><monogr><title>Book B</title><imprint><date>2001</date><publisher>P</publisher></imprint></monogr></biblStruct>
<biblStruct xml:id="b2"><monogr/></biblStruct></listBibl></div></back></text></TEI>"""


def docs(spark):
    return spark.createDataFrame([(1, TEI), (2, "<broken"), (3, "<TEI><text/></TEI>")], "doc_id long, tei string")


def test_tei_header_and_references(spark):
    m = {r.doc_id: r for r in tei.tei_metadata(docs(spark).filter("doc_id <> 2")).collect()}
    assert (m[1].title, m[1].authors, m[1].abstract) == ("Main title", ["Ann Lee", "May"], "First part. Second part.")
    assert m[3].title == "" and m[3].authors == []
    refs = sorted(tei.tei_references(docs(spark)).collect(), key=lambda r: r.ref_no)
    assert [(r.bib_id, r.title, r.authors, r.journal, r.year, r.idnos) for r in refs] == [
        ("b0", "First work", ["Al Poe"], "Journal A", "1999", ["DOI:10.1/a"]), ("b1", "Book B", [], "", "2001", []), ("b2", "", [], "", "", [])]
    real = report.has_real_references(tei.tei_references(docs(spark)).withColumn("authors", F.array_join("authors", ",")))
    assert real.first().n_real == 2 and not real.first().has_real


def test_tei_body(spark):
    n = tei.tei_nodes(docs(spark)).cache()
    assert {r.doc_id for r in n.collect()} == {1}
    secs = [(r.title, r.n_paras) for r in tei.tei_sections(n).orderBy("div").collect()]
    assert secs == [("Introduction", 2), ("Untitled Section", 1)]
    assert [(r.title, r.text) for r in tei.tei_sections(n, "supplement").collect()] == [("Supplementary Material", "Extra text of the supplement part.")]
    assert [(r.fig_id, r.title, r.caption) for r in tei.tei_figures(n).orderBy("fig_no").collect()] == [("fig_0", "Fig. 1", "Setup of it ."), ("fig_2", "Fig. 2", "Second.")]
    s = [(r.num, r.meta, r.text) for r in tei.tei_sentences(n).orderBy("num").collect()]
    assert [x[:2] for x in s] == [(1, "DIV01PARA01"), (2, "DIV01PARA02"), (3, "DIV01PARA02"), (4, "DIV02PARA01")]
    assert s[1][2] == "The sentence that spans two paragraphs ends here." and s[2][2] == "See Fig. 3 for the whole setup of it all."
    f = tei.tei_formulas(n).collect()
    assert [(r.xml_id, r.label, r.formula_text) for r in f] == [("formula_0", "(1)", "g(2) = 1 + exp(-t)")]
    assert f[0].anchor == "spans two paragraphs ends here See Fig 3 for the whole setup of it all"[-len(f[0].anchor):] and len(f[0].anchor.split()) == 12
    b = tei.split_at_boundary(tei.supp_boundary(n)).first()
    assert b.supp.startswith("Supplementary Material\nExtra text") and b.main.endswith("tiny")
    chunks = segment.pack_blocks(segment.collect_blocks(tei.tei_blocks(n), "doc_id", "seq")).collect()
    assert len(chunks) == 1 and chunks[0].figures == ["fig_0: 1(a)"] and "Formula (1): g(2) = 1 + exp(-t)" in chunks[0].text
    sents, marks = tei.citation_marks(n)
    from scriptorium.operators.link import link_citations

    got = link_citations(marks, sents).join(sents, ["doc_id", "sent_no"]).collect()
    assert {(r.bib_id, r.sentence.split()[0]) for r in got} == {("b1", "The")}


def test_paragraph_markers(spark):
    p = ('See <ref type="bibr" target="#b3">[3]</ref> and <ref target="#fig_1" type="figure">3(a)</ref>, <ref type="figure">Figure 4</ref> or <ref type="figure">here</ref>.')
    r = segment.normalize_refs(spark.createDataFrame([(p,)], "text string")).first()
    assert r.text == "See and (fig fig_1: 3(a)), (fig 4: Figure 4) or (fig unknown: here)." and r.figures == ["4: Figure 4", "fig_1: 3(a)", "unknown: here"]


def test_text_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for n in (1, 2, 10):
        (tmp_path / "deep" / f"art_chunk{n:03d}.txt").write_text(f"line\nof {n}", encoding="utf-8")
    (tmp_path / "other.md").write_text("x")
    corpus = files.read_text_corpus(spark, str(tmp_path))
    assert corpus.count() == 3 and {r.text for r in corpus.collect()} == {f"line\nof {n}" for n in (1, 2, 10)}
    assert [(r.article, r.chunk_no) for r in files.read_chunks(spark, str(tmp_path)).orderBy("chunk_no").collect()] == [("art", 1), ("art", 2), ("art", 10)]


def test_bibliography_and_notions(spark):
    dash = "-" * 50
    t = f"ID: b0\nTitle: One\nAuthors: A\nYear: 1999\nIDNOS:\n - DOI:10.1/x\n{dash}\n\nTitle: Two\n{dash}\nID: b1\nAuthors: no title\n{dash}\nID: b2\nTitle: Three\nYear: UNKNOWN\n{dash}\nID: b2\nTitle: Three again"
    got = {r.bib_id: (r.title, r.year, r.idnos) for r in files.read_bibliography(spark.createDataFrame([(1, t)], "doc_id int, text string")).collect()}
    # The block without an id continues b0, and the last block of an id wins.
    assert got == {"b0": ("Two", None, []), "b2": ("Three again", None, [])}
    n = spark.createDataFrame([(1, "Notions:\nlaser\n\n beam "), (2, "# x\nlaser"), (3, "laser\nbeam")], "doc_id int, text string")
    flat = lambda h: sorted((r.doc_id, r.notion, r.line) for r in files.read_notions(n, h).collect())
    assert flat("conditional") == [(1, "beam", 4), (1, "laser", 2), (2, "laser", 2), (3, "beam", 2), (3, "laser", 1)]
    assert flat("always") == [(1, "beam", 4), (1, "laser", 2), (2, "laser", 2), (3, "beam", 2)]


def test_papers_csv_and_sinks(spark, tmp_path):
    (tmp_path / "p.csv").write_text('Notion,TITLE,Year \nlaser,"A, ""quoted"" title",2001\nlaser,,2002\nbeam,B,\n', encoding="utf-8")
    p = files.read_papers(spark, str(tmp_path / "p.csv"))
    assert sorted((r.notion, r.title, r.year, r.doi) for r in p.collect()) == [("beam", "B", None, None), ("laser", 'A, "quoted" title', "2001", None)]
    refs = spark.createDataFrame([("n", 1, "b1", "t", "a", "j", "1999"), ("n", 1, "b2", "t", "a", "j", "UNKNOWN"), ("n", 1, "b3", "t", "a", "j", "2005"), ("a", 2, "b4", "t", "a", "j", "1990")],
                                 ", ".join(f"{c} {'int' if c.startswith('line') else 'string'}" for c in files.REFERENCE_COLUMNS))
    files.write_references(refs, str(tmp_path / "out"))
    text = "".join(f.read_text() for f in sorted((tmp_path / "out").glob("part-*.csv"))).split("\n")
    assert [x.split(",")[2] for x in text if x and not x.startswith("notion")] == ["b4", "b3", "b1", "b2"]
    c = spark.createDataFrame([("main", "art", 1, "t", ["f"]), ("sup", "art", 1, "u", [])], "kind string, article string, chunk_no int, text string, figures array<string>")
    files.write_chunks(c, str(tmp_path / "chunks"))
    back = spark.read.parquet(str(tmp_path / "chunks"))
    assert back.filter("kind = 'sup'").first().text == "u" and (tmp_path / "chunks" / "kind=main").is_dir()


def test_plan_files(spark, tmp_path):
    t = deck_tables(Tables(spark, "/root/testdata/sf0.001"))
    plan.write_plan(t, str(tmp_path / "plans"))
    raw = spark.read.text(str(tmp_path / "plans"))
    back = plan.plan_tables(plan.parse_plans(raw.select(F.md5("value").alias("deck_id"), F.col("value").alias("raw"))))
    for name in ("groups", "slides", "candidates", "bullets"):
        assert back[name].count() == t[name].count(), name
    line = raw.first().value
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "talk.json").write_text(line, encoding="utf-8")
    assert plan.plan_tables(plan.read_plan_files(spark, str(tmp_path / "one")))["slides"].first().deck_id == "talk"
    (tmp_path / "one" / "deck.json").write_text('{"slides": [{"slide_uid": "A::Slide_1", "title": "t", "on_slide_bullets": ["b"], "reminders": []}]}')
    d = plan.read_deck(spark, str(tmp_path / "one" / "deck.json")).first()
    assert (d.deck_id, d.idx, d.slide_uid, d.on_slide_bullets) == ("deck", 0, "A::Slide_1", ["b"])


def test_links(spark):
    html = "<a href='a.pdf'>x</a> <a href=\"/b.pdf?x=1\">y</a> <a href=\"//h.org/c\">z</a> <a href=\"https://q.org/d.PDF\">w</a> <a href=\"../e/f\">v</a> <a href=\"#top\">u</a>"
    df = spark.createDataFrame([(1, "https://site.org/dir/page.html?q=2", html)], "page_id long, url string, html string")
    got = [r.target for r in files.scan_links(df).orderBy("link_no").collect()]
    assert got == ["https://site.org/dir/a.pdf", "https://site.org/b.pdf?x=1", "https://h.org/c", "https://q.org/d.PDF", "https://site.org/e/f", "https://site.org/dir/page.html?q=2#top"]
    assert [r.href for r in files.scan_links(df, "pdf").orderBy("link_no").collect()] == ["a.pdf", "/b.pdf?x=1", "https://q.org/d.PDF"]


def test_sentence_stream(spark):
    t = "SENTENCE 001 DIV01PARA02 ::: First one. ////\n\nSENTENCE12;fig003 ::: # Original label: Fig 1 | caption text ////\nbad record ////\nSENTENCE 3 #x ::: two\nlines ////"
    r = files.parse_sentence_stream(spark.createDataFrame([(1, t)], "pair_id int, text string")).orderBy("rec").collect()
    assert [(x.ok, x.num, x.fig, x.div, x.para, x.text) for x in r] == [
        (True, 1, None, "DIV01", "PARA02", "First one."), (True, 12, "FIG003", None, None, "caption text"), (False, None, None, None, None, ""), (True, 3, None, None, None, "two lines")]


def test_tei_that_is_not_well_formed(spark):
    bare = TEI.replace("First part.", "Salt & pepper &amp; R&D.")
    cut = TEI[:TEI.index("Extra text of the supplement") + 10]
    crossed = TEI.replace("</p></div>", "</q></div>", 1)
    df = spark.createDataFrame([(1, TEI), (2, bare), (3, cut), (4, crossed), (5, "no xml"), (6, None)], "doc_id long, tei string")
    whole = df.filter("doc_id = 1")
    count = {r.doc_id: r["count"] for r in tei.tei_nodes(df).groupBy("doc_id").count().collect()}
    assert count[1] == count[2] and 0 < count[3] < count[1] and 0 < count[4] < count[1] and set(count) == {1, 2, 3, 4}
    last = tei.tei_nodes(df.filter("doc_id = 3")).orderBy(F.desc("seq")).first()
    assert last.text.endswith("Extra text")
    rejects = {r.doc_id: r for r in tei.tei_rejects(df).collect()}
    assert set(rejects) == {2, 3, 4, 5, 6} and all(r.reason for r in rejects.values())
    assert [rejects[i].n_nodes for i in (2, 3, 4, 5, 6)] == [count[2], count[3], count[4], 0, 0]
    assert "Salt & pepper & R&D." in tei.tei_metadata(df.filter("doc_id = 2")).first().abstract
    assert tei.tei_references(df.filter("doc_id = 2")).count() == tei.tei_references(whole).count()


def test_tei_nodes_leave_in_small_batches(spark):
    import pyarrow as pa

    texts = [None, "<broken", *[TEI] * 400]
    b = pa.RecordBatch.from_arrays([pa.array([f"k{i}" for i in range(402)]), pa.array(texts)], ["doc_id", "tei"])
    own = len(tei._flatten(TEI))
    out = list(tei._node_batches(iter([b])))
    assert max(x.num_rows for x in out) < tei.FLUSH_NODES + own and len(out) > 2
    keys = [k for x in out for k in x.column(0).to_pylist()]
    assert keys == [f"k{i}" for i in range(2, 402) for _ in range(own)]
    big = spark.createDataFrame([(f"k{i}", t) for i, t in enumerate(texts)], "doc_id string, tei string").coalesce(1)
    n = tei.tei_nodes(big)
    assert dict(n.dtypes)["doc_id"] == "string" and n.groupBy("doc_id").count().filter(f"count = {own}").count() == 400
