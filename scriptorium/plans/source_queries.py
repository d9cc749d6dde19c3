"""Source and sink-shape queries (A) and boundary detection (C-16) over TEI derived from documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import text as tx
from scriptorium.operators import segment
from scriptorium.plans import derive
from scriptorium.plans import sqltext as q
from scriptorium.plans.registry import query
from scriptorium.plans.report_queries import LINES
from scriptorium.session import reuse
from scriptorium.sources import files, plan, tei


def nodes_of(documents):
    return tei.tei_nodes(derive.tei_documents(documents))


def nodes(t):
    return nodes_of(t.documents)


@query("a03_read_bibliography", """
SELECT c_custkey // 20 AS doc_id, 'b' || c_custkey AS bib_id, c_name AS title, c_mktsegment AS authors, CASE WHEN c_custkey % 2 = 0 THEN '1999' ELSE 'UNKNOWN' END AS year FROM customer WHERE c_custkey % 5 <> 0""")
def a03(t):
    b = t.customer.select(F.floor(F.col("c_custkey") / 20).alias("doc_id"), "c_custkey", F.concat(
        F.lit("ID: b"), F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.concat(F.lit("\nTitle: "), "c_name")),
        F.lit("\nAuthors: "), "c_mktsegment", F.lit("\nYear: "), F.when(F.col("c_custkey") % 2 == 0, "1999").otherwise("UNKNOWN"), F.lit("\nIDNOS:\n - None")).alias("b"))
    text = b.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "b"))), lambda x: x["b"]), "\n" + "-" * 50 + "\n\n").alias("text"))
    return files.read_bibliography(text).select("doc_id", "bib_id", "title", "authors", "year")


@query("a04_read_notions", f"""
SELECT 'always' AS header, doc_id, {q.strip('l')} AS notion, (pos + 1)::INTEGER AS line FROM {LINES} WHERE pos > 0 AND {q.strip('l')} <> ''
UNION ALL SELECT 'conditional', doc_id, {q.strip('l')}, (pos + 1)::INTEGER FROM {LINES} WHERE (pos > 0 OR doc_id % 2 = 1) AND {q.strip('l')} <> ''""")
def a04(t):
    d = t.documents.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("# "), "text")).otherwise(F.col("text")).alias("text"))
    out = [files.read_notions(d, h).select(F.lit(h).alias("header"), "doc_id", "notion", "line") for h in ("always", "conditional")]
    return out[0].unionByName(out[1])


XML = lambda x: q.squash(x)


@query("a06_tei_metadata", f"SELECT doc_id, {q.squash('ls[1]')} AS title, 'Ann ' || lang AS authors, source AS abstract FROM (SELECT *, {q.lines('text')} AS ls FROM documents)")
def a06(t):
    return tei.tei_metadata(derive.tei_documents(t.documents)).withColumn("authors", F.array_join("authors", ", "))


SECT = f"(SELECT doc_id, pos // 4 + 1 AS div, string_agg({q.squash('l')} || ' [x' || (doc_id % 5) || ']', chr(10) ORDER BY pos) FILTER (WHERE pos % 4 > 0) AS text, max({q.squash('l')}) FILTER (WHERE pos % 4 = 0) AS title, count(*) - 1 AS n FROM {LINES} GROUP BY ALL)"


@query("a07_tei_sections", f"""
SELECT 'body' AS kind, doc_id, div::INTEGER AS div, CASE WHEN title = '' THEN 'Untitled Section' ELSE title END AS title, text, n AS n_paras FROM {SECT} WHERE text IS NOT NULL
UNION ALL SELECT 'supplement', doc_id, div::INTEGER, title, text, n FROM {SECT} WHERE text IS NOT NULL AND div = 4""")
def a07(t):
    n = reuse(nodes(t))
    out = [tei.tei_sections(n, k).select(F.lit(k).alias("kind"), "doc_id", "div", "title", "text", "n_paras") for k in ("body", "supplement")]
    return out[0].unionByName(out[1])


@query("a08_tei_figures", f"""
SELECT doc_id, div::INTEGER AS fig_no, 'fig_' || CASE WHEN div % 2 = 1 THEN div - 1 ELSE div END AS fig_id, 'Fig. ' || (div - 1) AS title, {q.squash('left(l, 60)')} AS caption
FROM (SELECT doc_id, pos // 4 + 1 AS div, l FROM {LINES} WHERE pos % 4 = 0)""")
def a08(t):
    return tei.tei_figures(nodes(t))


@query("a09_tei_references", """
SELECT doc_id, k::INTEGER AS ref_no, 'b' || k AS bib_id, CASE WHEN k < 4 THEN 'Work ' || k || ' of ' || doc_id ELSE source END AS title, 'Ann S' || k AS authors, source AS journal, (1990 + k)::VARCHAR AS year, 'DOI:10.1103/' || doc_id || '.' || k AS idnos
FROM documents, (SELECT unnest([0, 1, 2, 3, 4]) AS k)""")
def a09(t):
    r = tei.tei_references(derive.tei_documents(t.documents))
    return r.select("doc_id", "ref_no", "bib_id", "title", F.array_join("authors", ",").alias("authors"), "journal", "year", F.array_join("idnos", ",").alias("idnos"))


@query("a10_tei_sentences")
def a10(t):
    return tei.tei_sentences(nodes(t))


@query("a11_tei_formulas", rf"""
WITH f AS (SELECT doc_id, unnest(range(0, greatest(1, (len(string_split(text, chr(10))) + 3) // 4))) AS i FROM documents),
p AS (SELECT f.doc_id, i, arg_max(l, pos) AS l FROM f JOIN {LINES} x ON x.doc_id = f.doc_id AND pos % 4 > 0 AND pos < 4 * (i + 1) GROUP BY ALL)
SELECT f.doc_id, f.i + 1 AS formula_no, 'formula_' || f.i AS xml_id, '(' || f.i || ')' AS label, 'alpha = beta + ' || f.i AS formula_text,
  coalesce(array_to_string(regexp_extract_all(l || ' x' || (f.doc_id % 5), '{q.WORD}+')[-12:], ' '), '') AS anchor FROM f LEFT JOIN p ON p.doc_id = f.doc_id AND p.i = f.i""")
def a11(t):
    return tei.tei_formulas(nodes(t)).select("doc_id", "formula_no", "xml_id", "label", "formula_text", "anchor")


def deck_tables(t):
    """25 customers in a row as a deck, their nations as groups, customers as slides with one candidate per order."""
    c = t.customer.select(F.floor(F.col("c_custkey") / 25).cast("string").alias("deck_id"), "c_custkey", F.col("c_nationkey").alias("group_index"), "c_name")
    c = c.join(t.nation.select(F.col("n_nationkey").alias("group_index"), F.col("n_name").alias("group_id")), "group_index")
    g = c.select("deck_id", "group_index", "group_id").distinct().select("*", F.col("group_id").alias("group_name"), *[F.lit(None).cast("string").alias(c) for c in ("purpose", "scope", "transition", "supmat_notes")],
                 F.array(F.lit("Figure 1")).alias("available_figures"))
    s = c.select("deck_id", "group_index", "group_id", F.col("group_id").alias("group_name"), F.concat("group_id", F.lit("::Slide_"), F.col("c_custkey").cast("string")).alias("slide_uid"),
                                        F.col("c_custkey").cast("int").alias("slide_id"), F.col("c_name").alias("plan"), F.lit("").alias("slide_context"), F.lit(None).cast("string").alias("figure_used"))
    o = t.orders.select(F.col("o_custkey").cast("int").alias("slide_id"), F.col("o_orderkey").cast("int").alias("pos"), F.concat(F.lit("BP_"), F.col("o_orderkey").cast("string")).alias("bullet_id"),
                        (F.col("o_orderkey") % 100 / 100.0).alias("priority"), F.lit("medium").alias("exclusivity"), F.col("o_orderpriority").alias("argument"))
    cand = s.join(o, "slide_id").select("deck_id", "group_id", "slide_uid", "pos", "bullet_id", "priority", "exclusivity", "argument")
    b = cand.select("deck_id", "pos", "bullet_id", F.col("argument").alias("bullet_text"))
    return {"groups": g, "slides": s, "candidates": cand, "bullets": b}


@query("a12_plan_round_trip", """
SELECT (c_custkey // 25)::VARCHAR AS deck_id, n_name AS group_id, n_name || '::Slide_' || c_custkey AS slide_uid, 'BP_' || o_orderkey AS bullet_id, (o_orderkey % 100) / 100.0::DOUBLE AS priority, o_orderpriority AS argument
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""".replace("(o_orderkey % 100) / 100.0::DOUBLE", "((o_orderkey % 100) / 100.0)::DOUBLE"))
def a12(t):
    """Write the nested plan (A-13), read it back (A-12), list its candidates."""
    back = plan.plan_tables(plan.parse_plans(plan.build_plan(deck_tables(t))))
    return back["candidates"].select("deck_id", "group_id", "slide_uid", "bullet_id", "priority", "argument")


@query("a13_build_plan_counts", """
SELECT (c_custkey // 25)::VARCHAR AS deck_id, count(DISTINCT c_nationkey)::INTEGER AS n_groups, count(*)::INTEGER AS n_slides FROM customer GROUP BY 1""")
def a13(t):
    p = plan.parse_plans(plan.build_plan(deck_tables(t)))
    return p.select("deck_id", F.size("plan.groups").alias("n_groups"), F.aggregate(
        "plan.groups", F.lit(0), lambda acc, g: acc + F.coalesce(F.array_size(g["slides"]), F.lit(0))).alias("n_slides"))


@query("a14_parse_sentence_stream", f"""
SELECT doc_id, (pos + 1)::BIGINT AS num, CASE WHEN pos % 2 = 0 THEN 'DIV01PARA' || lpad(pos::VARCHAR, 2, '0') ELSE ';FIG00' || (pos % 10) END AS meta,
  CASE WHEN pos % 2 = 1 THEN 'FIG00' || (pos % 10) END AS fig, {q.squash("replace(l, '////', '')")} AS text, true AS ok FROM {LINES}""")
def a14(t):
    rec = F.transform(tx.lines("text"), lambda x, i: F.concat(
        F.lit("SENTENCE "), (i + 1).cast("string"), F.when(i % 2 == 0, F.concat(F.lit(" DIV01PARA"), F.when(i < 100, F.lpad(i.cast("string"), 2, "0")).otherwise(F.left(i.cast("string"), F.lit(2)))))
        .otherwise(F.concat(F.lit(";FIG00"), (i % 10).cast("string"))), F.lit(" ::: "), F.replace(x, F.lit("////"), F.lit("")), F.lit(" ////\n")))
    d = t.documents.select("doc_id", F.array_join(rec, "").alias("text"))
    return files.parse_sentence_stream(d, "doc_id").select("doc_id", "num", "meta", "fig", "text", "ok")


@query("a15_scan_links", r"""
SELECT page_id, url, (p - 1)::INTEGER AS link_no, h AS href, CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN h WHEN starts_with(h, '//') THEN regexp_extract(url, '^([A-Za-z]+):', 1) || ':' || h
  WHEN starts_with(h, '/') THEN regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) || h ELSE 'relative' END AS target
FROM (SELECT page_id, url, unnest(hs) AS h, generate_subscripts(hs, 1) AS p FROM (SELECT page_id, url, regexp_extract_all(html, '(?i)href=[''"]([^''"]+)[''"]', 1) AS hs FROM pages))""")
def a15(t):
    return files.scan_links(t.pages)


@query("a15_scan_pdf_links", """
SELECT page_id, url, 0 AS link_no, 'doc_' || page_id || '.pdf?x=1' AS href, regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) || coalesce(nullif(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*(/([^?#]*/)?)', 1), ''), '/') || 'doc_' || page_id || '.pdf?x=1' AS target FROM pages""")
def a15b(t):
    p = t.pages.withColumn("html", F.concat("html", F.lit("<a HREF='doc_"), F.col("page_id").cast("string"), F.lit(".pdf?x=1'>pdf</a>")))
    return files.scan_links(p, "pdf")


@query("a16_chunk_table", "SELECT lang AS kind, doc_id, (i // 3800)::INTEGER AS chunk_no, substring(text, i::BIGINT + 1, 4000) AS text FROM (SELECT *, unnest(range(0, greatest(length(text) - 200, 1), 3800)) AS i FROM documents)")
def a16(t):
    """The rows ``write_chunks`` stores."""
    return segment.sliding_chunks(t.documents.select(F.col("lang").alias("kind"), "doc_id", "text"), 4000, 200).withColumnRenamed("chunk", "text")


@query("a17_sorted_references", "SELECT p_name AS notion, 'b' || p_partkey AS bib_id, p_type AS title, (1990 + p_size)::VARCHAR AS year FROM part")
def a17(t):
    return files.sorted_references(t.part.select(F.col("p_name").alias("notion"), F.concat(F.lit("b"), F.col("p_partkey").cast("string")).alias("bib_id"), F.col("p_type").alias("title"),
                                                (F.lit(1990) + F.col("p_size")).cast("string").alias("year")))


@query("a18_render_script", f"""
SELECT conv_id, '# Speaker Script' || chr(10) || chr(10) || string_agg('## ' || turn || ' — ' || role || chr(10) || chr(10) || '**On-slide bullets**' || chr(10) || '- ' || ls[1] || chr(10) || chr(10)
  || CASE WHEN text <> '' THEN '**Speaker notes**' || chr(10) || {q.strip('text')} || chr(10) || chr(10) ELSE '' END || '---' || chr(10), chr(10) ORDER BY turn) AS script FROM (SELECT *, {q.lines('text')} AS ls FROM conversations) GROUP BY 1""")
def a18(t):
    s = t.conversations.select("conv_id", "turn", F.col("turn").cast("string").alias("slide_uid"), F.col("role").alias("title"), F.array(derive.first_line()).alias("bullets"),
                               F.col("text").alias("speaker_notes"), F.lit(None).cast("string").alias("transition"))
    return files.render_script(s, "conv_id", "turn")


@query("a19_with_references", """
SELECT conv_id, turn, text || CASE WHEN conv_id IN (SELECT o_custkey FROM orders) THEN chr(10) || chr(10) || 'References:' || chr(10) || refs ELSE '' END AS text
FROM conversations LEFT JOIN (SELECT o_custkey, string_agg(o_orderkey::VARCHAR, chr(10) || chr(10) ORDER BY o_orderkey) AS refs FROM orders GROUP BY 1) ON conv_id = o_custkey""")
def a19(t):
    refs = t.orders.select(F.col("o_custkey").alias("conv_id"), F.col("o_orderkey").alias("ref_no"), F.col("o_orderkey").cast("string").alias("ref"))
    return files.with_references(t.conversations.select("conv_id", "turn", "text"), refs, "conv_id")


#: The lines of documents with a supplement: the annex opens as the document does; every third has a heading before it, every
#: third a paragraph behind the bibliography.
SUPP_LINES = f"""[CASE WHEN i = 13 THEN ls[1] WHEN i = 6 AND doc_id % 3 = 1 THEN 'Supplementary Methods' ELSE x END FOR x, i IN ls]"""
SUPP_HEAD = "|".join(segment.SUPPLEMENT_HEADINGS)


@query("c16_supp_boundary", rf"""
WITH d AS (SELECT doc_id, lang, source, {SUPP_LINES} AS ls FROM (SELECT *, {q.lines('text')} AS ls FROM documents)),
l AS (SELECT doc_id, unnest(ls) AS x, generate_subscripts(ls, 1) - 1 AS pos FROM d),
n AS (SELECT doc_id, 0 AS ord, {q.squash("coalesce(ls[1], '') || ' Ann ' || lang")} AS t FROM d UNION ALL SELECT doc_id, 1, source FROM d
  UNION ALL SELECT doc_id, 10 + pos // 4 * 10 + pos % 4, CASE WHEN pos % 4 = 0 THEN {q.squash('x')} ELSE {q.squash("x || '  [x' || (doc_id % 5) || ']'")} END FROM l
  UNION ALL SELECT doc_id, 14 + pos // 4 * 10, 'alpha = beta + ' || (pos // 4) || ' (' || (pos // 4) || ')' FROM l WHERE pos % 4 = 0
  UNION ALL SELECT doc_id, 15 + pos // 4 * 10, {q.squash('left(x, 60)')} FROM l WHERE pos % 4 = 0
  UNION ALL SELECT doc_id, 1000000 + k, CASE WHEN k < 4 THEN 'Work ' || k || ' of ' || doc_id || ' ' ELSE '' END || 'Ann S' || k || ' ' || source || ' 10.1103/' || doc_id || '.' || k FROM d, range(5) r(k)
  UNION ALL SELECT doc_id, 2000000, 'see: Fig. 1 of the whole work; ' || lang || '. End' FROM d WHERE doc_id % 3 = 2),
o AS (SELECT *, coalesce(sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM n WHERE t <> ''),
b AS (SELECT doc_id, string_agg(t, chr(10) ORDER BY ord) AS full_text,
    least(min(begins) FILTER (WHERE ord >= 40 AND ord < 1000000 AND n_lines > 12), min(begins) FILTER (WHERE {q.n_words('t')} <= 6 AND regexp_matches(t, '(?i)^(?:{SUPP_HEAD})\b')),
      min(begins) FILTER (WHERE ord = 2000000) + 5) AS boundary FROM o JOIN (SELECT doc_id, len(ls) AS n_lines FROM d) USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(boundary AS INTEGER) AS boundary, md5(CASE WHEN boundary IS NULL THEN full_text ELSE {q.strip('substr(full_text, 1, CAST(boundary AS BIGINT))')} END) AS main,
  md5(CASE WHEN boundary IS NULL THEN '' ELSE {q.strip('substr(full_text, CAST(boundary AS BIGINT) + 1)')} END) AS supp FROM b""")
def c16(t):
    """The fourth div is an annex whose heading repeats the first; some documents have a heading before it, some a paragraph after the references."""
    ls = F.transform(tx.lines("text"), lambda x, i: F.when(i == 12, derive.first_line()).when((i == 5) & (F.col("doc_id") % 3 == 1), "Supplementary Methods").otherwise(x))
    n = nodes_of(t.documents.withColumn("text", F.array_join(ls, "\n")))
    behind = t.documents.filter("doc_id % 3 = 2").select("doc_id", F.lit(1 << 30).alias("seq"), F.lit("p").alias("kind"), F.concat(
        F.lit("see: Fig. 1 of the whole work; "), "lang", F.lit(". End")).alias("text"))
    b = tei.supp_boundary(n.unionByName(behind, allowMissingColumns=True))
    return tei.split_at_boundary(b).select("doc_id", "boundary", F.md5("main").alias("main"), F.md5("supp").alias("supp"))


@query("tei_to_chunks")
def tei_to_chunks(t):
    """TEI to section-aware chunks with figure lists (A-07, C-23, C-08)."""
    blocks = segment.collect_blocks(tei.tei_blocks(nodes(t)), "doc_id", "seq")
    return segment.pack_blocks(blocks, 4000, 200).withColumn("figures", F.array_join("figures", ","))
