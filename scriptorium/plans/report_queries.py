"""Report queries (E), set queries (H) and the flagship corpus report."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import text as tx
from scriptorium.operators import clean, report, segment, sets
from scriptorium.plans import derive
from scriptorium.plans import sqltext as q
from scriptorium.plans.clean_queries import AUTHOR, AXIS, JUNK, METADATA
from scriptorium.plans.registry import query
from scriptorium.plans.segment_queries import notion_packed, parsed_plans

LINES = f"(SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) - 1 AS pos FROM (SELECT doc_id, {q.lines('text')} AS ls FROM documents))"


VALID = rf"{q.n_words(q.strip('z'))} >= 3 AND regexp_matches({q.strip('z')}, '[.!?][)\]\"''}}›»]*$')"
NORMAL = r"regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')"


@query("corpus_chunk_stats", f"""
WITH n AS (SELECT doc_id, lang, {NORMAL} AS text FROM documents),
k AS (SELECT doc_id, lang, {q.keep_lines('text', f'NOT {AXIS} AND NOT {METADATA} AND NOT {AUTHOR} AND NOT {JUNK}')} AS text FROM n),
src AS (SELECT doc_id, lang, array_to_string([z FOR z IN {q.marked_sentences('text')} IF {VALID}], ' ') AS text FROM k),
p AS {notion_packed(3500, "('' || '')")}, c AS (SELECT lang, unnest(chunks) AS chunk FROM p)
SELECT lang, count(*) AS n, sum(length(chunk))::BIGINT AS chars, (sum(length(chunk)) // count(*))::BIGINT AS mean_len FROM c GROUP BY 1""")
def corpus_chunk_stats(t):
    """Clean every document, keep proper sentences, pack them into chunks, report per language."""
    d = clean.normalize_ws(t.documents.select("doc_id", "lang", "text"))
    d = clean.drop_lines(d, [clean.is_axis_line, clean.is_metadata_line, clean.is_author_line, clean.is_short_junk])
    kept = F.filter(tx.split_sentences("text"), lambda s: tx.is_valid_sentence(tx.strip(s), 3))
    chunks = segment.pack_sentences(d.withColumn("text", F.array_join(kept, " ")), 3500)
    return report.length_stats(chunks, "chunk", ["lang"])


@query("corpus_clean_lines", f"""
SELECT lang, count(*) AS n_lines, sum(length(l))::BIGINT AS n_chars FROM documents JOIN {LINES} USING (doc_id)
WHERE NOT {AXIS} AND NOT {METADATA} AND NOT {AUTHOR} AND NOT {JUNK} GROUP BY 1""")
def corpus_clean_lines(t):
    d = t.documents.select("lang", "text")
    bad = lambda x: clean.is_axis_line(x) | clean.is_metadata_line(x) | clean.is_author_line(x) | clean.is_short_junk(x)
    kept = d.select("lang", F.explode(F.filter(tx.lines("text"), lambda x: ~bad(x))).alias("l"))
    return kept.groupBy("lang").agg(F.count("*").alias("n_lines"), F.sum(F.length("l").cast("long")).alias("n_chars"))


def token_chunks(t):
    """A chunk per line; its figures are the line's words that start with a capital."""
    d = t.documents.select("doc_id", F.posexplode(tx.lines("text")).alias("p", "l"))
    return d.select("doc_id", (F.col("p") + 1).alias("chunk_no"), F.filter(tx.words("l"), lambda w: w.rlike("^[A-Z]")).alias("figures"))


CAPS = f"(SELECT DISTINCT doc_id, pos + 1 AS chunk_no, unnest([w FOR w IN {q.words('l')} IF regexp_matches(w, '^[A-Z]')]) AS figure FROM {LINES})"


@query("e01_figure_index", f"SELECT doc_id, figure, array_to_string([lpad(x::VARCHAR, 3, '0') FOR x IN list_sort(list(chunk_no))], ', ') AS chunks FROM {CAPS} GROUP BY ALL")
def e01(t):
    return report.figure_index_lists(token_chunks(t))


@query("e02_count_by_source", f"""
SELECT CASE WHEN {q.strip('s')} = '' THEN 'UNKNOWN' ELSE upper({q.strip('s')}) END AS source, count(*) AS n FROM (
  SELECT CASE WHEN doc_id % 10 = 0 THEN NULL WHEN doc_id % 10 = 1 THEN ' ' ELSE source || ' ' END AS s FROM documents) WHERE s IS NOT NULL GROUP BY 1
UNION ALL SELECT 'NULLS', 0 WHERE false""".replace("CASE WHEN " + q.strip("s") + " = ''", "CASE WHEN coalesce(" + q.strip("s") + ", '') = ''").replace("WHERE s IS NOT NULL GROUP BY 1", "GROUP BY 1"))
def e02(t):
    s = F.when(F.col("doc_id") % 10 == 0, F.lit(None)).when(F.col("doc_id") % 10 == 1, " ").otherwise(F.concat("source", F.lit(" ")))
    return report.count_by_source(t.documents.select(s.alias("source")))


@query("e02_slice_by_source", "SELECT doc_id, source FROM documents WHERE source = 'src3'")
def e02b(t):
    return report.slice_by_source(t.documents.select("doc_id", "source"), " SRC3")


@query("e03_consensus", """
SELECT event_type || '/' || regexp_extract(props, '(\\d+)', 1) AS item, count(*) AS n, min(event_id) AS pos FROM events GROUP BY 1 HAVING count(*) >= 15""".replace("\\\\", "\\"))
def e03(t):
    e = t.events.select(F.concat("event_type", F.lit("/"), F.get_json_object("props", "$.k")).alias("item"), F.col("event_id").alias("pos"))
    return report.consensus(e, 15)


def _units(parts: str, min_len: int) -> str:
    return f"(SELECT doc_id, unnest([y FOR y IN [{q.squash('lower(z)')} FOR z IN {parts}] IF y <> '' AND length(y) >= {min_len}]) AS unit FROM documents)"


SENTS = r"regexp_split_to_array(text, '[.!?]\s+')"


@query("e04_repetition_report", f"""
SELECT 'line' AS kind, unit, count(*) AS n_uses, min(doc_id) AS first_owner FROM {_units(q.lines('text'), 0)} GROUP BY unit HAVING count(*) >= 2
UNION ALL SELECT 'sentence', unit, count(*), min(doc_id) FROM {_units(SENTS, 40)} GROUP BY unit HAVING count(*) >= 2""")
def e04(t):
    d = t.documents.select("doc_id", "text")
    a = report.repetition_report(d).select(F.lit("line").alias("kind"), "*")
    return a.unionByName(report.repetition_report(d, unit="sentence", min_len=40).select(F.lit("sentence").alias("kind"), "*"))


@query("e04_repetition_owners", f"""
WITH u AS (SELECT unit, doc_id, count(*) AS n FROM {_units(SENTS, 40)} GROUP BY ALL), s AS (SELECT unit, sum(n)::BIGINT AS n_uses FROM u GROUP BY 1 HAVING sum(n) >= 2)
SELECT md5(unit) AS unit, doc_id, n, n_uses FROM u JOIN s USING (unit)""")
def e04b(t):
    out = report.repetition_owners(t.documents.select("doc_id", "text"), unit="sentence", min_len=40)
    return out.withColumn("unit", F.md5("unit"))


@query("e05_reused_figures", f"SELECT figure, count(*) AS n FROM {CAPS} GROUP BY 1 HAVING count(*) > 1")
def e05(t):
    return report.reused_figures(report.figure_index(token_chunks(t)))


@query("e07_run_summary", """
SELECT count(*) AS total, count_if(o_orderstatus = 'F')::BIGINT AS ok, count_if(o_orderstatus <> 'F')::BIGINT AS failed, 100.0::DOUBLE * count_if(o_orderstatus = 'F') / count(*) AS pct FROM orders""")
def e07(t):
    return report.run_summary(t.orders.select("o_orderstatus"), F.col("o_orderstatus") == "F")


@query("e08_papers_per_notion", "SELECT l_partkey AS notion, count(*) AS n FROM lineitem GROUP BY 1")
def e08(t):
    return report.papers_per_notion(t.lineitem.select(F.col("l_partkey").alias("notion")))


@query("e09_has_real_references", """
SELECT o_custkey AS doc_id, count_if(o_orderstatus = 'F' OR o_totalprice > 300000)::BIGINT AS n_real, count_if(o_orderstatus = 'F' OR o_totalprice > 300000) >= 3 AS has_real FROM orders GROUP BY 1""")
def e09(t):
    bib = t.orders.select(F.col("o_custkey").alias("doc_id"), F.when(F.col("o_orderstatus") == "F", "x").otherwise(" ").alias("title"),
                          F.when(F.col("o_totalprice") > 300000, F.col("o_totalprice")).alias("year"))
    return report.has_real_references(bib)


@query("e10_distinct_references", "SELECT DISTINCT p_name || ' ' || p_type AS ref FROM part")
def e10(t):
    return report.distinct_references(t.part.select(F.concat_ws(" ", "p_name", "p_type").alias("ref")))


@query("e11_length_stats", "SELECT lang, count(*) AS n, sum(length(text))::BIGINT AS chars, (sum(length(text)) // count(*))::BIGINT AS mean_len FROM documents GROUP BY 1")
def e11(t):
    return report.length_stats(t.documents, by=["lang"])


@query("e12_allocate_slots", """
WITH g AS (SELECT o_custkey AS k, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
s AS (SELECT *, 19 // n + CASE WHEN i < 19 % n THEN 1 ELSE 0 END AS slots FROM g)
SELECT k, i::INTEGER AS i, slots::BIGINT AS slots, (sum(slots) OVER (PARTITION BY k ORDER BY i) - slots + 1)::BIGINT AS slot_from, (sum(slots) OVER (PARTITION BY k ORDER BY i))::BIGINT AS slot_to FROM s""")
def e12(t):
    o = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("os"))
    return report.allocate_slots(o.select("k", F.posexplode("os").alias("i", "o")).drop("o"), 19, ["k"], "i")


@query("e13_roll_up", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1")
def e13(t):
    return report.roll_up(t.conversations, "conv_id", "turn")


@query("e14_figures_overview", """
WITH l AS (SELECT o_custkey, string_agg('Figure ' || o_orderkey || ': ' || o_orderpriority, chr(10) ORDER BY 'fig_' || o_orderkey) AS o FROM orders WHERE o_totalprice > 250000 GROUP BY 1)
SELECT c_custkey AS doc_id, coalesce(o, 'No figures.') AS overview FROM customer LEFT JOIN l ON c_custkey = o_custkey""")
def e14(t):
    """Customers are documents, their large orders figures: a cell holds one customer's orders at every scale."""
    figs = t.orders.filter(F.col("o_totalprice") > 250000).select(F.col("o_custkey").alias("doc_id"), F.concat(F.lit("fig_"), F.col("o_orderkey").cast("string")).alias("fig_id"),
                                                                  F.lit(None).cast("string").alias("label"), F.col("o_orderpriority").alias("summary"))
    return report.figures_overview(figs, t.customer.select(F.col("c_custkey").alias("doc_id")))


@query("e05_reused_plan_figures", f"""
SELECT i % 3 AS figure_no, count(*) AS n FROM (SELECT unnest(range(0, len({q.lines('text')}))) AS i FROM conversations) GROUP BY 1 HAVING count(*) > 1""")
def e05b(t):
    figs = parsed_plans(t).select(F.explode("available_figures").alias("f")).select(F.regexp_extract("f", "(\\d+)", 1).alias("figure"))
    return report.reused_figures(figs).select(F.col("figure").cast("long").alias("figure_no"), "n")


# --- set operations --------------------------------------------------------------------------


@query("h01_union_sources", """
SELECT 'customer' AS source, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer
UNION ALL SELECT 'supplier', s_name, s_acctbal, NULL FROM supplier""")
def h01(t):
    return sets.union_sources({
        "customer": t.customer.select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")),
        "supplier": t.supplier.select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))})


@query("h02_dedupe_evidence", f"""
SELECT lang, doc_id, text FROM (SELECT *, row_number() OVER (PARTITION BY lang, n ORDER BY doc_id) AS r FROM (
  SELECT lang, doc_id, text, lower({q.squash('text')}) AS n FROM documents) WHERE n <> '') WHERE r = 1""")
def h02(t):
    return sets.dedupe_evidence(t.documents.select("lang", "doc_id", "text"), ["lang"], ["doc_id"])


@query("h03_merge_fact_banks", f"""
WITH r AS (SELECT 0 AS bank_no, lang, doc_id, pos, '[MAIN] ' || l AS line FROM documents JOIN {LINES} USING (doc_id)
  UNION ALL SELECT 1, lang, doc_id, pos, '[FIG]  ' || l || ' ' FROM documents JOIN {LINES} USING (doc_id)),
b AS (SELECT *, {q.strip("substring(line, strpos(line, ']') + 1)")} AS body, left(line, strpos(line, ']')) AS tag FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY lang, lower({q.squash('body')}) ORDER BY bank_no, doc_id, pos) AS rn FROM b)
SELECT lang, bank_no, doc_id, pos::INTEGER AS pos, {q.strip("tag || ' ' || body")} AS fact FROM k WHERE rn = 1""")
def h03(t):
    d = t.documents.select("lang", "doc_id", F.posexplode(tx.lines("text")).alias("pos", "l"))
    a = d.select("lang", "doc_id", "pos", F.concat(F.lit("[MAIN] "), "l").alias("line"))
    b = d.select("lang", "doc_id", "pos", F.concat(F.lit("[FIG]  "), "l", F.lit(" ")).alias("line"))
    plain = d.select("lang", "doc_id", "pos", F.col("l").alias("line")).filter(~F.col("l").contains("]"))
    return sets.merge_fact_banks([a, b, plain], ["lang"], ["doc_id", "pos"]).drop("__h")


@query("h04_merge_edges", """
WITH e AS (SELECT user_id, event_id, event_id % 5 AS src, regexp_extract(props, '(\\d+)', 1)::BIGINT % 4 AS dst, CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS type FROM events),
d AS (SELECT user_id, src, dst, type, min(event_id) AS pos FROM e WHERE type <> '' AND src <> dst GROUP BY ALL)
SELECT user_id AS slide_uid, src, dst, type, 'x' AS label, row_number() OVER (PARTITION BY user_id ORDER BY pos)::INTEGER AS rank FROM d""".replace("\\\\", "\\"))
def h04(t):
    e = t.events.select(F.col("user_id").alias("slide_uid"), F.col("event_id").alias("pos"), (F.col("event_id") % 5).alias("src"),
                        (F.get_json_object("props", "$.k").cast("long") % 4).alias("dst"),
                        F.when(F.col("event_type") == "error", " ").otherwise(F.col("event_type")).alias("type"), F.lit(" x ").alias("label"))
    return sets.merge_edges(e)


@query("h05_first_seen", """
SELECT page_id, array_to_string([x FOR x, i IN hs IF list_position(hs, x) = i], ' ') AS hrefs FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS hs FROM pages)""")
def h05(t):
    p = t.pages.select("page_id", F.regexp_extract_all("html", F.lit("href=\"([^\"]+)\""), F.lit(1)).alias("hrefs"))
    return sets.first_seen(p, "hrefs").withColumn("hrefs", F.array_join("hrefs", " "))


@query("h06_add_missing_figures", f"""
WITH c AS (SELECT doc_id, trim(w, '.,') AS fig_id, min(l) AS caption FROM (SELECT doc_id, l, unnest({q.words('l')}) AS w FROM {LINES}) WHERE regexp_matches(w, '^[A-Z].*[.,]$') GROUP BY ALL)
SELECT c.doc_id, 1 AS chunk_no, fig_id, caption FROM c WHERE NOT EXISTS (SELECT 1 FROM {CAPS} k WHERE k.doc_id = c.doc_id AND k.figure = c.fig_id)""")
def h06(t):
    d = t.documents.select("doc_id", F.explode(tx.lines("text")).alias("l")).select("doc_id", "l", F.explode(tx.words("l")).alias("w"))
    caps = d.filter(F.col("w").rlike("^[A-Z].*[.,]$")).groupBy("doc_id", F.btrim("w", F.lit(".,")).alias("fig_id")).agg(F.min("l").alias("caption"))
    return sets.add_missing_figures(token_chunks(t), caps)


@query("h07_shift_boundary", f"""
WITH m AS (SELECT conv_id, turn, text, CASE WHEN turn >= 2 THEN 'sup' ELSE 'main' END AS kind FROM conversations),
p AS (SELECT conv_id, {q.lines('text')}[-1] AS para FROM conversations WHERE turn = 1),
s AS (SELECT DISTINCT conv_id FROM m WHERE kind = 'sup'),
h AS (SELECT conv_id, min(turn) AS hit, any_value(para) AS para FROM m JOIN p USING (conv_id) SEMI JOIN s USING (conv_id) WHERE kind = 'main' AND para <> '' AND contains(text, para) GROUP BY 1),
j AS (SELECT m.*, coalesce(kind = 'main' AND turn = hit AND strpos(text, para) > 1, false) AS cut, strpos(text, para) AS cutpos FROM m LEFT JOIN h USING (conv_id))
SELECT conv_id, kind, turn AS chunk_no, text FROM j WHERE NOT cut
UNION ALL SELECT conv_id, 'main', turn, {q.strip('left(text, cutpos - 1)')} FROM j WHERE cut UNION ALL SELECT conv_id, 'sup', 0, {q.strip('substring(text, cutpos)')} FROM j WHERE cut""")
def h07(t):
    c = t.conversations
    chunks = c.select("conv_id", F.when(F.col("turn") >= 2, "sup").otherwise("main").alias("kind"), F.col("turn").alias("chunk_no"), "text")
    paras = c.filter(F.col("turn") == 1).select("conv_id", F.element_at(tx.lines("text"), -1).alias("para"))
    return sets.shift_boundary(chunks, paras, "conv_id")
