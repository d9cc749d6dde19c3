"""Join queries (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import similarity as sim
from scriptorium.functions import text as tx
from scriptorium.operators import link, segment
from scriptorium.plans import derive
from scriptorium.plans import sqltext as q
from scriptorium.plans.registry import query
from scriptorium.plans.report_queries import LINES
from scriptorium.session import reuse, spread
from scriptorium.sources import tei


def doc_sentences(t):
    return segment.split_sentences(t.documents.select("doc_id", "text"), "long").select(
        "doc_id", F.col("sent_no").cast("long").alias("num"), F.col("sentence").alias("text"))


def passage_pairs(t):
    """(item_id, doc_id) of benchmark passages found in documents, by shared ten-word windows."""
    return link.match_passages(t.benchmark, t.documents.select("doc_id", "text"))


def aligned(t):
    """Sentences of each found passage and of its document, keyed by the pair."""
    pairs = reuse(passage_pairs(t).select("item_id", "doc_id"))
    left = segment.split_sentences(t.benchmark, "trim").select("item_id", F.col("sent_no").cast("long").alias("num"), F.col("sentence").alias("text"))
    key = ["item_id", "doc_id"]
    left = left.join(pairs, "item_id").select(*key, "num", "text")
    right = doc_sentences(t).join(pairs, "doc_id").select(*key, "num", "text")
    return left, right, key


@query("d01_best_match")
def d01(t):
    left, right, key = aligned(t)
    return link.best_match(left, right, key)


@query("d01_best_near_name", """
SELECT p.p_brand, p.p_partkey AS num, o.right_num, round(2 * length(p_name) / (2 * length(p_name) + 1), 4) AS score
FROM part p JOIN (SELECT p_brand, p_name, min(p_partkey) AS right_num FROM part GROUP BY ALL) o USING (p_brand, p_name)""")
def d01b(t):
    """Every part name against the marked names of its brand: no other name can be as similar as its own with one character more."""
    left = t.part.select("p_brand", F.col("p_partkey").alias("num"), F.col("p_name").alias("text"))
    return link.best_match(left, left.withColumn("text", F.concat("text", F.lit("!"))), "p_brand")


@query("d02_resolve_claims")
def d02(t):
    left, right, key = aligned(t)
    return link.resolve_claims(left, reuse(link.best_match(left, right, key, 0.20)), key)


@query("d02_resolve_given_matches", """
WITH m AS (SELECT o_custkey AS k, o_orderkey AS num, o_custkey % 3 + (o_totalprice > 200000)::INTEGER AS right_num, (o_orderkey % 100) / 100.0 AS score FROM orders WHERE o_orderstatus <> 'P'),
w AS (SELECT *, row_number() OVER (PARTITION BY k, right_num ORDER BY score DESC, num) AS r FROM m)
SELECT o_custkey AS k, o_orderkey AS num, right_num, CASE WHEN r = 1 THEN score ELSE 0 END::DOUBLE AS score, CASE WHEN right_num IS NULL THEN 'not_found' WHEN r = 1 THEN 'match' ELSE 'rejected' END AS status
FROM orders LEFT JOIN w ON o_orderkey = num""")
def d02b(t):
    o = t.orders.withColumn("k", F.col("o_custkey")).withColumn("num", F.col("o_orderkey"))
    m = o.filter(F.col("o_orderstatus") != "P").select("k", "num", (F.col("o_custkey") % 3 + (F.col("o_totalprice") > 200000).cast("int")).alias("right_num"),
                                                      (F.col("num") % 100 / 100.0).alias("score"))
    return link.resolve_claims(o, m, "k")


@query("d03_sequence_diff")
def d03(t):
    """Each document against its successor's copy of it with every fifth sentence dropped and every seventh edited."""
    left = doc_sentences(t)
    right = left.filter(F.col("num") % 5 != 4).withColumn("text", F.when(
        F.col("num") % 7 == 3, F.concat(F.lit("changed opening words "), "text")).otherwise(F.col("text")))
    return link.sequence_diff(left, right, "doc_id").select("doc_id", "num", "right_num", "score", "char_diff", "kind")


@query("d03_missing_only", f"""
WITH s AS (SELECT doc_id, (p - 1)::BIGINT AS num, s AS text FROM (SELECT doc_id, unnest(x) AS s, generate_subscripts(x, 1) AS p FROM (
  SELECT doc_id, [{q.strip('z')} FOR z IN {q.marked_sentences('text')} IF {q.strip('z')} <> '' AND length(z) > 15] AS x FROM documents))),
r AS (SELECT doc_id, text, count(*) AS rc FROM s WHERE num % 5 <> 4 GROUP BY ALL),
k AS (SELECT doc_id, num, text, row_number() OVER (PARTITION BY doc_id, text ORDER BY num) AS occ FROM s)
SELECT doc_id, num, 'missing' AS kind FROM k LEFT JOIN r USING (doc_id, text) WHERE occ > coalesce(rc, 0)""")
def d03b(t):
    left = doc_sentences(t)
    return link.sequence_diff(left, left.filter(F.col("num") % 5 != 4), "doc_id").select("doc_id", "num", "kind")


@query("d03_near_copies", """
WITH r AS (SELECT *, 2.0 * length(name) / (2 * length(name) + length(note)) AS ratio FROM (
  SELECT *, p_name || ' / ' || p_name || ' / ' || p_name AS name, CASE p_partkey % 3 WHEN 0 THEN ' (an edited copy)' WHEN 1 THEN ' (new)' ELSE ' ' || repeat('0', 99) END AS note FROM part))
SELECT p_partkey AS id, 0::BIGINT AS num, CASE WHEN ratio > 0.7 THEN 1::BIGINT END AS right_num, CASE WHEN ratio > 0.7 THEN round(ratio, 6)::DOUBLE END AS score,
  CASE WHEN ratio > 0.7 THEN length(note)::INTEGER END AS char_diff, CASE WHEN ratio > 0.7 THEN 'possible_misplaced' ELSE 'missing' END AS kind
FROM r WHERE ratio <= 0.7 OR length(note) >= 15""")
def d03c(t):
    """A part's name against a copy with a long note, with a short one, or with far too much behind it; its brand is the same on both sides."""
    name = F.concat_ws(" / ", "p_name", "p_name", "p_name")
    note = F.when(F.col("p_partkey") % 3 == 0, " (an edited copy)").when(F.col("p_partkey") % 3 == 1, " (new)").otherwise(" " + "0" * 99)
    side = lambda num, name: t.part.select(F.col("p_partkey").alias("id"), F.explode(F.array(
        F.struct(F.lit(num).cast("long").alias("num"), name.alias("text")), F.struct(F.lit(7).cast("long").alias("num"), F.col("p_brand").alias("text")))).alias("s")).select("id", "s.*")
    return link.sequence_diff(side(0, name), side(1, F.concat(name, note)), "id").select("id", "num", "right_num", "score", "char_diff", "kind")


def part_notions(t):
    return t.part.groupBy(F.col("p_name").alias("notion")).agg(F.min("p_partkey").cast("int").alias("line"))


@query("d04_link_notions")
def d04(t):
    """Part names against document sentences, with the name of a part planted in every tenth document."""
    s = doc_sentences(t).select("doc_id", "num", F.col("text").alias("sentence"))
    planted = t.documents.filter(F.col("doc_id") % 10 == 0).join(
        t.part.select(F.col("p_partkey").alias("doc_id"), "p_name"), "doc_id").select(
        "doc_id", F.lit(-1).cast("long").alias("num"), F.concat(F.lit("The "), "p_name", F.lit(" was used here.")).alias("sentence"))
    return link.link_notions(part_notions(t), s.unionByName(planted))


@query("d04_link_own_name", """
SELECT DISTINCT p.p_partkey AS id, n.p_name AS notion FROM part p JOIN (SELECT DISTINCT p_name FROM part) n ON p.p_name = n.p_name""")
def d04b(t):
    """Every part name links itself; other links of the same sentence are not listed here."""
    s = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("sentence"), F.col("p_name").alias("own"))
    out = link.link_notions(part_notions(t), s)
    return out.filter(F.col("own") == F.col("notion")).select("id", "notion")


@query("d05_link_citations", """
SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS sent_no, o.l_partkey AS bib_id FROM lineitem s JOIN (SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem) o USING (l_orderkey)
WHERE o.l_suppkey >= (s.l_linenumber - 1) * 15 AND o.l_suppkey < (s.l_linenumber - 1) * 15 + 15 + 30""".replace("SELECT DISTINCT l_orderkey AS doc_id", "SELECT DISTINCT s.l_orderkey AS doc_id"))
def d05(t):
    li = t.lineitem
    sents = li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("sent_no"), ((F.col("l_linenumber") - 1) * 15).alias("start"), F.lit(15).alias("length"))
    refs = li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("bib_id"), F.col("l_suppkey").alias("pos"))
    return link.link_citations(refs, sents)


@query("d06_notion_paper_edges", """
SELECT DISTINCT s.l_orderkey AS doc_id, o.l_partkey AS bib_id, s.l_returnflag AS notion, 1 AS line FROM lineitem s JOIN lineitem o ON s.l_orderkey = o.l_orderkey
WHERE o.l_suppkey >= (s.l_linenumber - 1) * 15 AND o.l_suppkey < (s.l_linenumber - 1) * 15 + 45""")
def d06(t):
    notions = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("sent_no"), F.col("l_returnflag").alias("notion"), F.lit(1).alias("line"))
    return link.notion_paper_edges(notions, d05(t))


@query("d05_tei_citations", """
SELECT doc_id, 'b' || (doc_id % 5) AS bib_id, true AS found FROM documents WHERE len(string_split(text, chr(10))) % 4 <> 1 OR len(string_split(text, chr(10))) > 1""")
def d05b(t):
    """Citations of the derived TEI: each document cites one entry, from at least one sentence."""
    nodes = reuse(tei.tei_nodes(derive.tei_documents(t.documents)))
    sents, marks = tei.citation_marks(nodes)
    return link.link_citations(marks, sents).groupBy("doc_id", "bib_id").agg((F.count("*") > 0).alias("found"))


@query("d07_lookup_bib", """
SELECT doc_id, coalesce(quality::VARCHAR, 'UNKNOWN') AS quality, coalesce(toxic::VARCHAR, 'UNKNOWN') AS toxic FROM documents LEFT JOIN labels USING (doc_id)""")
def d07(t):
    return link.lookup_bib(t.documents.select("doc_id"), t.labels, "doc_id", ["quality", "toxic"])


@query("d08_lookup_citation", f"""
WITH r AS (SELECT doc_id, pos // 2 + 1 AS num, {q.strip("string_agg(" + q.strip('l') + ", ' ' ORDER BY pos)")} AS ref FROM {LINES} GROUP BY ALL)
SELECT doc_id, '[' || n || ']' AS token, n::INTEGER AS num, coalesce(ref, 'Reference [' || n || '] not found') AS ref FROM (SELECT doc_id, unnest([1, 2, 9]) AS n FROM documents) LEFT JOIN r ON r.doc_id = doc_id AND r.num = n""".replace("(SELECT doc_id, unnest([1, 2, 9]) AS n FROM documents) LEFT JOIN r ON r.doc_id = doc_id AND r.num = n", "(SELECT doc_id, unnest([1, 2, 9]) AS n FROM documents) d LEFT JOIN (SELECT doc_id, num AS n, ref FROM r) x USING (doc_id, n)"))
def d08(t):
    refs = segment.parse_numbered_refs(t.documents.select("doc_id", derive.numbered_lines().alias("text")))
    tokens = t.documents.select("doc_id", F.explode(F.array(F.lit("[1]"), F.lit("[2]"), F.lit("[9]"))).alias("token"))
    return link.lookup_citation(tokens, refs, missing=True)


def title_pairs(t):
    names = t.part.select(F.col("p_partkey").alias("paper_id"), F.col("p_name").alias("title"))
    return spread(title_candidates(t).join(names, "paper_id"), "paper_id", "cand_rank")


def title_candidates(t):
    """Candidate titles of a part: names of the parts numbered like its suppliers."""
    names = t.part.select(F.col("p_partkey").alias("l_suppkey"), F.col("p_name").alias("cand_title"))
    return t.lineitem.select(F.col("l_partkey").alias("paper_id"), F.struct("l_orderkey", "l_linenumber").alias("o"), "l_suppkey").join(names, "l_suppkey").select(
        "paper_id", (F.col("o.l_orderkey") * 10 + F.col("o.l_linenumber")).alias("cand_rank"), "cand_title")


@query("d09_resolve_title")
def d09(t):
    papers = t.part.select(F.col("p_partkey").alias("paper_id"), F.col("p_name").alias("title"))
    c = title_candidates(t)
    out = [link.resolve_title(papers, c, p, cut).withColumn("policy", F.lit(p)) for p, cut in (("best>", 0.60), ("first>", 0.62), ("best>=", 0.70))]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("d09_resolve_exact_title", """
SELECT p.p_partkey AS paper_id, min(l_orderkey * 10 + l_linenumber) AS cand_rank, p.p_name AS cand_title FROM lineitem JOIN part p ON p.p_partkey = l_partkey JOIN part c ON c.p_partkey = l_suppkey AND c.p_name = p.p_name GROUP BY 1, 3""")
def d09b(t):
    """Only a full score passes, so the lowest rank among equal names wins."""
    papers = t.part.select(F.col("p_partkey").alias("paper_id"), F.col("p_name").alias("title"))
    return link.resolve_title(papers, title_candidates(t), "best>=", 1.0).select("paper_id", "cand_rank", "cand_title")


@query("d10_match_page")
def d10(t):
    c = title_candidates(t).join(t.part.select(F.col("p_partkey").alias("paper_id"), F.col("p_name").alias("notion")), "paper_id")
    first = c.groupBy("notion", "cand_title").agg(F.min("cand_rank").alias("r"))
    from pyspark.sql import Window

    ranked = first.withColumn("cand_rank", F.row_number().over(Window.partitionBy("notion").orderBy("r")) - 1)
    return link.match_page(ranked.select("notion", "cand_rank", F.col("cand_title").alias("title")))


@query("d11_figure_mentions", f"""
WITH c AS (SELECT doc_id, pos AS chunk_no, lower(l) || ' fig_' || (doc_id % 3) || CASE WHEN doc_id % 2 = 0 THEN ' (b)' ELSE '' END AS low FROM {LINES}),
f AS (SELECT doc_id, unnest([0, 1, 2]) AS k FROM documents), p AS (SELECT doc_id, 'Fig_' || k || '.txt' AS name, 'fig_' || k AS base, unnest([NULL, 'a', 'b']) AS panel FROM f)
SELECT doc_id, chunk_no::INTEGER AS chunk_no, name, panel FROM c JOIN p USING (doc_id) WHERE CASE WHEN panel IS NULL THEN contains(low, base) ELSE contains(low, base || '_' || panel) OR contains(low, '(' || panel || ')') END""")
def d11(t):
    chunks = t.documents.select("doc_id", F.posexplode(tx.lines("text")).alias("chunk_no", "l")).select("doc_id", "chunk_no", F.concat(
        "l", F.lit(" fig_"), (F.col("doc_id") % 3).cast("string"), F.when(F.col("doc_id") % 2 == 0, " (b)").otherwise("")).alias("text"))
    figs = t.documents.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("fig_no")).select(
        "doc_id", "fig_no", F.concat(F.lit("Fig_"), F.col("fig_no").cast("string"), F.lit(".txt")).alias("name"), F.array(F.lit("a"), F.lit("b")).alias("panels"))
    return link.figure_mentions(chunks, figs)


@query("d12_supplement_link", f"""
WITH c AS (SELECT conv_id, turn AS chunk_no, lower(text) AS low FROM conversations WHERE role = 'assistant'),
s AS (SELECT conv_id, turn AS section_no, unnest({q.words('lower(text)')}) AS term FROM conversations WHERE role <> 'assistant')
SELECT conv_id, chunk_no, (SELECT min(section_no) FROM s WHERE s.conv_id = c.conv_id AND contains(c.low, s.term)) AS section_no FROM c""")
def d12(t):
    c = t.conversations
    chunks = c.filter(F.col("role") == "assistant").select("conv_id", F.col("turn").alias("chunk_no"), "text")
    secs = c.filter(F.col("role") != "assistant").select("conv_id", F.col("turn").alias("section_no"), F.col("text").alias("summary"))
    return link.supplement_link(chunks, secs, "conv_id")


@query("d13_containing_paragraph", f"""
WITH s AS (SELECT doc_id, p - 1 AS num, {q.squash('s')} AS s FROM (SELECT doc_id, unnest(x) AS s, generate_subscripts(x, 1) AS p FROM (SELECT doc_id, {q.sentences('text')} AS x FROM documents))),
p AS (SELECT doc_id, pos, {q.squash('l')} AS l FROM {LINES}),
m AS (SELECT s.doc_id, num, min(pos) AS para FROM s JOIN p ON s.doc_id = p.doc_id AND contains(l, s) GROUP BY ALL)
SELECT s.doc_id, s.num::INTEGER AS num, para FROM s LEFT JOIN m USING (doc_id, num)""")
def d13(t):
    sents = segment.split_sentences(t.documents.select("doc_id", "text"), "trim").select("doc_id", F.col("sent_no").alias("num"), F.col("sentence").alias("text"))
    paras = t.documents.select("doc_id", F.posexplode(tx.lines("text")).alias("pos", "text"))
    return link.containing_paragraph(sents, paras)


TAIL = lambda x: rf"lower(array_to_string(regexp_extract_all({q.squash(x)}, '{q.WORD}+')[-14:], ' '))"


@query("d14_anchor_formulas", f"""
WITH k AS (SELECT doc_id, ls, [{TAIL('x')} FOR x IN ls] AS tails, len(ls) // 2 + 1 AS mid FROM (SELECT doc_id, {q.lines('text')} AS ls FROM documents))
SELECT doc_id, 1 AS formula_no, list_position([contains(lower(x), lower(right(ls[mid], 30))) FOR x IN ls], true)::BIGINT - 1 AS num, 'contained' AS how FROM k
UNION ALL SELECT doc_id, 2, list_position(tails, tails[mid])::BIGINT - 1, 'similar' FROM k WHERE tails[mid] <> ''
UNION ALL SELECT doc_id, 3, len(ls)::BIGINT - 1, 'last' FROM k WHERE len(ls) > 0""")
def d14(t):
    """Three formulas a document: one behind the middle line, one whose anchor differs from that line's end by a character, one that fits nowhere."""
    s = t.documents.select("doc_id", F.posexplode(tx.lines("text")).alias("num", "text"))
    of = lambda ls, mid, tail: F.array(F.right(mid, F.lit(30)), F.when(tail != "", F.concat(tail, F.lit("\u2030"))), F.when(F.size(ls) > 0, F.lit("\u2030" * 9)))
    anchors = tx.let(tx.lines("text"), lambda ls: tx.let(F.get(ls, (F.size(ls) / 2).cast("int")), lambda mid: tx.let(
        F.lower(link.tail_words(mid, 14)), lambda tail: of(ls, mid, tail))))
    a = t.documents.select("doc_id", F.posexplode(anchors).alias("i", "anchor")).filter("i = 0 or anchor is not null")
    return link.anchor_formulas(a.select("doc_id", (F.col("i") + 1).alias("formula_no"), "anchor"), s).select("doc_id", "formula_no", "num", "how")


@query("d15_assign_figures", f"""
SELECT conv_id, turn, i::INTEGER AS block_no, s AS slide_id, CASE WHEN s = 1 THEN 'Figure ' || (i % 3) END AS figure_used FROM (
  SELECT conv_id, turn, generate_subscripts({q.lines('text')}, 1) - 1 AS i FROM conversations), (SELECT unnest([1, 2]) AS s)""")
def d15(t):
    from scriptorium.plans.segment_queries import parsed_plans

    first = parsed_plans(t).withColumn("slides", F.transform("slides", lambda s, i: F.struct(
        s["slide_id"].alias("slide_id"), F.when(i == 0, F.concat(s["plan"], F.lit(" as in "), F.get("available_figures", F.lit(0)))).otherwise(s["plan"]).alias("plan"))))
    return link.assign_figures(first).select("conv_id", "turn", "block_no", "slide_id", "figure_used")


@query("d16_attach_bullet_text", """
SELECT event_id, 'first' AS keep, coalesce(c_name, '') AS bullet_text FROM events LEFT JOIN (SELECT c_nationkey AS k, arg_min(c_name, c_custkey) AS c_name FROM customer GROUP BY 1) ON user_id % 40 = k
UNION ALL SELECT event_id, 'last', coalesce(c_name, '') FROM events LEFT JOIN (SELECT c_nationkey AS k, arg_max(c_name, c_custkey) AS c_name FROM customer GROUP BY 1) ON user_id % 40 = k""")
def d16(t):
    e = t.events.select("event_id", (F.col("user_id") % 40).cast("string").alias("bullet_id"))
    b = t.customer.select(F.col("c_nationkey").cast("string").alias("bullet_id"), F.col("c_custkey").alias("pos"), F.col("c_name").alias("bullet_text"))
    out = [link.attach_bullet_text(e, b, k).select("event_id", F.lit(k).alias("keep"), "bullet_text") for k in ("first", "last")]
    return out[0].unionByName(out[1])


@query("d17_restrict", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def d17(t):
    return link.restrict(t.documents.select("doc_id", "lang"), t.labels, "doc_id")


@query("d18_skip_existing", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def d18(t):
    return link.skip_existing(t.documents.select("doc_id", "lang"), t.labels, "doc_id")


@query("d19_papers_by_notion", """
SELECT p_partkey AS notion, l_orderkey FROM part LEFT JOIN lineitem ON p_partkey = l_partkey""")
def d19(t):
    papers = t.lineitem.select(F.col("l_partkey").alias("notion"), "l_orderkey")
    return link.papers_by_notion(papers, t.part.select(F.col("p_partkey").alias("notion")))


@query("d20_resolve_keys", """
WITH s AS (SELECT DISTINCT n_regionkey AS deck_id, n_name AS gid, n_nationkey AS gi, k FROM nation, (SELECT unnest([1, 2]) AS k)),
r AS (SELECT c_custkey AS req_id, n_regionkey AS deck_id, n_name, c_nationkey AS gi, c_custkey % 6 AS rule, (c_custkey % 3 + 1)::INTEGER AS sid FROM customer JOIN nation ON c_nationkey = n_nationkey),
n AS (SELECT r.req_id, count(DISTINCT s.gid) AS n, min(s.gid) AS gid FROM r JOIN s ON r.deck_id = s.deck_id AND contains(lower(s.gid), lower(left(r.n_name, 2))) GROUP BY 1)
SELECT req_id, CASE WHEN rule = 0 THEN 'ok' WHEN rule = 1 THEN 'slide_id required' WHEN rule IN (2, 3) THEN CASE WHEN sid <= 2 THEN 'ok' ELSE 'not found' END
  WHEN rule = 4 THEN CASE WHEN n.n > 1 THEN 'ambiguous group' WHEN sid <= 2 THEN 'ok' ELSE 'not found' END ELSE CASE WHEN sid <= 2 THEN 'ambiguous slide' ELSE 'no slide' END END AS status FROM r JOIN n USING (req_id)""")
def d20(t):
    n = t.nation
    slides = n.select(F.col("n_regionkey").alias("deck_id"), F.col("n_name").alias("group_id"), F.col("n_name").alias("group_name"), F.col("n_nationkey").alias("group_index"),
                      F.explode(F.array(F.lit(1), F.lit(2))).alias("slide_id")).withColumn("slide_uid", F.concat("group_id", F.lit("::Slide_"), F.col("slide_id").cast("string")))
    rule = F.col("c_custkey") % 6
    c = t.customer.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    only = lambda cond, v: F.when(cond, v)
    req = c.select(F.col("n_regionkey").alias("deck_id"), F.col("c_custkey").alias("req_id"), only(rule == 0, F.concat("n_name", F.lit("::Slide_1"))).alias("slide_uid"),
                   only(rule == 2, F.col("n_name")).alias("group_id"), only(rule != 1, (F.col("c_custkey") % 3 + 1).cast("int")).alias("slide_id"),
                   only(rule == 3, F.col("c_nationkey")).alias("group_index"), only(rule == 4, F.left("n_name", F.lit(2))).alias("name_contains"))
    return link.resolve_keys(req, slides).select("req_id", "status")


@query("d21_majority_figure", """
WITH m AS (SELECT l_orderkey AS block, l_linenumber AS num, CASE WHEN l_linestatus = 'O' THEN l_returnflag END AS fig FROM lineitem),
v AS (SELECT block, fig, count(*) AS c, min(num) AS met FROM m WHERE fig IS NOT NULL GROUP BY ALL), t AS (SELECT block, fig, c FROM v QUALIFY row_number() OVER (PARTITION BY block ORDER BY c DESC, met, fig) = 1),
n AS (SELECT block, count(*) AS n FROM m GROUP BY 1)
SELECT block, CASE WHEN c >= n * 0.4 THEN fig END AS majority, n, coalesce(c, 0) AS votes FROM n LEFT JOIN t USING (block)""")
def d21(t):
    m = t.lineitem.select(F.col("l_orderkey").alias("block"), F.col("l_linenumber").alias("num"), F.when(F.col("l_linestatus") == "O", F.col("l_returnflag")).alias("partner_fig"))
    return link.majority_figure(m)


def _windows(table: str, key: str) -> str:
    tagged = f"SELECT {key}, pos - 1 AS line, w, row_number() OVER (PARTITION BY {key} ORDER BY pos, k) - 1 AS at_ FROM (SELECT {key}, pos, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM (SELECT {key}, pos, {q.words('l')} AS ws FROM (SELECT {key}, unnest(ls) AS l, generate_subscripts(ls, 1) AS pos FROM (SELECT {key}, {q.lines('lower(text)')} AS ls FROM {table}))))"
    return f"(SELECT {key}, at_, line, list(w) OVER (PARTITION BY {key} ORDER BY at_ ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS win FROM ({tagged}) QUALIFY len(win) = 10)"


@query("d22_match_passages", f"""
WITH p AS (SELECT DISTINCT item_id, win FROM {_windows('benchmark', 'item_id')}), d AS (SELECT * FROM {_windows('documents', 'doc_id')})
SELECT item_id, doc_id, min(at_)::INTEGER AS word_at, arg_min(line, at_)::INTEGER AS line_no, count(DISTINCT at_) AS n_windows FROM p JOIN d USING (win) GROUP BY ALL""")
def d22(t):
    return passage_pairs(t)


# --- similarity functions ----------------------------------------------------------------------


@query("u01_ratio")
def u01(t):
    return title_pairs(t).select("paper_id", "cand_rank", F.round(sim.ratio("title", "cand_title"), 6).alias("ratio"), sim.changed_chars("title", "cand_title").alias("changed"))


@query("u03_fuzzy_ratios")
def u03(t):
    return title_pairs(t).select("paper_id", "cand_rank", F.round(sim.partial_ratio("title", "cand_title"), 6).alias("partial"), F.round(sim.token_set_ratio("title", "cand_title"), 6).alias("token_set"))


WORDS = lambda x: rf"list_distinct(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+'))"


@query("u04_token_overlap", f"""
SELECT l_orderkey, l_linenumber, round(len(list_intersect({WORDS('p.p_name')}, {WORDS("s.p_name || ' ' || s.p_type")}))::DOUBLE / greatest(1, len({WORDS('p.p_name')})), 6) AS overlap,
  len([w FOR w IN regexp_extract_all(lower(p.p_name), '[\\p{{L}}\\p{{N}}_]+') IF length(w) > 4 AND contains(lower(s.p_name || ' ' || s.p_type), w)])::INTEGER AS contained
FROM lineitem JOIN part p ON p.p_partkey = l_partkey JOIN part s ON s.p_partkey = l_suppkey""".replace("\\\\", "\\"))
def u04(t):
    p = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("a"))
    s = t.part.select(F.col("p_partkey").alias("l_suppkey"), F.concat_ws(" ", "p_name", "p_type").alias("b"))
    j = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(p, "l_partkey").join(s, "l_suppkey")
    return j.select("l_orderkey", "l_linenumber", F.round(sim.token_overlap("a", "b"), 6).alias("overlap"), sim.contained_tokens("a", "b").alias("contained"))


@query("u06_dot_l2", """
SELECT a.vec_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dot, round(list_sum([(x - b.embedding[i]::DOUBLE) ** 2 FOR x, i IN a.embedding::DOUBLE[]]), 6) AS l2
FROM embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id * 7 + 1) % (SELECT count(*) FROM embeddings)""")
def u06(t):
    e = t.embeddings
    n = e.agg(F.count("*")).scalar()
    a = e.select("vec_id", F.col("embedding").alias("a"), ((F.col("vec_id") * 7 + 1) % n).alias("o"))
    b = e.select(F.col("vec_id").alias("o"), F.col("embedding").alias("b"))
    return a.join(b, "o").select("vec_id", F.round(sim.dot("a", "b"), 6).alias("dot"), F.round(sim.l2("a", "b"), 6).alias("l2"))
