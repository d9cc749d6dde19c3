"""Resolution and window queries (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import text as tx
from scriptorium.operators import clean, link, report, resolve
from scriptorium.plans import sqltext as q
from scriptorium.plans.clean_queries import CANDIDATES_SQL, event_candidates
from scriptorium.plans.registry import query
from scriptorium.plans.report_queries import LINES
from scriptorium.plans.segment_queries import PLAN_LINES, parsed_plans
from scriptorium.session import reuse

C = f"({CANDIDATES_SQL})"
WEIGHT = "CASE exclusivity WHEN 'strong' THEN 1.2 WHEN 'weak' THEN 0.85 ELSE 1.0 END"
# Slides of group 6 are left out of the deck, so their candidates sit on unknown slides.
SLIDES_SQL = f"""SELECT DISTINCT slide_uid, regexp_extract(slide_uid, '^G(\\d+)', 1)::INTEGER AS g, regexp_extract(slide_uid, '_(\\d+)$', 1)::INTEGER AS sid
  FROM {C} WHERE slide_uid NOT LIKE 'G6%'""".replace("\\\\", "\\")
ORDER_SQL = f"SELECT slide_uid, g, sid, row_number() OVER (ORDER BY g, sid) - 1 AS idx FROM ({SLIDES_SQL})"


def candidates(t):
    return clean.coerce_candidates(event_candidates(t))


def slides(t):
    """Deck slides; a small table derived from all events, so it is kept for the several passes over it."""
    s = candidates(t).select("slide_uid").filter(~F.col("slide_uid").startswith("G6")).distinct()
    return reuse(s).withColumn("group_index", F.regexp_extract("slide_uid", "^G(\\d+)", 1).cast("int")).withColumn("slide_id", resolve.slide_number("slide_uid"))


PRIMARY_SQL = f"""SELECT bullet_id, slide_uid AS primary_slide_uid, score FROM (
  SELECT *, row_number() OVER (PARTITION BY bullet_id ORDER BY score DESC, priority DESC, coalesce(idx, 1000000000), slide_uid DESC) AS rn FROM (
    SELECT c.*, idx, priority * {WEIGHT} + 0.06 * (1.0 - coalesce(idx, n)::DOUBLE / greatest(1, n - 1)) AS score
    FROM {C} c LEFT JOIN ({ORDER_SQL}) USING (slide_uid), (SELECT count(*) AS n FROM ({ORDER_SQL})))) WHERE rn = 1"""
USAGE_SQL = f"""SELECT c.*, primary_slide_uid, CASE WHEN slide_uid = primary_slide_uid THEN 'primary' WHEN priority < 0.55 THEN 'drop' ELSE 'reminder' END AS usage
  FROM {C} c JOIN ({ORDER_SQL}) USING (slide_uid) JOIN ({PRIMARY_SQL}) USING (bullet_id)"""


@query("f01_slide_order", f"SELECT slide_uid, g AS group_index, sid AS slide_id, idx FROM ({ORDER_SQL})")
def f01(t):
    return resolve.slide_order(slides(t))


@query("f02_primary_per_bullet", f"SELECT bullet_id, primary_slide_uid, round(score, 6) AS score FROM ({PRIMARY_SQL})")
def f02(t):
    return resolve.primary_per_bullet(candidates(t), reuse(resolve.slide_order(slides(t))))


def usages(t):
    order = reuse(resolve.slide_order(slides(t)))
    c = candidates(t)
    return resolve.classify_usage(c, resolve.primary_per_bullet(c, order), order)


@query("f03_classify_usage", f"SELECT pos, bullet_id, slide_uid, usage, CASE usage WHEN 'primary' THEN 0 WHEN 'reminder' THEN 1 ELSE 2 END::INTEGER AS usage_rank FROM ({USAGE_SQL})")
def f03(t):
    return usages(t).select("pos", "bullet_id", "slide_uid", "usage", "usage_rank")


@query("e06_resolution_report", f"""
SELECT (SELECT count(*) FROM ({SLIDES_SQL})) AS num_slides, (SELECT count(DISTINCT bullet_id) FROM {C}) AS num_bullets_seen,
  (SELECT count(*) FROM (SELECT bullet_id FROM {C} GROUP BY 1 HAVING count(*) > 1)) AS bullets_with_duplicates,
  (count_if(usage = 'primary'))::BIGINT AS primary_assignments, (count_if(usage = 'reminder'))::BIGINT AS reminders, (count_if(usage = 'drop'))::BIGINT AS drops FROM ({USAGE_SQL})""")
def e06(t):
    return report.resolution_report(usages(t), candidates(t), slides(t))


@query("f04_unique_placement", f"""
SELECT bullet_id, slide_uid, round(score, 6) AS score, priority, exclusivity FROM (
  SELECT *, priority * {WEIGHT} AS score, row_number() OVER (PARTITION BY bullet_id ORDER BY priority * {WEIGHT} DESC, pos) AS rn FROM {C}) WHERE rn = 1""")
def f04(t):
    return resolve.unique_placement(candidates(t))


@query("f02_primary_per_part", """
SELECT bullet_id, slide_uid AS primary_slide_uid, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY bullet_id ORDER BY score DESC, priority DESC, idx) AS rn FROM (
    SELECT l_partkey AS bullet_id, l_suppkey AS idx, l_suppkey::VARCHAR AS slide_uid, l_quantity / 50 AS priority, (l_quantity / 50) * CASE l_returnflag WHEN 'A' THEN 1.2 WHEN 'N' THEN 0.85 ELSE 1.0 END AS score FROM lineitem)) WHERE rn = 1""")
def f02b(t):
    """Placement at table scale: parts are bullets, suppliers slides in the order of their keys."""
    li = t.lineitem.select(
        F.col("l_partkey").alias("bullet_id"), F.col("l_suppkey").cast("string").alias("slide_uid"), (F.col("l_quantity") / 50).alias("priority"),
        F.when(F.col("l_returnflag") == "A", "strong").when(F.col("l_returnflag") == "N", "weak").otherwise("medium").alias("exclusivity"))
    order = t.supplier.select(F.col("s_suppkey").cast("string").alias("slide_uid"), F.col("s_suppkey").alias("idx"))
    return resolve.primary_per_bullet(li, order, early_bonus=0.0)


TOK = lambda x: f"list_distinct([y FOR y IN regexp_extract_all(lower({x}), '[a-z0-9]+') IF length(y) >= 4])"


@query("f05_effective_priority", f"""
WITH u AS (SELECT conv_id, turn, 'B' || turn AS bullet_id, text FROM conversations WHERE turn > 0),
s AS (SELECT conv_id, text AS plan, role FROM conversations WHERE turn = 0),
c AS (SELECT conv_id, 'B' || (turn % 2) AS bullet_id, max((length(text) % 100) / 100.0) AS top FROM conversations WHERE conv_id % 3 > 0 GROUP BY ALL),
j AS (SELECT u.conv_id, u.bullet_id, top, len(list_intersect({TOK('text')}, {TOK("plan || ' ' || role")})) AS overlap,
  CASE WHEN u.conv_id % 3 = 0 THEN 0.7 ELSE greatest(0.65, coalesce(top, 0.65)) END AS base FROM u JOIN s USING (conv_id) LEFT JOIN c USING (conv_id, bullet_id))
SELECT conv_id AS slide_uid, bullet_id, overlap::INTEGER AS overlap, round(greatest(0, least(1, CASE WHEN overlap > 0 THEN least(0.95, base + least(0.15, 0.03 * overlap)) ELSE base END))::DOUBLE, 6) AS priority FROM j""")
def f05(t):
    c = t.conversations
    u = c.filter(F.col("turn") > 0).select(F.col("conv_id").alias("slide_uid"), F.concat(F.lit("B"), F.col("turn").cast("string")).alias("bullet_id"), F.col("text").alias("bullet_text"))
    cands = c.filter(F.col("conv_id") % 3 > 0).select(F.col("conv_id").alias("slide_uid"), F.concat(F.lit("B"), (F.col("turn") % 2).cast("string")).alias("bullet_id"),
                                                     (F.length("text") % 100 / 100.0).alias("priority"))
    s = c.filter(F.col("turn") == 0).select(F.col("conv_id").alias("slide_uid"), F.col("text").alias("plan"), F.col("role").alias("slide_context"))
    return resolve.effective_priority(u, cands, s).select("slide_uid", "bullet_id", "overlap", F.round("priority", 6).alias("priority"))


LEVEL = "CASE WHEN priority >= 0.75 THEN 'MUST' WHEN priority >= 0.55 THEN 'SHOULD' ELSE 'OPTIONAL' END"


@query("f06_requirement_level", f"SELECT pos, slide_uid, bullet_id, round(priority, 3) AS priority, {LEVEL} AS level FROM {C} WHERE argument <> 'MISSING_ARGUMENT'")
def f06(t):
    c = candidates(t).withColumn("bullet_text", F.when(F.col("argument") == "MISSING_ARGUMENT", " ").otherwise(F.col("argument")))
    return resolve.requirement_level(c).select("pos", "slide_uid", "bullet_id", "priority", "level")


@query("f07_fallback_requirements", f"""
SELECT slide_uid, bullet_id, rank::INTEGER AS rank, round(priority, 3) AS priority, CASE WHEN priority >= 0.8 THEN 'MUST' ELSE 'SHOULD' END AS level FROM (
  SELECT *, row_number() OVER (PARTITION BY slide_uid ORDER BY priority DESC, pos) AS rank FROM {C}) WHERE rank <= 4""")
def f07(t):
    return resolve.fallback_requirements(candidates(t)).select("slide_uid", "bullet_id", "rank", "priority", "level")


def supplier_edges(t):
    """Each order is an article, each part a paper, each supplier (and its neighbour) a notion."""
    li = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").cast("string").alias("bib_id"), "l_suppkey")
    return li.withColumn("line", F.explode(F.array(F.col("l_suppkey") % 3, F.col("l_suppkey") % 4, F.lit(9)))).select(
        "doc_id", "pos", "bib_id", F.concat(F.lit("notion "), F.col("line").cast("string")).alias("notion"), F.col("line").cast("int").alias("line"))


EDGES = "(SELECT l_orderkey AS doc_id, min(l_linenumber) AS seen, l_partkey::VARCHAR AS bib_id, list_sort(list_distinct(flatten(list([l_suppkey % 3, l_suppkey % 4, 9])))) AS opts FROM lineitem GROUP BY ALL)"
PICK = "list_min([a.load[o + 1] * 1000 + o FOR o IN x.opts]) % 1000"


@query("f08_balanced_assignment", f"""
WITH r AS (SELECT doc_id, list(bib_id ORDER BY seen, bib_id) AS bibs, list_reduce(list_concat([{{load: [0 FOR i IN range(10)], picked: []::BIGINT[], opts: []::BIGINT[]}}],
  list({{load: [0 FOR i IN range(10)], picked: []::BIGINT[], opts: opts}} ORDER BY seen, bib_id)),
  lambda a, x: {{load: [v + (i - 1 = {PICK})::BIGINT FOR v, i IN a.load], picked: list_append(a.picked, {PICK}), opts: x.opts}}) AS s FROM {EDGES} GROUP BY 1)
SELECT doc_id, unnest(bibs) AS bib_id, 'notion ' || unnest(s.picked) AS notion, unnest(s.picked)::INTEGER AS line FROM r""")
def f08(t):
    return resolve.balanced_assignment(supplier_edges(t))


@query("f09_neighbour_context", f"""
SELECT doc_id, (p - 1)::INTEGER AS sent_no, array_to_string(ss[greatest(p - 2, 1):p + 2], ' | ') AS context FROM (
  SELECT doc_id, ss, unnest(range(1, len(ss) + 1)) AS p FROM (SELECT doc_id, {q.sentences('text')} AS ss FROM documents))""")
def f09(t):
    return resolve.neighbour_context(t.documents.select("doc_id", "text"))


@query("f10_formula_context", f"""
WITH l AS {LINES}, n AS (SELECT doc_id, max(pos) AS m FROM l GROUP BY 1)
SELECT l.doc_id, 1 AS formula_no, (pos - m // 2)::INTEGER AS offset, l AS text FROM l JOIN n USING (doc_id) WHERE pos <> m // 2 AND abs(pos - m // 2) <= 2""".replace("AS offset", 'AS "offset"'))
def f10(t):
    s = t.documents.select("doc_id", F.posexplode(tx.lines("text")).alias("num", "text"))
    a = t.documents.select("doc_id", F.lit(1).alias("formula_no"), F.floor((F.size(tx.lines("text")) - 1) / 2).cast("int").alias("num"))
    return resolve.formula_context(a, s)


@query("f11_interleave", f"""
WITH l AS {LINES}, s AS (SELECT doc_id, pos AS num, 0 AS kind, 'S' AS meta, l AS text FROM l
  UNION ALL SELECT doc_id, pos, 1, 'FORMULA;f' || pos, 'Formula (' || pos || '): x = ' || pos FROM l WHERE pos % 3 = 0)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY num, kind)::INTEGER AS new_num, kind, meta, text FROM s""")
def f11(t):
    s = t.documents.select("doc_id", F.posexplode(tx.lines("text")).alias("num", "text")).withColumn("meta", F.lit("S"))
    n = F.col("num").cast("string")
    f = s.filter(F.col("num") % 3 == 0).select("doc_id", "num", F.col("num").alias("formula_no"), F.concat(F.lit("f"), n).alias("xml_id"),
                                               F.concat(F.lit("("), n, F.lit(")")).alias("label"), F.concat(F.lit("x = "), n).alias("formula_text"))
    return resolve.interleave(s, f)


@query("f12_carry_previous", "SELECT conv_id, turn, right(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), 40) AS tail, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_role FROM conversations")
def f12(t):
    c = resolve.carry_previous(t.conversations, "conv_id", "turn", 40).withColumnRenamed("previous", "tail")
    return resolve.carry_previous(c, "conv_id", "turn", column="role").select("conv_id", "turn", "tail", F.col("previous").alias("prev_role"))


@query("f13_suppress_false_splits", """
WITH m AS (SELECT l_orderkey AS pair_id, l_linenumber AS num, l_suppkey % 2 AS right_num, CASE l_linestatus WHEN 'O' THEN 'match' ELSE 'rejected' END AS status, l_quantity / 50 AS score, l_partkey FROM lineitem)
SELECT pair_id, num, right_num, status, l_partkey FROM m WHERE NOT (status = 'rejected' AND EXISTS (SELECT 1 FROM m s WHERE s.pair_id = m.pair_id AND s.right_num = m.right_num AND s.status = 'match' AND s.score >= 0.75 AND abs(s.num - m.num) <= 2))""")
def f13(t):
    m = t.lineitem.select(F.col("l_orderkey").alias("pair_id"), F.col("l_linenumber").alias("num"), (F.col("l_suppkey") % 2).alias("right_num"),
                          F.when(F.col("l_linestatus") == "O", "match").otherwise("rejected").alias("status"), (F.col("l_quantity") / 50).alias("score"), "l_partkey")
    return resolve.suppress_false_splits(m).drop("score")


@query("f14_reorder_instructions", """
WITH m AS (SELECT l_orderkey AS pair_id, l_orderkey * 10000000000 + l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS num, CASE WHEN l_returnflag = 'A' THEN 'FIG001' ELSE '' END AS block,
  CASE WHEN l_linestatus = 'O' THEN l_suppkey % 20 END AS partner, CASE WHEN l_linestatus = 'O' AND l_suppkey % 2 = 0 THEN 'FIG001' END AS fig FROM lineitem),
j AS (SELECT pair_id, block, count(*) AS n, count(fig) AS votes FROM m GROUP BY ALL),
w AS (SELECT m.*, CASE WHEN votes > 0 AND votes >= n * 0.4 THEN 'FIG001' END AS major, lag(num) OVER k AS pn, lag(partner) OVER k AS pp FROM m JOIN j USING (pair_id, block) WINDOW k AS (PARTITION BY pair_id, block ORDER BY num)),
f AS (SELECT *, partner IS NOT NULL AND block <> '' AND NOT coalesce(fig = major, false) AS foreign_ FROM w),
o AS (SELECT *, CASE WHEN partner IS NULL THEN 'insert' WHEN foreign_ THEN CASE WHEN pn IS NULL THEN 'place' ELSE 'move' END WHEN pn IS NULL THEN NULL WHEN pp IS NULL THEN 'place'
  WHEN partner <= pp AND (block <> '' OR partner > pp - 10) THEN 'move' END AS op FROM f)
SELECT pair_id, nullif(block, '') AS block, num, op, CASE WHEN partner IS NULL THEN 'left' ELSE 'right' END AS what, coalesce(partner, num) AS id,
  CASE WHEN pn IS NULL THEN CASE WHEN block = '' THEN 'end' ELSE 'fig_begin' END WHEN pp IS NULL THEN 'left' ELSE 'right' END AS after_type, coalesce(pp, pn) AS after_id,
  CASE WHEN foreign_ AND fig IS NOT NULL THEN 'wrong figure' END AS label FROM o WHERE op IS NOT NULL""")
def f14(t):
    num = F.col("l_orderkey") * 10000000000 + F.col("l_partkey") * 100000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")
    m = t.lineitem.select(F.col("l_orderkey").alias("pair_id"), num.alias("num"),
                          F.when(F.col("l_returnflag") == "A", "FIG001").alias("block"), F.when(F.col("l_linestatus") == "O", F.col("l_suppkey") % 20).alias("partner_num"),
                          F.when(F.col("l_suppkey") % 2 == 0, "FIG001").alias("partner_fig"))
    m = m.withColumn("partner_fig", F.when(F.col("partner_num").isNotNull(), F.col("partner_fig")))
    major = link.majority_figure(m, 0.4, ["pair_id", "block"])
    return resolve.reorder_instructions(m, major)


@query("f15_apply_instructions", f"""
WITH l AS {LINES}, n AS (SELECT doc_id, max(pos) + 1 AS n FROM l GROUP BY 1),
k AS (SELECT doc_id, l AS text, 'right' AS source, pos AS num, CASE WHEN pos % 7 = 5 AND (pos < n - 1 OR n = 1) THEN 'FIG001' END AS block,
    CASE WHEN pos = 0 THEN 1e9 WHEN pos < n - 1 THEN pos WHEN n > 2 THEN 1.5 ELSE 0.9 END AS ord FROM l JOIN n USING (doc_id)
  UNION ALL SELECT doc_id, CASE WHEN i = 5 THEN '[MISSING LEFT 5]' ELSE 'left ' || i || ' of ' || n END, 'left', i, CASE WHEN i = 4 THEN 'FIG001' END,
    CASE i WHEN 2 THEN 0.2 WHEN 3 THEN 0.3 WHEN 4 THEN 1e9 ELSE 1e9 + 1 END FROM n, range(2, 6) r(i))
SELECT doc_id AS pair_id, block, row_number() OVER (PARTITION BY doc_id, block ORDER BY ord)::INTEGER AS pos, source, num::BIGINT AS num, text FROM k""")
def f15(t):
    """Insertions in a row, two moves of the last line, the first line at the end, a figure operation, and an unknown anchor with a missing text."""
    # as a generator the lines are cut once a document, not once for each use of their number
    sized = reuse(t.documents.select("doc_id", F.explode(F.filter(F.array(F.size(tx.lines("text"))), lambda n: n > 0)).alias("n")))
    n = F.col("n")
    last = F.when(n > 1, n - 1).cast("string")
    right = t.documents.select(F.col("doc_id").alias("pair_id"), F.posexplode(tx.lines("text")).alias("num", "text")).select(
        "pair_id", F.col("num").cast("long").alias("num"), F.when(F.col("num") % 7 == 5, "FIG001").alias("block"), "text")
    left = sized.select(F.col("doc_id").alias("pair_id"), F.explode(F.sequence(F.lit(2).cast("long"), F.lit(4).cast("long"))).alias("num"), n.alias("n")).select(
        "pair_id", "num", F.concat(F.lit("left "), F.col("num").cast("string"), F.lit(" of "), F.col("n").cast("string")).alias("text"))
    lines = [F.concat(F.lit("MOVE RIGHT "), last, F.lit(" (main) AFTER RIGHT 0  # back")), F.lit("INSERT LEFT 2 AFTER RIGHT 0"), F.lit("insert left 3 after left 2"),
             F.when(n > 2, F.concat(F.lit("MOVE RIGHT "), last, F.lit(" AFTER RIGHT 1"))), F.lit("PLACE RIGHT 0 AT END OF DOCUMENT"),
             F.lit("PLACE LEFT 4 AT BEGINNING OF FIGURE"), F.lit("INSERT LEFT 5 AFTER RIGHT 99999999")]
    raw = sized.select(F.col("doc_id").alias("pair_id"), F.posexplode(F.array(*lines)).alias("op_no", "line")).filter("line is not null")
    ops = resolve.parse_instructions(raw.withColumn("block", F.when(F.col("op_no") == 5, "FIG001")))
    return resolve.apply_instructions(right, left, ops)


@query("f16_check_plan", f"""
WITH p AS (SELECT conv_id * 1000 + turn AS doc_id, i, x, '===SLIDE_GROUP: Group ' || (i + 1) || ' | Slides ' || (2 * i + 1) || '–' || (2 * i + 2) || '===' AS header FROM {PLAN_LINES}),
r AS (SELECT *, 2 * i + 1 + (i % 3 = 2)::INTEGER AS f, 2 * i + 2 + (i % 5 = 4)::INTEGER AS e FROM p),
g AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY f), 0) + 1 AS want FROM r),
w AS (SELECT *, {q.n_words('x')} AS n FROM p)
SELECT doc_id, header, 'range' AS kind, 'expected start ' || want AS detail FROM g WHERE f <> want
UNION ALL SELECT doc_id, header, 'count', 'declared ' || (e - f + 1) || ', found 2' FROM r WHERE e - f + 1 <> 2
UNION ALL SELECT doc_id, header, 'transition' AS kind, CASE WHEN i % 2 = 0 OR {q.strip('x')} = '' OR lower({q.strip('x')}) IN ('none', 'n/a') THEN 'weak or missing' ELSE 'very short' END AS detail FROM w WHERE i % 2 = 0 OR n < 6
UNION ALL SELECT doc_id, header, 'focus', 'slide ' || (2 * i + 1) || ': ' || n || ' words' FROM w WHERE n < 6 OR n > 22
UNION ALL SELECT doc_id, header, 'focus', 'slide ' || (2 * i + 2) || ': 3 words' FROM w
UNION ALL SELECT doc_id, NULL, 'figure', 'reused ' || (i % 3) FROM p GROUP BY doc_id, i % 3 HAVING count(*) > 1""")
def f16(t):
    """Every third group starts a slide late and every fifth ends one late."""
    i = F.col("slide_from").cast("int") / 2
    p = parsed_plans(t).withColumn("doc_id", F.col("conv_id") * 1000 + F.col("turn")).withColumn("i", F.floor(i))
    p = p.withColumn("slide_from", F.col("slide_from") + (F.col("i") % 3 == 2).cast("int")).withColumn(
        "slide_to", F.col("slide_to") + (F.col("i") % 5 == 4).cast("int"))
    return resolve.check_plan(p, p)


@query("f17_cumulative_coverage", f"""
SELECT conv_id, kind, item, min(turn) AS first_group, count(*) AS n_mentions FROM (
  SELECT conv_id, turn, 'concept' AS kind, array_to_string({q.words('l')}, ' ') AS item FROM (SELECT conv_id, turn, unnest({q.lines('text')}) AS l FROM conversations)
  UNION ALL SELECT conv_id, turn, 'keyword', w FROM (SELECT conv_id, turn, unnest({q.words('text')}) AS w FROM conversations)) WHERE item <> '' GROUP BY ALL""")
def f17(t):
    c = t.conversations
    concepts = c.select("conv_id", "turn", F.lit("concept").alias("kind"), F.explode(tx.lines("text")).alias("item"))
    words = c.select("conv_id", "turn", F.lit("keyword").alias("kind"), F.explode(tx.words("text")).alias("item"))
    return resolve.cumulative_coverage(concepts.unionByName(words), "conv_id", "turn")


@query("f18_harvest_new_lines", f"""
SELECT lang, l AS line, doc_id, pos::INTEGER AS pos FROM (SELECT lang, l, doc_id, pos, row_number() OVER (PARTITION BY lang, l ORDER BY doc_id, pos) AS r FROM documents JOIN {LINES} USING (doc_id)) WHERE r = 1""")
def f18(t):
    ls = t.documents.select("lang", "doc_id", F.posexplode(tx.lines("text")).alias("pos", "line"))
    return resolve.harvest_new_lines(ls, "lang", ["doc_id", "pos"])


@query("f19_merge_continuous", """
WITH r AS (SELECT *, sum(CASE WHEN role = 'assistant' AND turn > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM conversations)
SELECT conv_id, min(turn) AS start_at, count(*)::INTEGER AS n_sections, string_agg(text, chr(10) ORDER BY turn) AS text FROM r GROUP BY conv_id, run""")
def f19(t):
    c = t.conversations.withColumn("decision", F.when(F.col("role") == "assistant", "Yes ").otherwise("no"))
    return resolve.merge_continuous(c, "conv_id", "turn")


@query("f20_leftover_figures", f"""
WITH a AS (SELECT DISTINCT g, event_type AS figure, min(event_id) AS fig_no FROM (SELECT *, event_id % 7 AS g FROM events) GROUP BY ALL),
u AS (SELECT DISTINCT event_id % 7 AS g, event_type AS figure FROM events WHERE value > 400),
b AS (SELECT g, arg_max(slide_uid, sid) AS base FROM ({SLIDES_SQL}) GROUP BY 1)
SELECT 'G' || a.g AS group_id, figure, base || '::Figure_' || row_number() OVER (PARTITION BY a.g ORDER BY fig_no) AS slide_uid FROM a ANTI JOIN u USING (g, figure) JOIN b USING (g)""")
def f20(t):
    e = t.events.withColumn("group_id", F.concat(F.lit("G"), (F.col("event_id") % 7).cast("string")))
    avail = e.groupBy("group_id", F.col("event_type").alias("figure")).agg(F.min("event_id").alias("fig_no"))
    used = e.filter(F.col("value") > 400).select("group_id", F.col("event_type").alias("figure"))
    s = slides(t).withColumn("group_id", F.regexp_extract("slide_uid", "^(G\\d+)", 1))
    return resolve.leftover_figures(avail, used, s)


@query("f21_match_strength", """
SELECT o_orderkey AS num, CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 100 >= 75 THEN 'STRONG' WHEN o_orderkey % 100 >= 40 THEN 'WEAK' ELSE 'VERY WEAK' END END AS strength FROM orders""")
def f21(t):
    m = t.orders.select(F.col("o_orderkey").alias("num"), (F.col("o_orderkey") % 100 / 100.0).alias("score"), F.when(F.col("o_orderstatus") == "F", "match").otherwise("rejected").alias("status"))
    return resolve.match_strength(m).select("num", "strength")


@query("resolved_plan_slides", f"""
SELECT conv_id, turn, count(*) AS n_slides, max(slide_id)::INTEGER AS last_slide FROM (
  SELECT conv_id, turn, unnest([1, 2, 3]) AS slide_id FROM {PLAN_LINES}) GROUP BY ALL""")
def resolved_plan_slides(t):
    """D-15 over every plan block: no slide names its figure, so each group gains one slide."""
    p = segment_assign(t)
    return p.groupBy("conv_id", "turn").agg(F.count("*").alias("n_slides"), F.max("slide_id").alias("last_slide"))


def segment_assign(t):
    return link.assign_figures(parsed_plans(t).withColumn("available_figures", F.transform("available_figures", lambda f: F.concat(F.lit("~"), f))))
