"""Segmentation queries (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import text as tx
from scriptorium.operators import segment as seg
from scriptorium.plans import derive
from scriptorium.plans import sqltext as q
from scriptorium.plans.registry import query

DOC = ("doc_id", "text")
E = f"(SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) - 1 AS pos FROM (SELECT doc_id, {q.lines('text')} AS ls FROM documents))"
S = q.strip("l")


def docs(t):
    return t.documents.select(*DOC)


@query("c01_sliding_chunks", """
SELECT doc_id, (i // 5500)::INTEGER AS chunk_no, substring(text, i::BIGINT + 1, 6000) AS chunk FROM (
  SELECT doc_id, text, unnest(range(0, greatest(length(text) - 500, 1), 5500)) AS i FROM documents)
UNION ALL SELECT doc_id + 1000000000, (i // 200)::INTEGER, substring(text, i::BIGINT + 1, 500) FROM (
  SELECT doc_id, text, unnest(range(0, greatest(length(text) - 300, 1), 200)) AS i FROM documents)""")
def c01(t):
    small = seg.sliding_chunks(docs(t), 500, 300).withColumn("doc_id", F.col("doc_id") + 1000000000)
    return seg.sliding_chunks(docs(t), 6000, 500).unionByName(small)


@query("c02_overlap_chunks", f"""
WITH d AS (SELECT doc_id, {q.strip('text')} AS s FROM documents)
SELECT doc_id, (i // 700)::INTEGER AS chunk_no, substring(s, i::BIGINT + 1, 1000) AS chunk FROM (
  SELECT doc_id, s, unnest(range(0, CASE WHEN length(s) <= 1000 THEN 1 ELSE length(s) - 300 END, 700)) AS i FROM d WHERE s <> '')
UNION ALL SELECT doc_id + 1000000000, (i // 1800)::INTEGER, substring(text, i::BIGINT + 1, 2000) FROM (
  SELECT doc_id, text, unnest(range(0, length(text), 1800)) AS i FROM documents)""")
def c02(t):
    run = seg.overlap_chunks(docs(t), 2000, 200, tail="run").withColumn("doc_id", F.col("doc_id") + 1000000000)
    return seg.overlap_chunks(docs(t), 1000, 300).unionByName(run)


def _rows(parts: str, where: str = "true") -> str:
    return f"SELECT doc_id, (p - 1)::INTEGER AS sent_no, s AS sentence FROM (SELECT doc_id, unnest(x) AS s, generate_subscripts(x, 1) AS p FROM (SELECT doc_id, {parts} AS x FROM documents)) WHERE {where}"


@query("c03_split_sentences", f"""
SELECT 'trim' AS variant, * FROM ({_rows(q.sentences('text'))})
UNION ALL SELECT 'long', * FROM ({_rows(f"[{q.strip('z')} FOR z IN {q.marked_sentences('text')} IF {q.strip('z')} <> '' AND length(z) > 15]")})
UNION ALL SELECT 'space', * FROM ({_rows(r"string_split(regexp_replace(text, '([.!?]) +', '\1␞', 'g'), '␞')")})""")
def c03(t):
    parts = [seg.split_sentences(docs(t), v).select(F.lit(v).alias("variant"), "doc_id", "sent_no", "sentence") for v in ("trim", "long", "space")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _safe(x: str) -> str:
    x = rf"regexp_replace(regexp_replace({x}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
    for p, r in (
        (rf"(?i)(^|{q.NOT_WORD})(Figs?|Eqs?|Refs?|Tab|Table)\.(\s+\d+)", r"\1\2․\3"),
        (rf"(?i)(^|{q.NOT_WORD})(et al|vs|cf|ca|i\.e|e\.g|Dr|Mr|Mrs|Ms|Prof)\.", r"\1\2․"),
        (r"([a-zA-Z])\.([a-zA-Z])\.", r"\1․\2․"),
        (r"\s*([.!?])\s+([A-Z])", r"\1␞\2"),
        (r"([.!?]\s*[)\]\"''}›»]*)\s*\n\s*", r"\1␞"),
    ):
        x = f"regexp_replace({x}, '{p}', '{r}', 'g')"
    sent = rf"regexp_replace(replace({q.strip('z')}, '․', '.'), ' +', ' ', 'g')"
    return rf"[y FOR y IN [{sent} FOR z IN string_split({x}, '␞')] IF {q.n_words('y')} >= 6 AND regexp_matches(y, '[.!?][)\]\"''}}›»]*$')]"


@query("c04_split_sentences_safe", f"SELECT doc_id, sent_no + 1 AS sent_no, sentence FROM ({_rows(_safe('text'))})")
def c04(t):
    return seg.split_sentences_safe(docs(t))


@query("c05_repair_overmerged", f"""
WITH e AS {E}, n AS (SELECT *, length({S}) AS n, lag(length({S})) OVER (PARTITION BY doc_id ORDER BY pos) AS prev, count(*) OVER (PARTITION BY doc_id) AS k FROM e),
v AS (SELECT doc_id, max(pos) AS st FROM n WHERE k > 1 AND regexp_matches(l, '^\\s*[A-Z][a-z]{{2,}}') AND ((pos = 0 AND n >= 50) OR (pos > 0 AND n >= 25 AND prev <= 49)) GROUP BY 1),
j AS (SELECT n.doc_id, string_agg(l, ' ' ORDER BY pos) AS s FROM n JOIN v ON n.doc_id = v.doc_id AND n.pos >= v.st GROUP BY 1)
SELECT doc_id, CASE WHEN s IS NULL THEN {q.strip('text')} ELSE {q.squash('s')} END AS text FROM documents LEFT JOIN j USING (doc_id)""".replace("\\\\", "\\"))
def c05(t):
    return seg.repair_overmerged(docs(t), min_len=25)


def packed(parts: str, size: str, prefix: str, fits: str, joined: str, body: str) -> str:
    """Chunks of greedy packing: the state of done chunks and the open one is reduced over the parts."""
    emit = f"CASE WHEN {body} = '' THEN a.done ELSE list_append(a.done, {prefix} || {body}) END"
    step = f"CASE WHEN {fits} THEN {{done: a.done, cur: {joined}}} ELSE {{done: {emit}, cur: x.cur}} END"
    red = f"list_reduce(list_concat([{{done: []::VARCHAR[], cur: ''}}], [{{done: []::VARCHAR[], cur: s}} FOR s IN {parts}]), lambda a, x: {step})"
    return f"(SELECT * EXCLUDE (a), {emit} AS chunks FROM (SELECT *, {red} AS a FROM src))"


def notion_packed(size: int, prefix: str) -> str:
    room = f"({size} - length({prefix}))"
    joined = "CASE WHEN a.cur = '' THEN x.cur ELSE a.cur || ' ' || x.cur END"
    pieces = f"flatten([[substring(s, i * {room} + 1, {room}) FOR i IN range(0, (length(s) - 1) // {room} + 1)] FOR s IN {q.sentences('text')}])"
    return packed(pieces, room, prefix, f"length({joined}) <= {room}", joined, "a.cur")


@query("c06_pack_sentences", f"""
WITH src AS (SELECT doc_id, text, 'Notion: ' || lang || chr(10) || chr(10) AS pre FROM documents), p AS {notion_packed(1500, 'pre')}
SELECT doc_id, (generate_subscripts(chunks, 1) - 1)::INTEGER AS chunk_no, unnest(chunks) AS chunk FROM p""")
def c06(t):
    return seg.pack_sentences(t.documents.select("doc_id", "lang", "text"), 1500, F.concat(F.lit("Notion: "), F.col("lang"), F.lit("\n\n"))).drop("lang")


SPACED = r"[z || ' ' FOR z IN string_split(regexp_replace(text, '([.!?]) +', '\1␞', 'g'), '␞')]"


@query("c07_pack_sentences_simple", f"""
WITH src AS (SELECT doc_id, text FROM documents), p AS {packed(SPACED, '1500', "''", "length(a.cur) + length(x.cur) - 1 < 1500", "a.cur || x.cur", q.strip('a.cur'))}
SELECT doc_id, (generate_subscripts(chunks, 1) - 1)::INTEGER AS chunk_no, unnest(chunks) AS chunk FROM p""")
def c07(t):
    return seg.pack_sentences_simple(docs(t), 1500)


@query("c08_pack_blocks")
def c08(t):
    block = F.transform(tx.lines("text"), lambda x, i: F.struct(
        F.when(F.length(x) < 60, "head").otherwise("p").alias("kind"), x.alias("text"),
        F.when(F.length(x) % 3 == 0, F.array(F.concat(F.lit("fig_"), (i % 4).cast("string")))).otherwise(F.array().cast("array<string>")).alias("figures")))
    return seg.pack_blocks(docs(t).select("doc_id", block.alias("blocks")), 1200, 100).withColumn("figures", F.array_join("figures", ","))


def recursive_sql(size: int, overlap: int) -> str:
    """The recursion level by level, each level a fold over the pieces of every text that is still open."""

    def chunk(run: str) -> str:
        body = f"array_to_string([r.t FOR r IN {run}], '')"
        return (f"CASE WHEN len({run}) = 0 OR {q.strip(body)} = '' THEN [] ELSE [{{'start': ({run})[1].s + length({body}) - length(ltrim({body}, {q.WS})), "
                f"'text': {q.strip(body)}, 'done': true}}] END")

    items = "[{'start': 0::BIGINT, 'text': text, 'done': false}]"
    for k, sep in enumerate(("chr(10) || chr(10)", "chr(10)", "'. '", "' '")):
        a, e, x, n = f"a{k}", f"e{k}", f"x{k}", f"length(e{k}.p)"
        total = f"CASE WHEN len({a}.run) > 0 THEN {a}.pos - {a}.run[1].s ELSE 0 END"
        over = f"({total} > 0 AND {total} + {n} > {size})"
        piece = f"[{{'start': {a}.pos, 'text': {e}.p, 'done': false}}]"
        out = f"CASE WHEN {n} = 0 THEN {a}.out WHEN {n} >= {size} THEN {a}.out || {chunk(a + '.run')} || {piece} WHEN {over} THEN {a}.out || {chunk(a + '.run')} ELSE {a}.out END"
        run = (f"CASE WHEN {n} = 0 THEN {a}.run WHEN {n} >= {size} THEN [] ELSE (CASE WHEN {over} THEN [r FOR r IN {a}.run IF r.s >= {a}.pos - least({overlap}, {size} - {n})] "
               f"ELSE {a}.run END) || [{{'s': {a}.pos, 't': {e}.p}}] END")
        none = "'out': []::STRUCT(\"start\" BIGINT, \"text\" VARCHAR, done BOOLEAN)[], 'run': []::STRUCT(s BIGINT, t VARCHAR)[]"
        parts = f"[{{{none}, 'pos': 0::BIGINT, 'p': CASE WHEN i = 1 THEN p ELSE {sep} || p END}} FOR p, i IN string_split({x}.text, {sep})]"
        fold = f"list_reduce([{{{none}, 'pos': {x}.start, 'p': ''}}] || {parts}, lambda {a}, {e}: {{'out': {out}, 'run': {run}, 'pos': {a}.pos + {n}, 'p': ''}})"
        done = f"[f.out || {chunk('f.run')} FOR f IN [{fold}]][1]"
        items = f"flatten(list_transform({items}, lambda {x}: CASE WHEN {x}.done OR NOT contains({x}.text, {sep}) THEN [{x}] ELSE {done} END))"
    step = size - min(overlap, size - 1)
    cut = f"substr(y.text, i * {step} + 1, {size})"
    windows = (f"[{{'start': y.start + i * {step} + length({cut}) - length(ltrim({cut}, {q.WS})), 'text': {q.strip(cut)}, 'done': true}} "
               f"FOR i IN range(0, 1 + greatest(0, ceil((length(y.text) - {size}) / {step})::BIGINT)) IF {q.strip(cut)} <> '']")
    items = f"flatten(list_transform({items}, lambda y: CASE WHEN y.done THEN [y] ELSE {windows} END))"
    return f"""SELECT doc_id, (k - 1)::INTEGER AS chunk_no, c.start::INTEGER AS "start", c.text AS chunk FROM (
      SELECT doc_id, unnest(cs) AS c, generate_subscripts(cs, 1) AS k FROM (SELECT doc_id, {items} AS cs FROM documents))"""


@query("c09_recursive_chunks", recursive_sql(*seg.MODEL_PRESETS["all-MiniLM-L6-v2"][1:]))
def c09(t):
    return seg.recursive_chunks(docs(t), "all-MiniLM-L6-v2")


@query("c10_extract_captions", f"""
SELECT doc_id, 1 AS caption_no, 'Fig. ' || (doc_id % 9 + 1) || '.' AS label, {q.strip('ls[1]')} AS body FROM (SELECT doc_id, {q.lines('text')} AS ls FROM documents)
UNION ALL SELECT doc_id, 2, 'Supplementary Fig 2:', lang FROM documents
UNION ALL SELECT doc_id, 0, 'text', {q.strip('text')} FROM documents""")
def c10(t):
    d = t.documents.select("doc_id", F.concat(
        F.lit("Fig. "), (F.col("doc_id") % 9 + 1).cast("string"), F.lit(". "), derive.first_line(), F.lit("\n\n"), F.col("text"),
        F.lit("\n\nSupplementary Fig 2: "), F.col("lang")).alias("text"))
    out = seg.extract_captions(d)
    rest = out.select("doc_id", F.lit(0).alias("caption_no"), F.lit("text").alias("label"), tx.strip("text").alias("body"))
    return seg.caption_rows(out).unionByName(rest)


@query("c11_split_panels", f"""
SELECT doc_id, label, {q.strip('panel')} AS panel FROM (
  SELECT doc_id, unnest(['a', 'b', 'c']) AS label, unnest(['a) ' || regexp_replace(a, '[()]', '', 'g'), 'b) ' || lang || ' second panel', 'C) ' || source || ' third panel']) AS panel
  FROM (SELECT doc_id, lang, source, {q.squash('text')} AS a FROM documents))
WHERE length({q.strip('panel')}) > 10""")
def c11(t):
    body = F.regexp_replace(tx.squash("text"), "[()]", "")
    d = t.documents.select("doc_id", F.concat(F.lit("(a) "), body, F.lit(" (b) "), F.col("lang"), F.lit(" second panel C) "), F.col("source"), F.lit(" third panel")).alias("text"))
    return seg.split_panels(d).select("doc_id", "label", "panel")


@query("c12_split_references", """
SELECT doc_id, left(text, floor(length(text) * 0.8)::BIGINT) AS body, substring(text, floor(length(text) * 0.8)::BIGINT + 1) AS refs FROM documents
UNION ALL SELECT conv_id * 1000 + turn + 1000000000, text || chr(10) || 'References' || chr(10), role FROM conversations""")
def c12(t):
    conv = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn") + 1000000000).alias("doc_id"),
                                  F.concat("text", F.lit("\nReferences\n"), "role").alias("text"))
    return seg.split_references(docs(t).unionByName(conv)).select("doc_id", "body", "refs")


@query("c13_find_reference_block", f"""
SELECT doc_id, CASE WHEN n >= 5 THEN length(text) + 1 END AS block_start,
  (CASE WHEN n >= 5 THEN length(text) + 1 + length('References') + 1 + nl + 1 END)::BIGINT AS block_end FROM (
  SELECT doc_id, text, len({q.lines('text')}) AS n, list_sum([length(x) FOR x IN {q.lines('text')}]) + len({q.lines('text')}) - 1
    + list_sum([length((i // 2 + 1)::VARCHAR) + 2 FOR i IN range(0, len({q.lines('text')}), 2)]) AS nl FROM documents)""")
def c13(t):
    d = t.documents.select("doc_id", F.concat("text", F.lit("\nReferences\n"), derive.numbered_lines(), F.lit("\nAppendix\n"), "lang").alias("text"))
    return seg.find_reference_block(d).select("doc_id", F.col("block_start").cast("long").alias("block_start"), F.col("block_end").cast("long").alias("block_end"))


@query("c14_parse_numbered_refs", f"""
SELECT doc_id, (pos // 2 + 1)::INTEGER AS num, {q.strip("string_agg(" + S + ", ' ' ORDER BY pos)")} AS ref FROM {E} GROUP BY doc_id, pos // 2""")
def c14(t):
    return seg.parse_numbered_refs(t.documents.select("doc_id", derive.numbered_lines().alias("text")))


TITLE = (rf"({S} <> '' AND {q.n_words('l')} <= 4 AND regexp_matches({S}, '^\p{{Lu}}') AND NOT suffix({S}, '.')"
         rf" AND (regexp_matches({S}, '(?i)Section\s+\d+|Supplementary\s+Figure|Extended Data\s+Figure|Methods|Homodyne|Experimental')"
         rf" OR regexp_split_to_array({S}, '\s+')[1] NOT IN ('Both', 'This', 'We', 'In', 'At', 'For', 'Typical')))")


@query("c15_split_supplement", f"""
WITH e AS (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS pos FROM (SELECT doc_id, list_concat(['Setup of ' || lang], {q.lines('text')}, ['Methods', source]) AS ls FROM documents)),
f AS (SELECT *, {TITLE} AS t FROM e), g AS (SELECT *, sum(t::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM f),
s AS (SELECT doc_id, run, max(l) FILTER (WHERE t) AS title, count(*) AS n, string_agg(l, chr(10) ORDER BY pos) FILTER (WHERE NOT t) AS c FROM g WHERE run > 0 GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY run) AS no FROM s WHERE n > 1)
SELECT doc_id, no::INTEGER AS section_no, printf('%02d_', no::INTEGER) || regexp_replace({q.strip('title')}, '[^\\p{{L}}\\p{{N}}_]+', '_', 'g') AS section, {q.strip('c')} AS content FROM k""".replace("\\\\", "\\"))
def c15(t):
    d = t.documents.select("doc_id", F.concat(F.lit("Setup of "), "lang", F.lit("\n"), "text", F.lit("\nMethods\n"), "source").alias("text"))
    return seg.split_supplement(d)


@query("c17_number_bullets", f"""
SELECT doc_id, b AS bullet, printf('BP_%03d', p::INTEGER) AS bullet_id FROM (SELECT doc_id, unnest(x) AS b, generate_subscripts(x, 1) AS p FROM (
  SELECT doc_id, [y FOR y IN [regexp_replace({S}, '^[•\\-*]+\\s*', '') FOR l IN {q.lines('text')}] IF y <> ''] AS x FROM documents))""".replace("\\\\", "\\"))
def c17(t):
    return seg.number_bullets(t.documents.select("doc_id", F.array_join(F.transform(tx.lines("text"), lambda x, i: F.concat(
        F.when(i % 2 == 0, "• ").otherwise(" "), x)), "\n").alias("text")))


@query("c18_split_slides", f"""
SELECT conv_id, turn, (p - 1)::INTEGER AS slide_pos, 'Slide ' || p || ': ' || x || chr(10) AS slide FROM (
  SELECT conv_id, turn, unnest({q.lines('text')}) AS x, generate_subscripts({q.lines('text')}, 1) AS p FROM conversations)
UNION ALL SELECT conv_id, turn + 1000, 0, text FROM conversations""")
def c18(t):
    c = t.conversations.select("conv_id", "turn", F.concat(F.lit("intro\n"), F.array_join(F.transform(tx.lines("text"), lambda x, i: F.concat(
        F.lit("Slide "), (i + 1).cast("string"), F.lit(": "), x, F.lit("\n"))), "")).alias("text"))
    plain = t.conversations.select("conv_id", (F.col("turn") + 1000).alias("turn"), "text")
    return seg.split_slides(c.unionByName(plain))


PLAN_LINES = f"(SELECT conv_id, turn, role, unnest({q.lines('text')}) AS x, generate_subscripts({q.lines('text')}, 1) - 1 AS i FROM conversations)"


def parsed_plans(t):
    c = t.conversations.select("conv_id", "turn", "role", derive.plan_text().alias("text"))
    return seg.parse_plan_blocks(seg.split_plan_blocks(c))


@query("c19_parse_plan_blocks", f"""
SELECT conv_id, turn, i::INTEGER AS block_no, 'Group ' || (i + 1) AS group_name, (2 * i + 1)::INTEGER AS slide_from, (2 * i + 2)::INTEGER AS slide_to,
  role AS purpose, {q.strip('x')} AS content_scope, CASE WHEN i % 2 = 0 THEN 'none' ELSE {q.strip('x')} END AS key_transitions,
  'a|b|c' AS key_terms, 'Figure ' || (i % 3) AS figures, (2 * i + 1) || '=' || {q.strip('x')} || '|' || (2 * i + 2) || '=end of part' AS slides FROM {PLAN_LINES}""")
def c19(t):
    return parsed_plans(t).select(
        "conv_id", "turn", "block_no", "group_name", "slide_from", "slide_to", "purpose", "content_scope", "key_transitions",
        F.array_join("key_terms", "|").alias("key_terms"), F.array_join("available_figures", "|").alias("figures"),
        F.array_join(F.transform("slides", lambda s: F.concat(s["slide_id"].cast("string"), F.lit("="), s["plan"])), "|").alias("slides"))


def _items(fmt_tail: str) -> str:
    return rf"string_split(regexp_replace(text, '(^|[^0-9A-Za-z])([a-z]\s*{fmt_tail}\s*[A-ZÉÈÊÀÇÎÔÛÂ])', '\1␞\2', 'g'), '␞')"


@query("c20_split_exercises", rf"""
WITH p AS (SELECT doc_id, unnest(x) AS s, generate_subscripts(x, 1) - 1 AS k FROM (SELECT doc_id, {_items(chr(92) + '.')} AS x FROM documents)),
i AS (SELECT *, CASE WHEN k > 0 THEN ascii(s) - 96 END AS placement FROM p),
l AS (SELECT *, lag(placement) OVER (PARTITION BY doc_id ORDER BY k) AS prev FROM i),
g AS (SELECT *, 1 + sum(CASE WHEN placement < prev THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS grp FROM l)
SELECT doc_id, grp::INTEGER AS grp, (row_number() OVER (PARTITION BY doc_id, grp ORDER BY k) - CASE WHEN grp = 1 THEN 1 ELSE 0 END)::INTEGER AS item_no,
  placement::INTEGER AS placement, {q.strip('s')} AS item FROM g""")
def c20(t):
    return seg.split_exercises(docs(t), "E")


@query("c21_bracket_citations", """
SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat([7, 12, doc_id % 30], [x::BIGINT FOR x IN regexp_extract_all(text, '\\[(\\d{1,4})\\]', 1)]))), ',') AS citations FROM documents""".replace("\\\\", "\\"))
def c21(t):
    cited = F.concat_ws(" ", "text", F.concat(F.lit("["), (F.col("doc_id") % 30).cast("string"), F.lit("] and [7], [12] [7]")))
    return seg.bracket_citations(t.documents.select("doc_id", cited.alias("text"))).select("doc_id", F.array_join("citations", ",").alias("citations"))


@query("c22_figure_tokens", """
SELECT doc_id, array_to_string(list_sort(list_distinct(['Figure ' || (doc_id % 12), 'Figure 3a', 'Supplementary Figure 2', 'Figure 2'])), ',') AS figures FROM documents""")
def c22(t):
    d = t.documents.select("doc_id", F.concat("text", F.lit(" see fig. "), (F.col("doc_id") % 12).cast("string"), F.lit(", Figure 3a and Supp. Fig. 2.")).alias("text"))
    return seg.figure_tokens(d).select("doc_id", F.array_join("figures", ",").alias("figures"))


@query("c23_normalize_refs", f"""
SELECT doc_id, {q.squash('t')} || ' . (fig fig_' || (doc_id % 4) || ': 3(a)) and (fig 7: Figure 7) (fig unknown: b)' AS text,
  array_to_string(list_sort(['fig_' || (doc_id % 4) || ': 3(a)', '7: Figure 7', 'unknown: b']), ',') AS figures
FROM (SELECT doc_id, translate(text, '<>&()', '     ') AS t FROM documents)""")
def c23(t):
    d = t.documents.select("doc_id", F.concat(F.translate("text", "<>&()", "     "), F.lit(
        " <ref type=\"bibr\" target=\"#b1\">[1]</ref>. <ref target=\"#fig_"), (F.col("doc_id") % 4).cast("string"), F.lit(
        "\" type=\"figure\">3(a)</ref> and <ref type=\"figure\">Figure 7</ref> <ref type=\"figure\">b</ref>")).alias("text"))
    return seg.normalize_refs(d).select("doc_id", "text", F.array_join("figures", ",").alias("figures"))


@query("c23_chunk_figures", f"""
SELECT doc_id, {q.strip('text')} || chr(10) AS clean, 'fig_' || (doc_id % 5) || ':2(b)' AS mentions FROM documents""")
def c23b(t):
    d = t.documents.select("doc_id", F.concat("text", F.lit("\nFigures used in this chunk:\n#fig_"), (F.col("doc_id") % 5).cast("string"), F.lit(": 2(b)\n")).alias("text"))
    return seg.chunk_figures(d).select("doc_id", "clean", F.array_join(F.transform("mentions", lambda m: F.concat(m["fig_id"], F.lit(":"), m["label"])), ",").alias("mentions"))


@query("c24_extract_doi", """
SELECT p_partkey, '10.1103/' || p_size || '.' || p_partkey AS doi, '10.1103' AS prefix FROM part
UNION ALL SELECT page_id, nullif(regexp_extract(html, '(?i)(10\\.\\d{4,9}/[-._;()/:A-Z0-9]+)', 1), ''), nullif(string_split(regexp_extract(html, '(?i)(10\\.\\d{4,9}/[-._;()/:A-Z0-9]+)', 1), '/')[1], '') FROM pages""".replace("\\\\", "\\"))
def c24(t):
    p = t.part.select("p_partkey", F.concat("p_name", F.lit(", doi:https://doi.org/10.1103/"), F.col("p_size").cast("string"), F.lit("."), F.col("p_partkey").cast("string"), F.lit(" ok")).alias("text"))
    pages = t.pages.select(F.col("page_id").alias("p_partkey"), F.col("html").alias("text"))
    return seg.extract_doi(p.unionByName(pages)).select("p_partkey", "doi", "prefix")


@query("c25_pdf_candidates", """
WITH p AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '10.1103/' WHEN 1 THEN '10.1038/' ELSE '10.48550/arXiv.' END || p_partkey AS doi,
  CASE WHEN p_size % 2 = 0 THEN 'https://arxiv.org/abs/' || (1000 + p_size) || '.00001' ELSE 'https://doi.org/x' END AS link, lower(p_brand) AS pub FROM part),
c AS (SELECT p_partkey, doi, unnest([
  {u: link, r: true}, {u: CASE WHEN doi LIKE '%arXiv%' THEN 'https://arxiv.org/pdf/' || split_part(doi, '/', -1) || '.pdf' END, r: false},
  {u: CASE WHEN link LIKE '%arxiv%' THEN 'https://arxiv.org/pdf/' || split_part(link, '/', -1) || '.pdf' END, r: false},
  {u: CASE WHEN doi LIKE '10.1103/%' THEN 'https://link.aps.org/doi/' || doi END, r: true}, {u: CASE WHEN doi LIKE '10.1103/%' THEN 'https://journals.aps.org/pdf/' || doi END, r: true},
  {u: 'https://www.science.org/doi/pdf/' || doi, r: true}, {u: 'https://www.science.org/doi/full/' || doi, r: true},
  {u: CASE WHEN doi LIKE '10.1038/%' THEN 'https://www.nature.com/articles/' || split_part(doi, '/', 2) || '.pdf' END, r: true},
  {u: 'https://link.springer.com/content/pdf/' || doi || '.pdf', r: true}, {u: 'https://onlinelibrary.wiley.com/doi/pdf/' || doi, r: true},
  {u: 'https://onlinelibrary.wiley.com/doi/epdf/' || doi, r: true}, {u: 'https://doi.org/' || doi, r: false},
  {u: CASE WHEN contains(pub, 'plos') THEN 'https://journals.plos.org/plosone/article/file?id=' || doi || '&type=printable' END, r: true},
  {u: link, r: false}]) AS x, generate_subscripts(range(14), 1) AS k FROM p),
d AS (SELECT p_partkey, doi, x.u AS u, min(k) AS k, arg_min(x.r, k) AS r FROM c WHERE x.u IS NOT NULL GROUP BY ALL)
SELECT p_partkey, doi, (row_number() OVER (PARTITION BY p_partkey ORDER BY k) - 1)::INTEGER AS cand_rank, u AS pdf_url, CASE WHEN r THEN 'https://doi.org/' || doi END AS referer FROM d""")
def c25(t):
    key = F.col("p_partkey").cast("string")
    doi = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("10.1103/"), key)).when(F.col("p_size") % 3 == 1, F.concat(F.lit("10.1038/"), key)).otherwise(
        F.concat(F.lit("10.48550/arXiv."), key))
    link = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("https://arxiv.org/abs/"), (1000 + F.col("p_size")).cast("string"), F.lit(".00001"))).otherwise("https://doi.org/x")
    p = t.part.select("p_partkey", doi.alias("doi"), F.array(link).alias("links"), link.alias("url"), F.col("p_brand").alias("publisher"))
    return seg.pdf_candidates(p)


@query("c26_extract_json", """
SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE regexp_extract(props, '(\\d+)', 1)::BIGINT END AS k, event_type <> 'error' AS ok FROM events""".replace("\\\\", "\\"))
def c26(t):
    p = F.col("props")
    raw = (F.when(F.col("event_type") == "view", F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(F.col("event_type") == "click", F.concat(F.lit("Answer: "), p, F.lit(" done")))
           .when(F.col("event_type") == "purchase", F.concat(p, F.lit(" and {broken}"))).when(F.col("event_type") == "signup", F.concat(
               F.lit("{\"note\": \"two\nlines\", "), F.substring(p, 2, 10000))).otherwise(F.replace(p, F.lit("}"), F.lit(""))))
    out = seg.extract_json(t.events.select("event_id", raw.alias("raw")))
    return out.select("event_id", F.try_variant_get(F.try_parse_json("json"), "$.k", "bigint").alias("k"), F.col("json").isNotNull().alias("ok"))


@query("c26_extract_json_items", """
SELECT event_id, 1 AS pos, replace(props, ': ', ': ') AS item FROM events UNION ALL SELECT event_id, 2, props FROM events
UNION ALL SELECT event_id, 3, '"' || event_type || '"' FROM events""")
def c26b(t):
    raw = F.concat(F.lit("one "), "props", F.lit(" two ["), "props", F.lit(", \""), "event_type", F.lit("\"] [broken"))
    out = seg.extract_json_items(t.events.select("event_id", raw.alias("raw")))
    return out.select("event_id", F.posexplode("items").alias("p", "item")).select("event_id", (F.col("p") + 1).alias("pos"), "item")


@query("c27_tagged_lines", f"""
SELECT doc_id, array_to_string(CASE WHEN doc_id % 3 = 0 THEN [{q.strip('y')} FOR y IN ls IF {q.strip('y')} <> '']
  ELSE [{q.strip("'[MAIN] ' || y")} FOR y IN ls] END, chr(10)) AS lines FROM (SELECT doc_id, {q.lines('text')} AS ls FROM documents)""")
def c27(t):
    marked = F.array_join(F.flatten(F.transform(tx.lines("text"), lambda x: F.array(F.concat(F.lit("- [MAIN] "), x), F.lit("3) other")))), "\n")
    d = t.documents.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(marked).alias("raw"))
    return seg.tagged_lines(d, ["MAIN", "FIG"]).select("doc_id", F.array_join("lines", "\n").alias("lines"))


@query("c28_flatten_variant", """
SELECT event_id, 'k: ' || regexp_extract(props, '(\\d+)', 1) || chr(10) || 'list: k: ' || regexp_extract(props, '(\\d+)', 1) || chr(10) || event_type AS lines FROM events""".replace("\\\\", "\\"))
def c28(t):
    raw = F.concat(F.lit("["), "props", F.lit(", {\"list\": ["), "props", F.lit(", \""), "event_type", F.lit("\"]}]"))
    return seg.flatten_variant(t.events.select("event_id", raw.alias("raw")), "raw").select("event_id", "lines")


@query("c29_labelled_lines", f"""
WITH v AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN nullif({q.strip('ls[1]')}, '') END AS NEXT_CONTEXT, CASE WHEN role = 'user' THEN 'Figure 1, none' END AS FIGURES
  FROM (SELECT *, {q.lines('text')} AS ls FROM conversations))
SELECT conv_id, turn, NEXT_CONTEXT, FIGURES, last_value(NEXT_CONTEXT IGNORE NULLS) OVER w AS NEXT_CONTEXT_carried, last_value(FIGURES IGNORE NULLS) OVER w AS FIGURES_carried
FROM v WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)""")
def c29(t):
    body = F.concat("text", F.when(F.col("turn") % 3 == 1, F.concat(F.lit("\nNEXT_CONTEXT: "), derive.first_line())).otherwise(""),
                    F.when(F.col("role") == "user", "\nFIGURES: Figure 1, none").otherwise(""))
    return seg.labelled_lines(t.conversations.select("conv_id", "turn", body.alias("text")), ["NEXT_CONTEXT", "FIGURES"], "conv_id", "turn").drop("text")


@query("c30_section_roles", f"""
WITH s AS (SELECT conv_id, turn, len({q.lines('text')}) AS n, regexp_matches(text, '(?i)Methods|Supplementary Material') AS kw FROM conversations),
b AS (SELECT conv_id, max(CASE WHEN turn = 0 THEN n END) AS n0, max(CASE WHEN turn = 1 THEN n END) AS n1, min(CASE WHEN NOT kw AND n >= 3 THEN turn END) AS plain FROM s GROUP BY 1),
m AS (SELECT conv_id, CASE WHEN n0 >= 5 THEN 0 WHEN n1 >= 5 THEN 1 ELSE coalesce(plain, 0) END AS main_start, coalesce(n0 >= 5 OR n1 >= 5, false) AS sure FROM b),
x AS (SELECT conv_id, min(turn) AS supp_start FROM s JOIN m USING (conv_id) WHERE turn > main_start AND (n >= 3 OR (NOT sure AND kw)) GROUP BY 1)
SELECT conv_id, turn, CASE WHEN turn < main_start THEN 'front' WHEN turn >= supp_start THEN 'supplement' ELSE 'main' END AS role FROM s JOIN m USING (conv_id) LEFT JOIN x USING (conv_id)""")
def c30(t):
    s = t.conversations.select("conv_id", "turn", F.size(tx.lines("text")).alias("n_paras"), "text")
    return seg.section_roles(s, "conv_id", "turn").select("conv_id", "turn", "role")
