"""Cleaning queries (B) over documents, pages, conversations, events and part."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import text as tx
from scriptorium.operators import clean
from scriptorium.plans import sqltext as q
from scriptorium.plans.registry import query

S = q.strip("l")
TOKENS = rf"regexp_split_to_array({S}, '\s+')"

AXIS = (
    f"(length({S}) <= 2 OR {q.has(S, r'^[\d\s.()×eE\-+]+$')}"
    f" OR {q.has(S, q.bounded('kHz|Hz|s|ms|nm|μm|cm|dB|mol|K'))}"
    f" OR {q.has(S, q.WORD + '(°C|×10)($|' + q.NOT_WORD + ')')}"
    f" OR (len({TOKENS}) >= 3 AND len([x FOR x IN {TOKENS} IF length(x) < 3]) > len({TOKENS}) / 2.0))"
)


def _occurs(c: str) -> str:
    return f"(length({S}) - length(replace({S}, '{c}', '')))"


EQUATION = (
    f"({S} <> '' AND length({S}) <= 100 AND ({q.has(S, r'^[±√∞α-ωΑ-Ω0-9∇=+\-*/^≈∑∏∫≤≥≠÷⋅×·]+$')}"
    f" OR ({q.has(S, '[α-ωΑ-Ω]')} AND {q.count(S, q.WORD)} < 3)"
    f" OR {_occurs('=')} > 1 OR {_occurs('+')} > 2 OR {_occurs('–')} > 1))"
)
SUBMISSION = "Received|Accepted|Submitted|Revised|Published|Publication|Online|Posted|Issued"
METADATA_OF = lambda s: (
    f"({s} <> '' AND (contains({s}, '@') OR ({q.has(s, '(?i)' + q.bounded(SUBMISSION))} AND {q.has(s, r'\d{4}')})"
    f" OR {q.has(s, q.bounded(r'Volume|Vol|Issue|pp?\.?\s*\d+[–-]\d+'))}"
    f" OR {q.has(s, q.WORD + r'\|\s*\d+\s*[–-]\d+($|' + q.NOT_WORD + ')')}))"
)
METADATA = METADATA_OF(S)
AUTHOR_OF = lambda s: (
    f"({s} <> '' AND length({s}) <= 600 AND {q.count(s, chr(92) + 'p{Lu}')} > 1"
    f" AND {q.count(s, r'[\p{L}\p{N}_.\-]*\p{L}[\p{L}\p{N}_.\-]*')} > 0"
    f" AND {q.count(s, chr(92) + 'p{Lu}')}::DOUBLE / {q.count(s, r'[\p{L}\p{N}_.\-]*\p{L}[\p{L}\p{N}_.\-]*')} >= 0.6)"
)
AUTHOR = AUTHOR_OF(S)
RUNNING = (
    f"({q.has(S, r'^https?://|^DOI|^doi|^www\.|^Nature|^Science|^arXiv')} OR {q.has(S, r'^\d{1,3}\s*$')}"
    f" OR {q.has(S, r'^\(?\d{4}\)?$')} OR {q.has(S, r'^[A-Z][A-Za-z,\-\s]+et al\.$')}"
    f" OR {q.has(S, r'^[A-Z][A-Za-z\-\s]+[A-Z][A-Za-z\-\s]+$')})"
)
JUNK = f"(length({S}) < 100 AND ({q.has(S, r'^\d+$')} OR {q.has(S, '^https?://')} OR {q.has(S, '^[A-Z]{3,}$')}))"
CAPS = (
    f"({S} <> '' AND length({S}) < 180 AND {q.count(S, chr(92) + 'p{L}')} > 0"
    f" AND {q.count(S, chr(92) + 'p{Lu}')}::DOUBLE / {q.count(S, chr(92) + 'p{L}')} > 0.45)"
)


def _docs(cond: str) -> str:
    return f"SELECT doc_id, {q.keep_lines('text', f'NOT {cond}')} AS text FROM documents"


@query("b01_normalize_ws", r"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\r\n|\r', chr(10), 'g'),
       '\n{3,}', chr(10) || chr(10), 'g') AS text FROM documents""")
def b01(t):
    return clean.normalize_ws(t.documents.select("doc_id", "text"))


@query("b02_normalize_match", r"""
SELECT doc_id AS id, regexp_replace(replace(lower(text), '-', ' '), '[^a-z0-9\s]', '', 'g') AS norm FROM documents
UNION ALL SELECT p_partkey, regexp_replace(replace(lower(p_name), '-', ' '), '[^a-z0-9\s]', '', 'g') FROM part""")
def b02(t):
    both = t.documents.select(F.col("doc_id").alias("id"), "text").unionByName(
        t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")))
    return clean.normalize_match(both).select("id", "norm")


KEEP = r"[^\p{L}\p{N}_\s\-().\[\]]+"


@query("b03_safe_key", rf"""
SELECT doc_id,
  left(trim(regexp_replace(regexp_replace(replace(strip_accents(text), 'ß', 'ss'), '{KEEP}', '', 'g'), '\s+', '_', 'g'), '_'), 120) AS folded,
  left(trim(regexp_replace(regexp_replace(text, '{KEEP}', '', 'g'), '\s+', '_', 'g'), '_'), 120) AS basic,
  left(trim(regexp_replace(regexp_replace(text, '[\\/*?:"<>|]', '', 'g'), '\s+', '_', 'g'), '_'), 120) AS path,
  left(replace(regexp_replace(text, '[\\/*?:"<>|]', '', 'g'), ' ', '_'), 80) AS short,
  left(trim(regexp_replace(regexp_replace(text, '[^\p{{L}}\p{{N}}_\s\-]', '', 'g'), '\s+', '_', 'g'), '_'), 100) AS title
FROM documents""")
def b03(t):
    df = t.documents.select("doc_id", "text")
    return df.select("doc_id", *[clean.safe_key_expr("text", v).alias(v) for v in ("folded", "basic", "path", "short", "title")])


@query("b04_token_set", """
SELECT doc_id, len(toks)::INTEGER AS n_tokens, array_to_string(list_sort(toks), ' ') AS tokens FROM (
  SELECT doc_id, list_distinct([x FOR x IN regexp_extract_all(lower(text), '[a-z0-9]+') IF length(x) >= 4]) AS toks FROM documents)""")
def b04(t):
    df = clean.token_set(t.documents.select("doc_id", "text"))
    return df.select("doc_id", F.size("tokens").alias("n_tokens"), F.array_join(F.array_sort("tokens"), " ").alias("tokens"))


@query("b05_first_string", """
SELECT event_id AS id, props AS value FROM events
UNION ALL SELECT p_partkey, string_split(p_name, ' ')[1] FROM part
UNION ALL SELECT o_orderkey, o_orderstatus FROM orders""")
def b05(t):
    scalars = clean.first_string(t.events.select(F.col("event_id").alias("id"), "props"), "props")
    arrays = clean.first_string(t.part.select(F.col("p_partkey").alias("id"), F.split("p_name", " ").alias("v")), "v")
    lists = clean.first_string(t.orders.select(F.col("o_orderkey").alias("id"), F.to_json(F.array("o_orderstatus", "o_orderpriority")).alias("v")), "v")
    return scalars.select("id", "value").unionByName(arrays.select("id", "value")).unionByName(lists.select("id", "value"))


@query("b06_assemble_queries", f"""
WITH c AS (SELECT conv_id, turn, text, role, [x FOR x IN {q.lines('text')} IF {q.strip('x')} <> ''] AS bl FROM conversations)
SELECT conv_id, turn, 'PLAN: ' || text || CASE WHEN role = 'user' THEN chr(10) || 'CONTEXT: user' ELSE '' END
  || CASE WHEN len(bl) > 0 THEN chr(10) || chr(10) || 'PRIMARY BULLETS:' || chr(10) || array_to_string(['- ' || x FOR x IN bl], chr(10)) ELSE '' END
  || CASE WHEN {q.strip('bl[1]')} <> '' THEN chr(10) || chr(10) || 'BULLET REQUIREMENTS:' || chr(10) || '- (' || upper(role) || ') ' || bl[1] ELSE '' END AS query
FROM c""")
def b06(t):
    c = t.conversations.select(
        "conv_id", "turn", F.col("text").alias("plan"), F.when(F.col("role") == "user", "user").otherwise("").alias("context"),
        tx.lines("text").alias("bullets"), F.upper("role").alias("level"))
    c = c.withColumn("requirements", F.array(F.struct("level", F.coalesce(F.get(F.filter(
        "bullets", lambda b: tx.strip(b) != ""), F.lit(0)), F.lit("")).alias("text"))))
    return clean.assemble_queries(c).select("conv_id", "turn", "query")


@query("b07_annotate", f"""
WITH c AS (SELECT conv_id, turn, text, role, list_filter({q.words('text')}, lambda x: length(x) >= 14) AS items FROM conversations)
SELECT conv_id, turn, role, CASE WHEN len(items) > 0 AND NOT regexp_matches(text, '(?i)tionen') THEN
  text || chr(10) || chr(10) || '[NOTE: long words: ' || array_to_string(items, ', ') || ']' ELSE text END
  || CASE WHEN role = 'user' THEN chr(10) || '[SupMat] Additional insight available — user' || chr(10) ELSE '' END AS text
FROM c""")
def b07(t):
    c = t.conversations.select("conv_id", "turn", "role", "text").withColumn("items", F.filter(tx.words("text"), lambda w: F.length(w) >= 14))
    c = clean.annotate(c, "items", mention="(?i)tionen", note="long words: ")
    c = clean.annotate_decision(c.withColumn("decision", F.when(F.col("role") == "user", "user").otherwise("NO")))
    return c.select("conv_id", "turn", "role", "text")


@query("b10_drop_axis_lines", _docs(AXIS))
def b10(t):
    return clean.drop_axis_lines(t.documents.select("doc_id", "text"))


@query("b11_drop_equation_lines", _docs(EQUATION))
def b11(t):
    return clean.drop_equation_lines(t.documents.select("doc_id", "text"))


@query("b12_drop_metadata_lines", _docs(METADATA))
def b12(t):
    return clean.drop_metadata_lines(t.documents.select("doc_id", "text"))


@query("b13_drop_author_lines", _docs(AUTHOR))
def b13(t):
    return clean.drop_author_lines(t.documents.select("doc_id", "text"))


@query("b14_drop_running_lines", f"""
SELECT doc_id, array_to_string([{S} FOR l IN {q.lines('text')} IF {S} = '' OR NOT {RUNNING}], chr(10)) AS text FROM documents""")
def b14(t):
    return clean.drop_running_lines(t.documents.select("doc_id", "text"))


@query("b15_drop_short_junk", _docs(JUNK))
def b15(t):
    return clean.drop_short_junk(t.documents.select("doc_id", "text"))


@query("b16_clean_sections", f"""
WITH e AS (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS pos FROM (SELECT doc_id, {q.lines('text')} AS ls FROM documents)),
f AS (SELECT doc_id, pos, l, {CAPS} AS caps, ({EQUATION} OR {METADATA} OR {AUTHOR} OR {JUNK}) AS bad FROM e),
g AS (SELECT *, sum(CASE WHEN caps THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) - CASE WHEN caps THEN 0 ELSE 1 END AS run FROM f),
m AS (SELECT doc_id, run, string_agg({S}, ' ' ORDER BY pos) AS s FROM g WHERE caps GROUP BY ALL),
d AS (SELECT doc_id, run, ({METADATA_OF('s')} OR {AUTHOR_OF('s')}) AS gone FROM m),
k AS (SELECT g.doc_id, pos, l FROM g LEFT JOIN d USING (doc_id, run) WHERE NOT coalesce(gone, false) AND (caps OR NOT bad)),
r AS (SELECT doc_id, string_agg(l, chr(10) ORDER BY pos) AS s FROM k GROUP BY 1)
SELECT doc_id, coalesce({q.strip('s')}, '') AS text FROM documents LEFT JOIN r USING (doc_id)""")
def b16(t):
    return clean.clean_sections(t.documents.select("doc_id", "text"))


def _wiki(col: str) -> str:
    x = rf"regexp_replace({col}, '(?i)\[citation needed\]', '', 'g')"
    for p in (r"\[\d+\]", r"\{\{[^}]{0,400}\}\}", r"<[^>]+>", r"\$[^$]{0,200}\$", r"\\\[[^\\\]]{0,400}\\\]"):
        x = f"regexp_replace({x}, '{p}', '', 'g')"
    paras = f"[{q.strip('z')} FOR z IN string_split({x}, chr(10) || chr(10))]"
    keep = f"length(p) >= 50 AND {q.count('p', '[A-Za-z0-9]')}::DOUBLE / length(p) >= 0.25"
    return rf"array_to_string([regexp_replace(p, '\s+', ' ', 'g') FOR p IN {paras} IF {keep}], chr(10) || chr(10))"


@query("b17_clean_wiki", f"SELECT doc_id AS id, {_wiki('text')} AS text FROM documents UNION ALL SELECT page_id, {_wiki('html')} FROM pages")
def b17(t):
    docs = t.documents.select(F.col("doc_id").alias("id"), "text")
    return clean.clean_wiki(docs.unionByName(t.pages.select(F.col("page_id").alias("id"), F.col("html").alias("text"))))


STOP = " OR ".join(f"contains(lower(n), '{w}')" for w in clean.NOTION_STOP + clean.NOTION_SPECIFIC)


@query("b18_filter_notions", f"""
SELECT DISTINCT doc_id, n AS notion FROM (
  SELECT doc_id, {q.strip("trim(l, '-•* ')")} AS n FROM (SELECT doc_id, unnest({q.lines('text')}) AS l FROM documents))
WHERE n <> '' AND {q.n_words('n')} <= 3 AND NOT ({STOP})""")
def b18(t):
    return clean.filter_notions(t.documents.select("doc_id", "text"))


@query("b19_valid_sentences", rf"""
SELECT doc_id, s AS text FROM (SELECT doc_id, unnest({q.sentences('text')}) AS s FROM documents)
WHERE {q.n_words('s')} >= 6 AND regexp_matches(s, '[.!?][)\]"''}}›»]*$')""")
def b19(t):
    sents = t.documents.select("doc_id", F.explode(F.filter(F.transform(
        tx.split_sentences("text"), tx.strip), lambda s: s != "")).alias("text"))
    return clean.valid_sentences(sents, 6)


@query("b20_is_header", rf"""
SELECT doc_id, count(*) AS n_headers, min(l) AS first_header FROM (SELECT doc_id, unnest({q.lines('text')}) AS l FROM documents)
WHERE {S} <> '' AND length({S}) <= 150 AND ((regexp_matches({S}, '\p{{Lu}}') AND NOT regexp_matches({S}, '\p{{Ll}}'))
  OR regexp_matches({S}, '^\d+\.') OR contains(lower({S}), 'supplementary') OR contains(lower({S}), 'method')) GROUP BY 1""")
def b20(t):
    ls = t.documents.select("doc_id", F.explode(tx.lines("text")).alias("line"))
    return clean.is_header(ls).filter("is_header").groupBy("doc_id").agg(
        F.count("*").alias("n_headers"), F.min("line").alias("first_header"))


EXPLICIT, REGIME = ["data", "result", "observed"], ["ering", "tion et", "heit", "ciones", "threshold"]


@query("b21_classify_results", f"""
SELECT doc_id, ({' OR '.join(f"contains(lower(text), '{w}')" for w in EXPLICIT)})
  OR ({' + '.join(f"contains(lower(text), '{w}')::INTEGER" for w in REGIME)}) >= 2 AS is_results FROM documents""")
def b21(t):
    return clean.classify_results(t.documents.select("doc_id", "text"), explicit=EXPLICIT, regime=REGIME).select("doc_id", "is_results")


ENDS = ["that the", "de la", "und der", "overall", "in summary"]


@query("b22_first_conclusion", f"""
SELECT conv_id, coalesce(min(turn) FILTER (WHERE {' OR '.join(f"contains(lower(text), '{w}')" for w in ENDS)}), -1) AS conclusion_at
FROM conversations GROUP BY 1""")
def b22(t):
    return clean.first_conclusion(t.conversations, "conv_id", "turn", terms=ENDS)


@query("b23_oversize_chunks", """
SELECT doc_id, length(text) AS n FROM documents WHERE length(text) > 512 * 5""")
def b23(t):
    return clean.oversize_chunks(t.documents, 512).select("doc_id", "n")


def _ids(cond: str) -> str:
    return f"array_to_string([x FOR x IN [{q.strip('z')} FOR z IN string_split(text, chr(10))] IF x <> '' AND {cond}], '|')"


@query("b24_filter_ids", rf"""
SELECT doc_id, {_ids(r"regexp_matches(x, '\d') AND length(x) > 5")} AS arxiv,
  {_ids(r"contains(x, '.') AND regexp_matches(x, '\p{L}')")} AS category FROM documents""")
def b24(t):
    df = t.documents.select("doc_id", F.col("text").alias("raw"))
    df = clean.filter_ids(clean.filter_ids(df, "arxiv", out="a"), "category", out="c")
    return df.select("doc_id", F.array_join("a", "|").alias("arxiv"), F.array_join("c", "|").alias("category"))


@query("b25_validate_specs", f"""
WITH s AS (SELECT doc_id, {q.lines('text')} AS ls, lang, source, n_chars FROM documents),
n AS (SELECT *, len([x FOR x IN ls IF {q.strip('x')} <> '']) AS n FROM s)
SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'slide_uid mismatch' WHEN {q.strip("coalesce(ls[1], '')")} = '' THEN 'missing title'
  WHEN doc_id % 3 = 0 AND lang NOT IN ('en', 'fr') THEN 'figure not suggested' WHEN n < 5 OR n > 7 THEN 'bullet count outside 5-7'
  WHEN source = 'src1' THEN 'missing transition' WHEN n_chars % 7 = 0 THEN 'empty reminder' END AS reason FROM n""")
def b25(t):
    d = t.documents
    specs = d.select(
        "doc_id", F.when(F.col("doc_id") % 50 == 0, "other").otherwise(F.col("doc_id").cast("string")).alias("slide_uid"),
        F.col("doc_id").cast("string").alias("expected_uid"), F.get(tx.lines("text"), F.lit(0)).alias("title"),
        F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("figure_used"), F.array(F.lit("en"), F.lit("fr")).alias("suggested"),
        tx.lines("text").alias("on_slide_bullets"), F.when(F.col("source") == "src1", " ").otherwise(F.col("source")).alias("transition"),
        F.when(F.col("n_chars") % 7 == 0, F.array(F.lit("a"), F.lit(" "))).otherwise(F.array("lang")).alias("reminders"))
    return clean.validate_specs(specs).select("doc_id", "reason")


def event_candidates(t):
    """Events as raw candidates: user is the bullet, a slide per event key, value the priority."""
    e = t.events
    excl = F.when(F.col("event_type") == "view", "Strong").when(F.col("event_type") == "click", "medium").when(
        F.col("event_type") == "purchase", "weak").when(F.col("event_type") == "signup", F.lit(None)).otherwise(F.col("event_type"))
    return e.select(
        F.col("event_id").alias("pos"), F.concat(F.lit("BP_"), F.col("user_id").cast("string")).alias("bullet_id"),
        F.concat(F.lit("G"), (F.col("event_id") % 7).cast("string"), F.lit("::Slide_"), F.get_json_object("props", "$.k")).alias("slide_uid"),
        F.when(F.col("value") > 300, "high").otherwise((F.col("value") / 100).cast("string")).alias("priority"),
        excl.alias("exclusivity"), F.when(F.col("value") < 5, " ").otherwise(F.col("props")).alias("argument"))


CANDIDATES_SQL = """
SELECT event_id AS pos, 'BP_' || user_id AS bullet_id, 'G' || (event_id % 7) || '::Slide_' || regexp_extract(props, '(\\d+)', 1) AS slide_uid,
  CASE WHEN value > 300 THEN 0.5 ELSE greatest(0.35, least(1.0, value / 100)) END AS priority,
  CASE event_type WHEN 'view' THEN 'strong' WHEN 'purchase' THEN 'weak' ELSE 'medium' END AS exclusivity,
  CASE WHEN value < 5 THEN 'MISSING_ARGUMENT' ELSE props END AS argument FROM events"""


@query("b26_coerce_candidates", CANDIDATES_SQL)
def b26(t):
    return clean.coerce_candidates(event_candidates(t))
