"""TEI XML scans (A).

``tei_nodes`` flattens each document to ordered node rows once; everything after it is
DataFrame logic. Header and references have a regular structure and are read by
``from_xml`` and ``xpath`` directly.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.functions import text as tx
from scriptorium.functions.neighbours import carried, numbered
from scriptorium.operators.link import tail_words

NODE = ("seq int, div int, para int, kind string, xml_id string, typ string, n string, label string, "
        "text string, tight string, in_body boolean, refs array<struct<typ:string,target:string,text:string>>")
_REF = pa.struct([(c, pa.string()) for c in ("typ", "target", "text")])
_NODE = pa.struct([(c, pa.int32()) for c in ("seq", "div", "para")] + [(c, pa.string()) for c in (
    "kind", "xml_id", "typ", "n", "label", "text", "tight")] + [("in_body", pa.bool_()), ("refs", pa.list_(_REF))])
#: Nodes, and characters of documents, after which their rows leave the worker.
FLUSH_NODES, FLUSH_CHARS = 2_000, 1 << 20
XML_ID = "{http://www.w3.org/XML/1998/namespace}id"
# Div types that hold supplementary material.
SUPPLEMENT_TYPES = ["annex", "appendix", "supplementary-material", "supplementary"]


# An ampersand that opens no entity known to XML.
BARE_AMP = "&(?!(?:#[0-9]+|#x[0-9A-Fa-f]+|amp|lt|gt|quot|apos);)"


class _Tree(ET.TreeBuilder):
    """Tree that can be closed while elements are open."""

    def __init__(self):
        super().__init__()
        self.open: list[str] = []

    def start(self, tag, attrs):
        self.open.append(tag)
        return super().start(tag, attrs)

    def end(self, tag):
        self.open.pop()
        return super().end(tag)

    def rest(self):
        while self.open:
            self.end(self.open[-1])
        return self.close()


def _parse(xml: str) -> tuple[ET.Element | None, str | None]:
    """Root of the document and, if it is not well-formed, the reason. What stands before the error is kept."""
    reason = None
    for text in (xml, re.sub(BARE_AMP, "&amp;", xml)):
        tree = _Tree()
        parser = ET.XMLParser(target=tree)
        try:
            parser.feed(text)
            parser.close()
            return tree.close(), reason
        except ET.ParseError as e:
            reason = reason or str(e)
    return (tree.rest() if tree.open else None), reason


def _flatten(xml: str) -> list[dict]:
    """Ordered div, head, p, formula, figure and bibl nodes of one document, as far as it can be read."""
    root, _ = _parse(xml)
    if root is None:
        return []
    rows: list[dict] = []
    count = {"div": 0, "para": 0}
    name = lambda e: e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""
    own_id = lambda e: e.get(XML_ID) or e.get("id")

    def first(e, tag):
        return next((x for x in e.iter() if name(x) == tag), None)

    def put(e, kind, div, para, body, text=None, label=None):
        bits = list(e.itertext()) if text is None else text
        refs = [{"typ": r.get("type"), "target": r.get("target"), "text": "".join(r.itertext()).strip()}
                for r in e.iter() if name(r) == "ref"] if kind == "p" else []
        rows.append({"seq": len(rows), "div": div, "para": para, "kind": kind, "xml_id": own_id(e), "typ": e.get("type"),
                     "n": e.get("n"), "label": label, "text": " ".join(bits), "tight": "".join(bits), "in_body": body, "refs": refs})

    def label_of(e):
        lab = first(e, "label")
        return "".join(lab.itertext()) if lab is not None else None

    def walk(e, div, body):
        for c in e:
            kind = name(c)
            if kind == "div":
                count["div"] += 1
                count["para"] = 0
                put(c, "div", count["div"], 0, body)
                walk(c, count["div"], body)
            elif kind == "p":
                count["para"] += 1
                put(c, "p", div, count["para"], body)
                for f in c.iter():
                    if name(f) == "formula":
                        put(f, "formula", div, count["para"], body, label=label_of(f))
            elif kind == "head":
                put(c, "head", div, count["para"], body)
            elif kind == "formula":
                put(c, "formula", div, count["para"], body, label=label_of(c))
            elif kind == "figure":
                head, desc = first(c, "head"), first(c, "figDesc")
                put(c, "figure", div, count["para"], body, list(desc.itertext()) if desc is not None else [],
                    " ".join(head.itertext()) if head is not None else None)
            elif kind == "biblStruct":
                put(c, "bibl", div, count["para"], body)
            else:
                walk(c, div, body or kind == "body")

    walk(root, 0, False)
    return rows


def _node_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(key, xml)`` to node rows, a few thousand at a time."""
    for b in batches:
        keys, at, rows, chars = b.column(0), [], [], 0
        for i, x in enumerate(b.column(1)):
            xml = x.as_py() or ""
            found = _flatten(xml)
            rows += found
            at += [i] * len(found)
            chars += len(xml)
            if len(rows) >= FLUSH_NODES or chars >= FLUSH_CHARS:
                yield _node_batch(keys, at, rows)
                at, rows, chars = [], [], 0
        yield _node_batch(keys, at, rows)


def tei_nodes(df: DataFrame, key: str = "doc_id", column: str = "tei") -> DataFrame:
    """Node rows of each document in reading order. They leave the worker every few documents, so its memory does not follow the size of the Arrow batches.

    A bare ampersand is text; a document that breaks off or whose tags do not match gives the nodes before that place.
    ``tei_rejects`` names all such documents.
    """

    kind = T.StructType([T.StructField(key, df.schema[key].dataType), *T.StructType.fromDDL(NODE).fields])
    return df.select(key, column).mapInArrow(_node_batches, kind)


def _node_batch(keys: pa.Array, at: list[int], rows: list[dict]) -> pa.RecordBatch:
    """Node rows of one batch, each with the key of its document ``at``."""
    key = keys.take(pa.array(at, pa.int64()))
    return pa.RecordBatch.from_arrays([key, *pa.array(rows, _NODE).flatten()], ["key", *[f.name for f in _NODE]])


def tei_rejects(df: DataFrame, key: str = "doc_id", column: str = "tei") -> DataFrame:
    """Documents that are not well-formed: key, ``reason`` and ``n_nodes`` that could be read all the same."""

    @F.pandas_udf("struct<reason:string,n_nodes:int>")
    def check(col: pd.Series) -> pd.DataFrame:
        found = [(_parse(x or "")[1], x or "") for x in col]
        return pd.DataFrame({"reason": [r for r, _ in found], "n_nodes": [len(_flatten(x)) if r else 0 for r, x in found]})

    return df.select(key, check(F.col(column)).alias("c")).select(key, "c.*").filter(F.col("reason").isNotNull())


AUTHOR = "struct<persName:struct<forename:array<struct<_VALUE:string,_type:string>>,surname:string>>"
TITLE = "array<struct<_VALUE:string,_level:string,_type:string>>"
IDNO = "array<struct<_VALUE:string,_type:string>>"
BIBL = (f"struct<`_xml:id`:string,analytic:struct<title:{TITLE},author:array<{AUTHOR}>,idno:{IDNO}>,"
        f"monogr:struct<title:{TITLE},author:array<{AUTHOR}>,idno:{IDNO},imprint:struct<publisher:string,"
        f"date:array<struct<_VALUE:string,_type:string,_when:string>>>>,idno:{IDNO}>")


def _people(authors: Column) -> Column:
    def full(a: Column) -> Column:
        first = F.get(F.filter(a["persName"]["forename"], lambda f: f["_type"] == "first"), F.lit(0))["_VALUE"]
        return tx.squash(F.concat_ws(" ", F.coalesce(first, F.lit("")), F.coalesce(a["persName"]["surname"], F.lit(""))))

    return F.filter(F.transform(authors, full), lambda x: x != "")


def _either(c: Column, kind: str) -> Column:
    return F.coalesce(c, F.array().cast(kind))


def _cut(c: Column | str, tag: str) -> Column:
    """The first element of that name as XML text, bare ampersands escaped."""
    return F.regexp_replace(F.regexp_extract(tx.col(c), f"(?s)<{tag}\\b.*?</{tag}>", 0), BARE_AMP, "&amp;")


def tei_metadata(df: DataFrame, key: str = "doc_id", column: str = "tei") -> DataFrame:
    """A-06: title (main analytic title first), authors and abstract of the header."""
    head = _cut(column, "teiHeader")
    main = F.expr("xpath_string(__h, '//title[@level=\"a\" and @type=\"main\"]')")
    any_title = F.expr("xpath_string(__h, '//title[1]')")
    paras = F.filter(F.transform(F.expr("xpath(__h, '//abstract//p//text()')"), tx.squash), lambda p: p != "")
    whole = F.expr("xpath_string(__h, '//abstract')")
    authors = F.from_xml(F.nullif(_cut("__h", "analytic"), F.lit("")), f"author array<{AUTHOR}>")
    out = df.select(key, head.alias("__h")).withColumn("__h", F.nullif("__h", F.lit("")))
    return out.select(
        key, tx.squash(F.coalesce(F.nullif(tx.squash(main), F.lit("")), any_title, F.lit(""))).alias("title"),
        _either(_people(authors["author"]), "array<string>").alias("authors"),
        F.when(F.size(paras) > 0, F.array_join(paras, " ")).otherwise(tx.squash(F.coalesce(whole, F.lit("")))).alias("abstract"))


def tei_sections(nodes: DataFrame, kind: str = "body", key: str = "doc_id") -> DataFrame:
    """A-07: title and text of each div; ``supplement`` takes divs marked so by type or heading."""
    head = F.max(F.when(F.col("kind") == "head", F.struct(-F.col("seq"), tx.squash("text").alias("t"))))["t"]
    paras = F.array_sort(F.collect_list(F.when(F.col("kind") == "p", F.struct("seq", tx.squash("text").alias("t")))))
    typ = F.max(F.when(F.col("kind") == "div", F.col("typ")))
    secs = nodes.filter(F.col("div") > 0).groupBy(key, "div").agg(
        head.alias("head"), F.array_join(F.transform(paras, lambda p: p["t"]), "\n").alias("text"),
        typ.alias("typ"), F.max("in_body").alias("in_body"), F.count_if(F.col("kind") == "p").alias("n_paras"))
    if kind == "supplement":
        secs = secs.filter(F.coalesce(F.col("typ").isin(SUPPLEMENT_TYPES), F.lit(False))
                           | F.coalesce(F.col("head").rlike("(?i)(supplementary|appendix|annex)"), F.lit(False)))
        default = "Supplementary Section"
    else:
        secs, default = secs.filter("in_body"), "Untitled Section"
    return secs.filter(tx.strip("text") != "").select(
        key, "div", F.coalesce(F.nullif("head", F.lit("")), F.lit(default)).alias("title"), "text", "n_paras")


def tei_body_text(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """A-07: the whole body as one whitespace-normal text."""
    parts = nodes.filter(F.col("in_body") & F.col("kind").isin("head", "p", "formula", "figure"))
    return parts.groupBy(key).agg(tx.squash(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ")).alias("text"))


def tei_figures(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """A-08: figures with their id (``fig_n`` by position if none), title and caption."""
    n = F.row_number().over(Window.partitionBy(key).orderBy("seq"))
    return nodes.filter(F.col("kind") == "figure").withColumn("fig_no", n).select(
        key, "fig_no", F.coalesce("xml_id", F.concat(F.lit("fig_"), F.col("fig_no").cast("string"))).alias("fig_id"),
        tx.squash(F.coalesce("label", F.lit(""))).alias("title"), tx.squash("text").alias("caption"))


def tei_references(df: DataFrame, key: str = "doc_id", column: str = "tei") -> DataFrame:
    """A-09: bibliography entries; year from the ``when`` attribute, else the date's text."""
    frag = F.nullif(_cut(column, "listBibl"), F.lit(""))
    out = df.select(key, F.from_xml(frag, f"biblStruct array<{BIBL}>").alias("x")).select(key, F.posexplode("x.biblStruct").alias("ref_no", "b"))
    a, m = F.col("b.analytic"), F.col("b.monogr")
    titles = F.concat(_either(a["title"], TITLE), _either(m["title"], TITLE))
    pick = lambda xs, cond: F.get(F.filter(xs, cond), F.lit(0))["_VALUE"]
    dates = m["imprint"]["date"]
    date = F.coalesce(F.get(F.filter(dates, lambda d: d["_type"] == "published"), F.lit(0)), F.get(dates, F.lit(0)))
    idnos = F.concat(*[_either(x, IDNO) for x in (a["idno"], m["idno"], F.col("b.idno"))])
    people = _people(F.concat(_either(a["author"], f"array<{AUTHOR}>"), _either(m["author"], f"array<{AUTHOR}>")))
    return out.select(
        key, "ref_no", F.coalesce(F.col("b.`_xml:id`"), F.lit("unknown_id")).alias("bib_id"),
        tx.squash(F.coalesce(pick(titles, lambda t: (t["_level"] == "a") & (t["_type"] == "main")),
                             F.get(titles, F.lit(0))["_VALUE"], F.lit(""))).alias("title"),
        people.alias("authors"), tx.squash(F.coalesce(pick(titles, lambda t: t["_level"] == "j"), F.lit(""))).alias("journal"),
        tx.squash(F.coalesce(F.nullif(date["_when"], F.lit("")), date["_VALUE"], F.lit(""))).alias("year"),
        F.transform(idnos, lambda i: F.concat(F.coalesce(i["_type"], F.lit("unknown")), F.lit(":"), tx.squash(i["_VALUE"]))).alias("idnos"),
        pick(idnos, lambda i: i["_type"] == "DOI").alias("doi"), m["imprint"]["publisher"].alias("publisher"))


def tei_reference_texts(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """A-09: flat text of each entry."""
    return nodes.filter(F.col("kind") == "bibl").select(key, "seq", tx.squash("text").alias("ref"))


def tei_sentences(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """A-10: numbered sentences of the body with ``DIVnnPARAnn``.

    Paragraphs of a div are one text, so a sentence may span them; it belongs to the paragraph
    it ends in. Paragraph numbers ride along inside the text as markers.
    """
    unit = "␟"
    item = F.struct("seq", F.concat(F.lit(unit), F.col("para").cast("string"), F.lit(unit), tx.strip("text")).alias("t"))
    paras = nodes.filter(F.col("in_body") & (F.col("kind") == "p") & (F.col("div") > 0) & (tx.strip("text") != ""))
    divs = paras.groupBy(key, "div").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(item)), lambda x: x["t"]), " ").alias("t"))
    t = tx.protect_abbreviations(F.regexp_replace("t", "\\s+", " "))
    t = F.regexp_replace(t, f"([.!?])\\s+((?:{unit}\\d+{unit}\\s*)?)(?=[A-Z])", f"$1{tx.MARK}$2")
    raw = divs.select(key, "div", F.posexplode(F.split(t, tx.MARK)).alias("pos", "s"))
    w = Window.partitionBy(key, "div").orderBy("pos")
    ends = F.nullif(F.regexp_extract("s", f"^.*{unit}(\\d+){unit}", 1), F.lit("")).try_cast("int")
    raw = raw.withColumn("para", F.last(ends, ignorenulls=True).over(w))
    s = tx.squash(tx.restore_abbreviations(F.regexp_replace("s", f"{unit}\\d+{unit}", " ")))
    raw = raw.withColumn("text", s).filter(F.col("text").rlike(tx.TERMINAL))
    for junk in ("\\s*\\[\\d+\\]\\s*$", "\\s*\\(Formula\\)\\s*$", "\\s*-\\s*$"):
        raw = raw.withColumn("text", F.regexp_replace("text", junk, ""))
    raw = raw.filter(F.length("text") > 20)
    num = F.row_number().over(Window.partitionBy(key).orderBy("div", "pos"))
    return raw.select(key, num.cast("long").alias("num"), "div", "para", F.format_string("DIV%02dPARA%02d", "div", "para").alias("meta"), "text")


def tei_formulas(nodes: DataFrame, n: int = 12, key: str = "doc_id") -> DataFrame:
    """A-11: formulas of 10 or more characters with label and the last ``n`` words of the paragraph before."""
    f = carried(nodes.filter("in_body"), [key], "seq", {"__p": F.when(F.col("kind") == "p", F.col("tight"))}).filter(F.col("kind") == "formula")
    label = tx.squash(F.coalesce("label", F.lit("")))
    raw = tx.squash("tight")
    f = f.withColumn("label", label).withColumn("formula_text", F.when(
        F.col("label") != "", tx.squash(F.replace(raw, F.col("label"), F.lit("")))).otherwise(raw))
    return numbered(f.filter(F.length("formula_text") >= 10), [key], "seq", [], "formula_no").select(
        key, F.col("formula_no").cast("long").alias("formula_no"),
        F.coalesce("xml_id", F.lit("formula_unknown")).alias("xml_id"), "label", "formula_text",
        tail_words(F.coalesce("__p", F.lit("")), n).alias("anchor"))


def tei_blocks(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Head, paragraph and formula blocks in order, as ``pack_blocks`` takes them."""
    f = F.coalesce(tx.squash("label"), F.lit(""))
    formula = tx.squash(F.concat(F.when(f != "", F.concat(F.lit("Formula "), f, F.lit(": "))).otherwise("Formula: "), F.replace(tx.squash("text"), f, F.lit(""))))
    fig = F.filter("refs", lambda r: r["typ"] == "figure")
    target = lambda r: F.coalesce(F.nullif(F.regexp_replace(F.coalesce(r["target"], F.lit("")), "^#+", ""), F.lit("")),
                                  F.nullif(F.regexp_extract(r["text"], "(?i)fig(?:ure)?\\s*[_\\s]?(\\d+)", 1), F.lit("")), F.lit("unknown"))
    labels = F.array_sort(F.array_distinct(F.transform(fig, lambda r: F.concat(target(r), F.lit(": "), r["text"]))))
    keep = nodes.filter(F.col("in_body") & F.col("kind").isin("head", "p", "formula"))
    return keep.select(key, "seq", "kind", F.when(F.col("kind") == "formula", formula).otherwise(tx.squash("text")).alias("text"),
                       F.when(F.col("kind") == "p", labels).otherwise(F.array().cast("array<string>")).alias("figures"))


def citation_marks(nodes: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Sentences (key, sent_no, start, length, sentence) and citations (key, bib_id, pos) of each paragraph.

    Offsets run over the document: paragraphs are laid end to end by their number times a span
    larger than any text, so D-05's range join needs only (key, offset). ``sent_no`` is that offset.
    """
    span = 10**9
    base = F.col("seq").cast("long") * F.lit(span)
    paras = nodes.filter((F.col("kind") == "p") & F.exists("refs", lambda r: r["typ"] == "bibr"))
    parts = F.filter(F.split("text", "(?<=[.!?])\\s+"), lambda s: s != "")
    sents = paras.select(key, base.alias("b"), "text", F.posexplode(parts).alias("i", "sentence"))
    before = F.coalesce(F.sum(F.length("sentence") + 1).over(
        Window.partitionBy(key, "b").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sents = sents.withColumn("start", F.col("b") + before)
    sents = sents.select(key, F.col("start").alias("sent_no"), "start", F.length("sentence").alias("length"), "sentence")
    # Every occurrence of a marker's text is a position, as the moving search finds each in turn.
    marks = paras.select(key, base.alias("b"), "text", F.explode(F.filter("refs", lambda r: r["typ"] == "bibr")).alias("r")).filter(
        F.col("r.target").startswith("#") & (F.col("r.text") != "")).distinct()
    hits = F.split("text", F.concat(F.lit("\\Q"), F.col("r.text"), F.lit("\\E")))
    marks = marks.withColumn("__hits", hits).withColumn("w", F.length("r.text"))
    upto = F.expr("transform(sequence(1, size(__hits) - 1), i -> length(array_join(slice(__hits, 1, i), '')) + (i - 1) * w)")
    marks = marks.filter(F.size("__hits") > 1).select(key, F.expr("substring(r.target, 2)").alias("bib_id"), F.explode(upto).alias("o"), "b")
    return sents, marks.select(key, "bib_id", (F.col("b") + F.col("o")).alias("pos"))


def first_sentence_at(c: Column) -> Column:
    """Offset of the first sentence of more than ten characters, or 0 in a text of more than ten characters without one; else null.

    Points of common abbreviations end no sentence.
    """
    for short in ("e.g.", "i.e.", "Fig.", "etc."):
        c = F.regexp_replace(c, "\\b" + short.replace(".", "\\."), short.replace(".", "\u2024"))
    found = F.nullif(F.regexp_extract(c, "([A-Z0-9][^.!?]{10,}?[.!?])", 1), F.lit(""))
    return F.coalesce(F.instr(c, found) - 1, F.when(F.length(c) > 10, 0))


def supp_boundary(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """C-16: where the supplement starts in the document's running text (0-based), null if nowhere.

    ``full_text`` joins the texts of the leaf nodes by newline, so a node starts where the lengths of those before it end, whatever
    its text; a text that opens like an earlier one is not mistaken for it. The earliest of three places counts: a div marked as
    supplement, a short heading, paragraph or other line that opens with a supplement term, and the first sentence after the last
    bibliography entry. A document's text is one cell, so it is bound to 2 GB.
    """
    from scriptorium.operators.segment import SUPPLEMENT_HEADINGS

    opens = lambda c: c.rlike("(?i)^(?:" + "|".join(SUPPLEMENT_HEADINGS) + ")\\b")
    t = tx.squash("text")
    leaf = F.col("kind").isin("head", "p", "formula", "figure", "bibl") & (t != "")
    marked = (F.col("kind") == "div") & (F.lower(F.coalesce("typ", F.lit(""))).isin("annex", "appendix", "supplementary")
                                         | F.lower(F.coalesce("n", F.lit(""))).rlike("^s\\d+") | F.lower(F.coalesce("xml_id", F.lit(""))).rlike("^s\\d+"))
    bib_no = F.coalesce(F.nullif(F.regexp_extract("xml_id", "(\\d+)", 1), F.lit("")).try_cast("int"), F.lit(-1))
    docs = nodes.groupBy(key).agg(
        F.array_sort(F.collect_list(F.when(leaf, F.struct("seq", t.alias("t"))))).alias("leaves"),
        F.array_sort(F.collect_list(F.when(F.col("kind").isin("p", "div", "head", "bibl"), F.struct("seq", "kind")))).alias("parts"),
        F.min(F.when(marked, F.col("seq"))).alias("marked"),
        F.min(F.when(leaf & (tx.word_count(t) <= 6) & opens(t), F.col("seq"))).alias("line"),
        F.max_by("seq", F.when(F.col("kind") == "bibl", F.struct(bib_no, -F.col("seq")))).alias("last_bib"))
    after = F.get(F.filter("parts", lambda x: x["seq"] > F.col("last_bib")), F.lit(0))
    docs = docs.withColumn("after", F.when(after["kind"] != "bibl", after["seq"]))
    at = lambda seq: F.get(F.filter("leaves", lambda x: x["seq"] >= seq), F.lit(0))
    start = lambda seq: F.when(at(seq).isNotNull(), F.aggregate(
        F.filter("leaves", lambda x: x["seq"] < seq), F.lit(0), lambda n, x: n + F.length(x["t"]) + 1))
    behind = start(F.col("after")) + first_sentence_at(at(F.col("after"))["t"])
    return docs.select(key, F.array_join(F.col("leaves.t"), "\n").alias("full_text"),
                       F.least(start(F.col("marked")), start(F.col("line")), behind).alias("boundary"))


def split_at_boundary(df: DataFrame) -> DataFrame:
    """C-16: ``main`` and ``supp`` texts on both sides of the boundary."""
    b = F.col("boundary")
    return df.withColumn("main", F.when(b.isNull(), F.col("full_text")).otherwise(tx.strip(F.left("full_text", b)))).withColumn(
        "supp", F.when(b.isNull(), "").otherwise(tx.strip(F.substring("full_text", b + 1, F.length("full_text")))))
