"""Inputs that queries derive from the given tables when a table lacks the wanted shape.

The derivation is whole-table and keeps the source values in it, so the check knows the answer
from the tables alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import text as tx


def first_line(c: Column | str = "text") -> Column:
    return F.get(tx.lines(c), F.lit(0))


def numbered_lines(c: Column | str = "text") -> Column:
    """``k. line`` for every second line, so that each entry has one continuation line."""
    return F.array_join(F.transform(tx.lines(c), lambda x, i: F.when(
        i % 2 == 0, F.concat(((i / 2).cast("int") + 1).cast("string"), F.lit(". "), x)).otherwise(x)), "\n")


def xml_text(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def tei_documents(documents: DataFrame) -> DataFrame:
    """Documents as TEI: a div per four lines, its first line as head, the others as paragraphs.

    Every paragraph ends in a citation of entry ``b<doc_id % 5>``; each div has a figure and a formula; the
    bibliography has five entries, the fifth without title.
    """

    def div(group: Column, i: Column) -> Column:
        ls = group["items"]
        paras = F.transform(F.slice(ls, F.lit(2), F.lit(3)), lambda p: F.concat(
            F.lit("<p>"), xml_text(p), F.lit(" <ref type=\"bibr\" target=\"#b"), (F.col("doc_id") % 5).cast("string"),
            F.lit("\">[x"), (F.col("doc_id") % 5).cast("string"), F.lit("]</ref></p>")))
        n = i.cast("string")
        kind = F.when(i == 3, F.lit("<div type=\"annex\"><head>")).otherwise(F.lit("<div><head>"))
        return F.concat(
            kind, xml_text(F.get(ls, F.lit(0))), F.lit("</head>"), F.array_join(paras, ""),
            F.lit("<formula xml:id=\"formula_"), n, F.lit("\">alpha = beta + "), n, F.lit("<label>("), n, F.lit(")</label></formula>"),
            F.lit("<figure"), F.when(i % 2 == 0, F.concat(F.lit(" xml:id=\"fig_"), n, F.lit("\""))).otherwise(""),
            F.lit("><head>Fig. "), n, F.lit("</head><figDesc>"), xml_text(F.left(F.get(ls, F.lit(0)), F.lit(60))), F.lit("</figDesc></figure></div>"))

    body = F.array_join(F.transform(tx.segments(tx.lines("text"), lambda xs, i: i % 4 == 0), div), "")
    d = F.col("doc_id").cast("string")
    bib = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.concat(
        F.lit("<biblStruct xml:id=\"b"), k.cast("string"), F.lit("\"><analytic>"),
        F.when(k < 4, F.concat(F.lit("<title level=\"a\" type=\"main\">Work "), k.cast("string"), F.lit(" of "), d, F.lit("</title>"))).otherwise(""),
        F.lit("<author><persName><forename type=\"first\">Ann</forename><surname>S"), k.cast("string"), F.lit("</surname></persName></author></analytic>"),
        F.lit("<monogr><title level=\"j\">"), F.col("source"), F.lit("</title><imprint><date type=\"published\" when=\""), (F.lit(1990) + k).cast("string"),
        F.lit("\"/></imprint></monogr><idno type=\"DOI\">10.1103/"), d, F.lit("."), k.cast("string"), F.lit("</idno></biblStruct>"))), "")
    tei = F.concat(
        F.lit("<TEI xmlns=\"http://www.tei-c.org/ns/1.0\"><teiHeader><fileDesc><titleStmt><title>Other</title></titleStmt><sourceDesc><biblStruct><analytic>"),
        F.lit("<title level=\"a\" type=\"main\">"), xml_text(first_line()), F.lit("</title><author><persName><forename type=\"first\">Ann</forename><surname>"), F.col("lang"),
        F.lit("</surname></persName></author></analytic></biblStruct></sourceDesc></fileDesc><profileDesc><abstract><p>"), F.col("source"),
        F.lit("</p></abstract></profileDesc></teiHeader><text><body>"), body, F.lit("</body><back><div type=\"references\"><listBibl>"), bib,
        F.lit("</listBibl></div></back></text></TEI>"))
    return documents.select("doc_id", tei.alias("tei"))


def plan_text() -> Column:
    """A slide-group block per line of a conversation turn, numbered so that ranges are consecutive."""
    return F.array_join(F.transform(tx.lines("text"), lambda x, i: F.concat(
        F.lit("===SLIDE_GROUP: Group "), (i + 1).cast("string"), F.lit(" | Slides "), (2 * i + 1).cast("string"), F.lit("–"), (2 * i + 2).cast("string"),
        F.lit("===\nPURPOSE: "), F.col("role"), F.lit("\nCONTENT_SCOPE: "), x, F.lit("\nKEY_TRANSITIONS: "), F.when(i % 2 == 0, "none").otherwise(x),
        F.lit("\nKEY_TERMS: a, b , c\nSlide "), (2 * i + 1).cast("string"), F.lit(": "), x,
        F.lit("\nSlide "), (2 * i + 2).cast("string"), F.lit(": end of part\nInclude: Figure "), (i % 3).cast("string"))), "\n")
