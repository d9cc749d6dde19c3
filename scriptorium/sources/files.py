"""File scans and sinks (A): text, bibliography, notion, CSV, chunk and script tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import text as tx
from scriptorium.operators.report import roll_up


def read_text_corpus(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """A-01: every matching file below ``path`` as one row of path, name and text."""
    df = (spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True)
          .option("pathGlobFilter", pattern).load(path))
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"),
                     F.col("value").alias("text"))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """A-02: chunk files with article and chunk number from the name; order by the number."""
    df = read_text_corpus(spark, path, "*_chunk*.txt")
    return df.select(
        F.regexp_replace("name", "_chunk\\d*.*$", "").alias("article"),
        F.coalesce(F.nullif(F.regexp_extract("name", "_chunk(\\d+)", 1), F.lit("")).try_cast("int"), F.lit(0)).alias("chunk_no"),
        "name", "text")


def read_bibliography(df: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """A-03: ``Key: value`` blocks between dashed lines, one row per id.

    A block without an id continues the previous id; entries need an id and a title; the last
    block of an id wins. Carry-over is over the blocks of one text, inside its row.
    """

    def field(b: Column, name: str) -> Column:
        return F.when(b.rlike(f"(?md)^\\s*{name}: "), tx.strip(F.element_at(
            F.regexp_extract_all(b, F.lit(f"(?md)^\\s*{name}: ([^\\n]*)"), F.lit(1)), -1)))

    def parse(bs: Column) -> Column:
        ids = F.transform(bs, lambda b: field(b, "ID"))
        return tx.let(ids, lambda xs: F.transform(bs, lambda b, i: F.struct(
            i.alias("pos"),
            F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.array_compact(F.slice(xs, F.lit(1), i + 1))), -1).alias("bib_id"),
            *[field(b, n).alias(n.lower()) for n in ("Title", "Authors", "Journal", "Year")],
            F.filter(F.regexp_extract_all(b, F.lit("(?md)^\\s*- ([^\\n]*)"), F.lit(1)), lambda x: x != "None").alias("idnos"))))

    blocks = F.filter(F.transform(F.split(column, "-{10,}"), tx.strip), lambda b: b != "")
    rows = df.select(key, F.inline(tx.let(blocks, parse))).filter(
        (F.coalesce("bib_id", F.lit("")) != "") & F.col("title").isNotNull())
    last = rows.groupBy(key, "bib_id").agg(F.max_by(F.struct("title", "authors", "journal", "year", "idnos"), "pos").alias("r"))
    return last.select(key, "bib_id", "r.*")


def read_notions(df: DataFrame, header: str = "conditional", key: str = "doc_id", column: str = "text") -> DataFrame:
    """A-04: non-blank lines with their physical line number from 1.

    ``always`` drops line 1; ``conditional`` drops the first non-blank line when it names notions or
    starts with ``#``.
    """

    def pick(ls: Column) -> Column:
        kept = F.filter(F.transform(ls, lambda x, i: F.struct(tx.strip(x).alias("notion"), (i + 1).alias("line"))),
                        lambda x: x["notion"] != "")
        if header == "always":
            return F.filter(kept, lambda x: x["line"] > 1)
        head = lambda x: F.lower(x["notion"]).contains("notion") | x["notion"].startswith("#")
        return tx.let(kept, lambda ks: F.filter(ks, lambda x, i: ~((i == 0) & head(x))))

    return df.select(key, F.inline(tx.let(tx.lines(column), pick)))


PAPER_COLUMNS = ["notion", "title", "authors", "journal", "year", "doi"]


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    """A-05: papers CSV; header names in any case, missing columns null, rows without title dropped."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    names = {c.strip().lower(): c for c in raw.columns}
    cols = [(F.nullif(tx.strip(F.col(f"`{names[c]}`")), F.lit("")) if c in names else F.lit(None).cast("string")).alias(c)
            for c in PAPER_COLUMNS]
    return raw.select(*cols).filter(F.col("title").isNotNull())


def parse_sentence_stream(df: DataFrame, key: str = "pair_id", column: str = "text") -> DataFrame:
    """A-14: ``SENTENCE n meta ::: text ////`` records; ``ok`` is false for a record that does not parse."""
    head = "(?s)SENTENCE\\s*(\\d+)\\s*([^:]*?)\\s*:::(.*)"
    out = df.select(key, F.posexplode(F.split(column, "////")).alias("rec", "raw")).withColumn("raw", tx.squash("raw")).filter(F.col("raw") != "")
    meta = F.regexp_extract("raw", head, 2)
    out = out.withColumn("ok", F.col("raw").rlike(head)).withColumn(
        "num", F.nullif(F.regexp_extract("raw", head, 1), F.lit("")).try_cast("long")).withColumn(
        "meta", F.when(meta.startswith("#"), "").otherwise(tx.strip(meta))).withColumn(
        "text", tx.squash(F.regexp_replace(tx.strip(F.regexp_extract("raw", head, 3)), "^#\\s*Original label:[^|]*\\|?\\s*", "")))

    def tag(pattern: str) -> Column:
        return F.nullif(F.upper(F.regexp_extract("meta", "(?i)" + pattern, 1)), F.lit(""))

    return out.select(key, "rec", "ok", "num", "meta", tag("(FIG\\d+)").alias("fig"), tag("(DIV\\d+)").alias("div"),
                      tag("(PARA\\d+)").alias("para"), "text", "raw")


def scan_links(df: DataFrame, ext: str | None = None, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """A-15: ``href`` targets in order (0-based), resolved against the page address.

    ``ext="pdf"`` keeps targets with that extension, with or without a query.
    """
    inner = f"[^'\"]+\\.{ext}(?:\\?[^'\"]*)?" if ext else "[^'\"]+"
    found = F.regexp_extract_all(F.col(html), F.lit(f"(?i)href=['\"]({inner})['\"]"), F.lit(1))
    base = F.col(url)
    scheme = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    root = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    page = F.regexp_extract(base, "^([^?#]*)", 1)
    folder = F.regexp_extract(base, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/(?:[^?#]*/)?)", 1)
    h = F.col("href")
    target = (
        F.when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), h).when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
        .when(h.startswith("/"), F.concat(root, h)).when(h.startswith("?"), F.concat(page, h))
        .when(h.startswith("#"), F.concat(F.regexp_extract(base, "^([^#]*)", 1), h))
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), h)))
    for _ in range(4):
        target = F.regexp_replace(target, "(?<=[^/:])/(?:\\./|(?!\\.\\./)[^/?#]+/\\.\\./)", "/")
    return df.select(key, url, F.posexplode(found).alias("link_no", "href")).withColumn("target", target)


# --- sinks ---------------------------------------------------------------------------------


def write_chunks(df: DataFrame, path: str) -> None:
    """A-16: chunks as Parquet, one folder per kind; key (article, kind, chunk_no) and figures are columns."""
    df.write.mode("overwrite").partitionBy("kind").parquet(path)


REFERENCE_COLUMNS = ["notion", "line_in_notions_txt", "bib_id", "title", "authors", "journal", "year"]


def sorted_references(df: DataFrame) -> DataFrame:
    """A-17: fixed columns, notion ascending, year descending, years that are no number last."""
    cols = [c for c in REFERENCE_COLUMNS if c in df.columns]
    return df.select(*cols).orderBy("notion", F.expr("try_cast(year AS int)").desc_nulls_last(), *[c for c in ("bib_id",) if c in cols])


def write_references(df: DataFrame, path: str) -> None:
    """A-17: CSV sink; the range-partitioned sort makes the part files consecutive."""
    sorted_references(df).write.mode("overwrite").option("header", True).csv(path)


def render_slide(uid: Column, title: Column, bullets: Column, notes: Column, transition: Column) -> Column:
    def section(head: str, body: Column) -> Column:
        b = F.coalesce(body, F.lit(""))
        return F.when(b != "", F.concat(F.lit(f"**{head}**\n"), tx.strip(b), F.lit("\n\n"))).otherwise("")

    marks = F.array_join(F.transform(F.coalesce(bullets, F.array().cast("array<string>")), lambda b: F.concat(F.lit("- "), b, F.lit("\n"))), "")
    return F.concat(tx.strip(F.concat(F.lit("## "), uid, F.lit(" — "), F.coalesce(title, F.lit("")))), F.lit("\n\n**On-slide bullets**\n"),
                    marks, F.lit("\n"), section("Speaker notes", notes), section("Transition", transition), F.lit("---\n"))


def render_script(slides: DataFrame, deck: str = "deck_id", order: str = "idx") -> DataFrame:
    """A-18: one markdown text per deck from its ordered slides."""
    body = render_slide(F.col("slide_uid"), F.col("title"), F.col("bullets"), F.col("speaker_notes"), F.col("transition"))
    out = roll_up(slides.withColumn("script", body), deck, order, "\n", "script")
    return out.withColumn("script", F.concat(F.lit("# Speaker Script\n\n"), F.col("script")))


def with_references(chunks: DataFrame, refs: DataFrame, key: str = "doc_id", order: str = "ref_no", ref: str = "ref") -> DataFrame:
    """A-19: a document's reference text appended to each of its chunks, for documents in ``refs``.

    Give only documents whose references are real (``has_real_references``).
    """
    block = roll_up(refs, key, order, "\n\n", ref).select(key, F.col(ref).alias("__refs"))
    out = chunks.join(block, key, "left")
    return out.withColumn("text", F.when(F.col("__refs").isNotNull(), F.concat(
        F.col("text"), F.lit("\n\nReferences:\n"), F.col("__refs"))).otherwise(F.col("text"))).drop("__refs")
