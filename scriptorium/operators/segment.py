"""Text to rows: chunkers, splitters, parsers and extractors (C).

Whatever concerns one document is computed inside its row and exploded last, so no
generator here shuffles unless its contract says so.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.functions import text as tx
from scriptorium.functions.neighbours import carried
from scriptorium.operators.clean import is_header_line

# Chunk size and overlap in characters recommended per embedding model,
# with the model's token limit.
MODEL_PRESETS = {
    "all-MiniLM-L6-v2": (256, 1000, 100),
    "all-mpnet-base-v2": (384, 1500, 200),
    "BAAI/bge-small-en-v1.5": (512, 3000, 400),
    "BAAI/bge-base-en-v1.5": (512, 3000, 400),
    "BAAI/bge-large-en-v1.5": (512, 3500, 500),
    "Snowflake/snowflake-arctic-embed-m": (512, 3500, 500),
    "Snowflake/snowflake-arctic-embed-l": (512, 4000, 600),
    "nomic-ai/nomic-embed-text-v1.5": (8192, 8000, 1000),
    "voyageai/voyage-3": (16000, 12000, 1500),
    "voyageai/voyage-3-large": (16000, 14000, 2000),
}
UNKNOWN_MODEL_PRESET = (512, 2500, 300)
# Words that open a paragraph rather than a title.
PARAGRAPH_OPENERS = ["Both", "This", "We", "In", "At", "For", "Typical"]
# Words that mark a supplement title.
TITLE_WORDS = (
    "Section\\s+\\d+|Supplementary\\s+Figure|Extended Data\\s+Figure|Methods|Homodyne|Experimental"
)
# Headings that open a supplement.
SUPPLEMENT_HEADINGS = [
    "Supplementary Material", "Supplementary Information", "Supplemental Material",
    "Supporting Information", "Additional Information", "Supplementary Methods",
    "Supplementary Figures", "Supplementary Table", "Supplementary Text", "SUPPLEMENTARY",
    "Supplementary materials", "Methods",
]
# The five ways an exercise item may be numbered.
ITEM_FORMATS = {
    "A": "([0-9]+)\\s*\\.\\s*(?=[A-ZÉÈÊÀÇÎÔÛÂ])",
    "B": "([0-9]+)\\s*\\)\\s*(?=[A-ZÉÈÊÀÇÎÔÛÂ])",
    "C": "([a-z])\\s*\\)\\s*(?=[A-ZÉÈÊÀÇÎÔÛÂ])",
    "D": "([0-9]+)\\.\\s*(?=[A-ZÉÈÊÀÇÎÔÛÂ])",
    "E": "([a-z])\\.\\s*(?=[A-ZÉÈÊÀÇÎÔÛÂ])",
}
# Fixed value: how a figure caption starts and where it stops.
CAPTION = (
    "(?imd)^((?:Fig(?:ure)?\\.?|Extended Data Fig\\.?|Supplementary Fig(?:ure)?\\.?)\\s*"
    "\\d+[a-zA-Z]?(?:[.:)\\s]|[\\s–—-]))([\\s\\S]*?)"
    "(?=\\z|^(?:Fig(?:ure)?|Extended\\s+Data\\s+Fig|Supplementary\\s+Fig|References|Methods|"
    "Acknowledgements)\\b|\\n\\s*\\n)"
)


# --- chunkers ----------------------------------------------------------------------------


def _strided(c: Column, size: int, step: int, count: Column) -> Column:
    """``count`` windows of ``size`` characters, ``step`` apart, in time linear in the text.

    The text is cut once into pieces of ``step`` characters; a window is the head of the few
    pieces it spans. ``substring`` from the start of the text for each window would be quadratic.
    """
    span = -(-size // step)
    pieces = F.regexp_extract_all(c, F.lit("(?s).{1,%d}" % step), F.lit(0))
    return tx.let(pieces, lambda ps: F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda i: F.left(F.array_join(F.slice(ps, i + 1, F.lit(span)), ""), F.lit(size)),
    ))


def sliding_chunks(df: DataFrame, size: int, overlap: int, column: str = "text") -> DataFrame:
    """C-01: one chunk per start 0, size-overlap, … below max(len-overlap, 1)."""
    step = size - overlap
    n = F.ceil(F.greatest(F.length(column) - overlap, F.lit(1)) / step).cast("int")
    chunks = _strided(F.col(column), size, step, n)
    return df.select(*[c for c in df.columns if c != column],
                     F.posexplode(chunks).alias("chunk_no", "chunk"))


def overlap_chunks(df: DataFrame, size: int = 6000, overlap: int = 300, column: str = "text",
                   tail: str = "stop") -> DataFrame:
    """C-02: like C-01 over the trimmed text, but ends as soon as a chunk reaches the end.

    ``tail="run"`` starts a chunk at every step below the length instead, on untrimmed text.
    Blank text gives no row.
    """
    step = max(1, size - overlap)
    body = tx.strip(column) if tail == "stop" else F.col(column)
    length = F.length(F.col("__t"))
    if tail == "stop":
        n = F.when(length <= size, 1).otherwise(1 + F.ceil((length - size) / step)).cast("int")
    else:
        n = F.ceil(length / step).cast("int")
    out = df.withColumn("__t", body).filter(F.col("__t") != "")
    return out.select(*[c for c in df.columns if c != column],
                      F.posexplode(_strided(F.col("__t"), size, step, n)).alias("chunk_no", "chunk"))


def _explode(df: DataFrame, items: Column, pos: str, value: str, drop: str) -> DataFrame:
    return df.select(*[c for c in df.columns if c != drop], F.posexplode(items).alias(pos, value))


def split_sentences(df: DataFrame, variant: str = "trim", column: str = "text") -> DataFrame:
    """C-03: ``trim`` (non-blank, trimmed), ``long`` (over 15 characters), ``space`` (cut at spaces only)."""
    if variant == "space":
        parts = F.split(F.col(column), "(?<=[.!?]) +")
    elif variant == "long":
        parts = F.transform(
            F.filter(tx.split_sentences(column), lambda s: (tx.strip(s) != "") & (F.length(s) > 15)), tx.strip)
    else:
        parts = F.filter(F.transform(tx.split_sentences(column), tx.strip), lambda s: s != "")
    return _explode(df, parts, "sent_no", "sentence", column)


def split_sentences_safe(df: DataFrame, min_words: int = 6, column: str = "text") -> DataFrame:
    """C-04: abbreviation-safe sentences, numbered from 1."""
    out = _explode(df, tx.split_sentences_safe(column, min_words), "sent_no", "sentence", column)
    return out.withColumn("sent_no", F.col("sent_no") + 1)


def repair_overmerged(df: DataFrame, min_len: int = 30, max_prev: int = 49, column: str = "text") -> DataFrame:
    """C-05: text from the last line that reads as a fresh start after a short line."""

    def fix(ls: Column) -> Column:
        start = F.filter(tx.index_of(ls), lambda i: F.get(ls, i).rlike("^\\s*[A-Z][a-z]{2,}") & F.when(
            i == 0, F.length(tx.strip(F.get(ls, i))) >= 50).otherwise(
            (F.length(tx.strip(F.get(ls, i))) >= min_len)
            & (F.length(tx.strip(F.get(ls, i - 1))) <= max_prev)))
        return tx.let(F.element_at(F.concat(F.array(F.lit(-1)), start), -1), lambda k: F.when(
            (F.size(ls) > 1) & (k >= 0),
            tx.squash(F.array_join(F.slice(ls, F.greatest(k, F.lit(0)) + 1, F.size(ls)), " "))))

    body = tx.strip(column)
    return df.withColumn(column, F.coalesce(tx.let(tx.lines(body), fix), body))


def _pack(parts: Column, step, close) -> Column:
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))
    return F.aggregate(parts, zero, step, close)


def pack_sentences(df: DataFrame, max_size: int = 3500, prefix: Column | str = "", column: str = "text") -> DataFrame:
    """C-06: greedy packing under a size that counts the prefix; a sentence too long for a
    chunk of its own goes on in further chunks, so every character is in one."""
    pre = F.lit(prefix) if isinstance(prefix, str) else prefix
    room = F.lit(max_size) - F.length(pre)

    def emit(acc: Column) -> Column:
        return F.when(acc["cur"] == "", acc["done"]).otherwise(
            F.concat(acc["done"], F.array(F.concat(pre, acc["cur"]))))

    def step(acc: Column, s: Column) -> Column:
        cand = F.when(acc["cur"] == "", s).otherwise(F.concat(acc["cur"], F.lit(" "), s))
        return F.when(F.length(cand) <= room, F.struct(acc["done"].alias("done"), cand.alias("cur"))).otherwise(
            F.struct(emit(acc).alias("done"), s.alias("cur")))

    def pieces(s: Column) -> Column:
        last = F.floor((F.length(s) - 1) / room).cast("int")
        return F.when(last == 0, F.array(s)).otherwise(F.transform(
            F.sequence(F.lit(0), last), lambda i: F.substring(s, i * room + 1, room)))

    sents = F.filter(F.transform(tx.split_sentences(column), tx.strip), lambda s: s != "")
    sents = F.flatten(F.transform(sents, pieces))
    return _explode(df, _pack(sents, step, emit), "chunk_no", "chunk", column)


def pack_sentences_simple(df: DataFrame, max_size: int = 1500, column: str = "text") -> DataFrame:
    """C-07: greedy packing while ``len(current) + len(sentence) < max_size``; no empty chunk."""

    def emit(acc: Column) -> Column:
        return F.when(tx.strip(acc["cur"]) == "", acc["done"]).otherwise(
            F.concat(acc["done"], F.array(tx.strip(acc["cur"]))))

    def step(acc: Column, s: Column) -> Column:
        fits = F.length(acc["cur"]) + F.length(s) < max_size
        return F.when(fits, F.struct(
            acc["done"].alias("done"), F.concat(acc["cur"], s, F.lit(" ")).alias("cur"))).otherwise(
            F.struct(emit(acc).alias("done"), F.concat(s, F.lit(" ")).alias("cur")))

    return _explode(df, _pack(F.split(F.col(column), "(?<=[.!?]) +"), step, emit), "chunk_no", "chunk", column)


BLOCK = "array<struct<kind:string,text:string,figures:array<string>>>"
CHUNK_TYPE = "array<struct<text:string,figures:array<string>,section_title:string>>"


def _pieces(body: Column, size: int) -> Column:
    """A long text in pieces of at most ``size`` characters that end at a space where one lies beyond the 100th character."""

    def cut(acc: Column, _: Column) -> Column:
        window = F.substring(body, acc["at"] + 1, F.lit(size))
        space = F.length(window) - F.instr(F.reverse(window), " ")
        n = F.when((acc["at"] + size < F.length(body)) & window.contains(" ") & (space > 100), space).otherwise(F.length(window))
        return tx.let(n, lambda k: F.when(k > 0, F.struct(
            F.array_append(acc["parts"], tx.strip(F.substring(body, acc["at"] + 1, k))).alias("parts"), (acc["at"] + k).alias("at"))).otherwise(acc))

    turns = F.sequence(F.lit(0), F.floor(F.length(body) / min(size, 101)).cast("int"))
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("at"))
    return F.aggregate(turns, start, cut, lambda acc: acc["parts"])


def _packed_blocks(blocks: Column, size: int, overlap: int) -> Column:
    """Chunks of one document's blocks, as a fold over them: the chunks so far and the open one."""

    def state(done, text, figs, title, carry) -> Column:
        return F.struct(done.alias("done"), text.alias("text"), figs.alias("figs"), title.alias("title"), carry.alias("carry"))

    def tail(body: Column) -> Column:
        return F.right(body, F.lit(overlap)) if overlap > 0 else F.lit("")

    def lead(done: Column, carry: Column) -> Column:
        return F.when(F.size(done) > 0, carry).otherwise("")

    def chunk(text: Column, figs: Column, title: Column) -> Column:
        return F.struct(text.alias("text"), figs.alias("figures"), title.alias("section_title"))

    def note(figs: Column, before: str, after: str) -> Column:
        return F.when(F.size(figs) > 0, F.concat(F.lit(before + "Figures used in this chunk: "), F.array_join(figs, ", "), F.lit(after))).otherwise("")

    def closed(acc: Column) -> Column:
        used = F.array_sort(F.array_distinct(acc["figs"]))
        body = tx.strip(F.concat(lead(acc["done"], acc["carry"]), F.regexp_replace(acc["text"], "(?U)\\s+$", ""), note(used, "\n", "")))
        return F.when(tx.strip(acc["text"]) == "", acc).otherwise(state(
            F.array_append(acc["done"], chunk(body, used, acc["title"])), F.lit(""), F.array().cast("array<string>"),
            F.lit(None).cast("string"), tail(tx.strip(acc["text"]))))

    def room(acc: Column, more: Column, next_: Callable[[Column], Column]) -> Column:
        full = (acc["text"] != "") & (F.length(acc["text"]) + more > size)
        return tx.let(F.when(full, closed(acc)).otherwise(acc), next_)

    def long(acc: Column, body: Column, figs: Column) -> Column:
        add = lambda a, part: state(
            F.array_append(a["done"], chunk(F.concat(lead(a["done"], a["carry"]), part, note(figs, "\n\n", "\n")), figs, a["title"])),
            a["text"], a["figs"], a["title"], tail(part))
        return tx.let(closed(acc), lambda a: F.aggregate(_pieces(body, size), a, add))

    def step(acc: Column, b: Column) -> Column:
        body = F.coalesce(b["text"], F.lit(""))
        figs = F.array_sort(F.array_distinct(F.coalesce(b["figures"], F.array().cast("array<string>"))))
        head = room(acc, F.length(body) + 2, lambda a: state(
            a["done"], F.concat(a["text"], F.when(a["text"] == "", "").otherwise("\n"), body, F.lit("\n")), a["figs"], body, a["carry"]))
        short = room(acc, F.length(body) + 1, lambda a: state(
            a["done"], F.concat(a["text"], body, F.lit("\n")), F.concat(a["figs"], figs), a["title"], a["carry"]))
        return F.when((b["kind"] == "head") & (body == ""), acc).when(b["kind"] == "head", head).when(
            F.length(body) > size, long(acc, body, figs)).otherwise(short)

    empty = state(F.array().cast(CHUNK_TYPE), F.lit(""), F.array().cast("array<string>"), F.lit(None).cast("string"), F.lit(""))
    return F.aggregate(blocks, empty, step, lambda acc: closed(acc)["done"])


def pack_blocks(df: DataFrame, size: int = 4000, overlap: int = 0, blocks: str = "blocks") -> DataFrame:
    """C-08: section-aware packing of head / p / formula blocks into chunks.

    ``blocks`` holds one document's ordered blocks, so the sequential part is a fold inside the row, without a shuffle.
    """

    keep = [c for c in df.columns if c != blocks]
    out = df.select(*keep, F.posexplode(_packed_blocks(F.col(blocks).cast(BLOCK), size, overlap)).alias("chunk_no", "__c"))
    return out.select(*keep, "chunk_no", "__c.*")


def collect_blocks(df: DataFrame, key: str, order: str, kind: str = "kind", text: str = "text",
                   figures: str = "figures") -> DataFrame:
    """Ordered block rows of a document to the array ``pack_blocks`` takes."""
    item = F.struct(order, F.col(kind).alias("kind"), F.col(text).alias("text"), F.col(figures).alias("figures"))
    return df.groupBy(key).agg(F.transform(
        F.array_sort(F.collect_list(item)),
        lambda b: F.struct(b["kind"], b["text"], b["figures"])).alias("blocks"))


_PIECES, _RUN = "array<struct<start:int,text:string,done:boolean>>", "array<struct<s:int,t:string>>"


def _lead(c: Column) -> Column:
    """Characters of white space before the text."""
    return F.length(c) - F.length(F.regexp_replace(c, "^[ \\t\\n\\x0B\\f\\r]+", ""))


def _closed(run: Column) -> Column:
    """The chunk of a run of neighbours, none if it is blank."""
    return tx.let(F.array_join(F.transform(run, lambda r: r["t"]), ""), lambda body: F.when(tx.strip(body) == "", F.array().cast(_PIECES)).otherwise(
        F.array(F.struct((run[0]["s"] + _lead(body)).alias("start"), tx.strip(body).alias("text"), F.lit(True).alias("done")))))


def _merged(piece: Column, sep: str, size: int, overlap: int) -> Column:
    """Cut before each separator; neighbours shorter than ``size`` form chunks that share up to ``overlap``, longer ones stay open."""
    none, empty = F.array().cast(_PIECES), F.array().cast(_RUN)
    parts = F.transform(F.split(piece["text"], re.escape(sep), -1), lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit(sep), p)))

    def step(acc: Column, part: Column) -> Column:
        n, run, out, pos = F.length(part), acc["run"], acc["out"], acc["pos"]
        total = F.when(F.size(run) > 0, pos - F.get(run, F.lit(0))["s"]).otherwise(0)
        long, over = n >= size, (total > 0) & (total + n > size)
        shared = F.filter(run, lambda r: r["s"] >= pos - F.least(F.lit(overlap), F.lit(size) - n))
        closed = F.when(F.size(run) > 0, _closed(run)).otherwise(none)
        open_ = F.array(F.struct(pos.alias("start"), part.alias("text"), F.lit(False).alias("done")))
        out = F.when(n == 0, out).when(long, F.concat(out, closed, open_)).when(over, F.concat(out, closed)).otherwise(out)
        more = F.concat(F.when(over, shared).otherwise(run), F.array(F.struct(pos.alias("s"), part.alias("t"))))
        return F.struct(out.cast(_PIECES).alias("out"), F.when(n == 0, run).when(long, empty).otherwise(more).cast(_RUN).alias("run"), (pos + n).alias("pos"))

    start = F.struct(none.alias("out"), empty.alias("run"), piece["start"].alias("pos"))
    return F.aggregate(parts, start, step, lambda acc: F.concat(acc["out"], F.when(F.size(acc["run"]) > 0, _closed(acc["run"])).otherwise(none)))


def _windowed(piece: Column, size: int, overlap: int) -> Column:
    """A piece without separators in windows of ``size`` characters."""
    step = size - min(overlap, size - 1)
    last = F.greatest(F.lit(0), F.ceil((F.length(piece["text"]) - size) / step)).cast("int")
    cuts = F.transform(F.sequence(F.lit(0), last), lambda i: F.array(F.struct((piece["start"] + i * step).alias("s"), F.substring(piece["text"], i * step + 1, F.lit(size)).alias("t"))))
    return F.flatten(F.transform(cuts, _closed))


def recursive_chunks(df: DataFrame, model: str = "BAAI/bge-small-en-v1.5", size: int | None = None,
                     overlap: int | None = None, column: str = "text") -> DataFrame:
    """C-09: recursive separator split with the model's preset; ``start`` is the offset of the chunk.

    The recursion is unrolled: each level cuts the pieces still open at its separator, and what holds none waits for the next level.
    """
    _, preset_size, preset_overlap = MODEL_PRESETS.get(model, UNKNOWN_MODEL_PRESET)
    limit = preset_size if size is None else size
    shared = preset_overlap if overlap is None else overlap
    items = F.array(F.struct(F.lit(0).alias("start"), F.coalesce(column, F.lit("")).alias("text"), F.lit(False).alias("done"))).cast(_PIECES)

    def cut(sep: str):
        return lambda x: F.when(x["done"] | ~x["text"].contains(F.lit(sep)), F.array(x)).otherwise(_merged(x, sep, limit, shared))

    for sep in ("\n\n", "\n", ". ", " "):
        items = F.flatten(F.transform(items, cut(sep)))
    items = F.flatten(F.transform(items, lambda x: F.when(x["done"], F.array(x)).otherwise(_windowed(x, limit, shared))))
    keep = [c for c in df.columns if c != column]
    out = df.select(*keep, F.posexplode(items).alias("chunk_no", "__c"))
    return out.select(*keep, "chunk_no", "__c.start", F.col("__c.text").alias("chunk"))


# --- figures, references, sections ---------------------------------------------------------


def extract_captions(df: DataFrame, column: str = "text") -> DataFrame:
    """C-10: add ``captions`` (array of label, body in text order) and take them out of the text."""
    t = F.col(column)
    labels = F.regexp_extract_all(t, F.lit(CAPTION), F.lit(1))
    bodies = F.regexp_extract_all(t, F.lit(CAPTION), F.lit(2))
    captions = F.zip_with(labels, bodies, lambda a, b: F.struct(tx.strip(a).alias("label"), tx.strip(b).alias("body")))
    return df.withColumn("captions", captions).withColumn(column, F.regexp_replace(t, CAPTION, "\n"))


def caption_rows(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """C-10: one row per caption, numbered from 1 inside the document."""
    out = df.select(key, F.posexplode("captions").alias("n", "c"))
    return out.select(key, (F.col("n") + 1).alias("caption_no"), "c.label", "c.body")


def split_panels(df: DataFrame, column: str = "text") -> DataFrame:
    """C-11: caption to panels ``(a)`` … ``(h)``; parts of more than 10 characters."""
    parts = F.filter(F.transform(F.split(F.col(column), "(?=\\(?[a-hA-H]\\))"), tx.strip), lambda p: F.length(p) > 10)
    out = _explode(df, parts, "panel_no", "panel", column).withColumn("panel_no", F.col("panel_no") + 1)
    label = F.lower(F.regexp_extract("panel", "^\\(?([a-hA-H])\\)?", 1))
    return out.withColumn("label", F.when(label != "", label).otherwise(
        F.concat(F.lit("part"), F.col("panel_no").cast("string"))))


def split_references(df: DataFrame, column: str = "text") -> DataFrame:
    """C-12: ``body`` up to and with the reference heading, ``refs`` after it; else the last 20%."""
    t = F.col(column)
    out = df
    heads = ["(?i)\\n\\s*References\\s*\\n", "(?i)\\n\\s*Bibliography\\s*\\n"]
    cut = (F.floor(F.length(t) * 0.8)).cast("int")
    body, refs = F.left(t, cut), F.substring(t, cut + 1, F.length(t))
    for h in reversed(heads):
        hit = t.rlike(h)
        parts = F.split(t, h, 2)
        body = F.when(hit, F.concat(F.get(parts, F.lit(0)), F.regexp_extract(t, h, 0))).otherwise(body)
        refs = F.when(hit, F.get(parts, F.lit(1))).otherwise(refs)
    return out.withColumn("body", body).withColumn("refs", refs)


def find_reference_block(df: DataFrame, column: str = "text") -> DataFrame:
    """C-13: ``block_start``/``block_end`` (0-based offsets) of a reference list proven by its numbering."""
    heading = "(?iU)\\b(?:References?|Bibliography|Literature)\\b"
    numbered = "^\\s*(\\d+)[.)](?:\\s|$)"

    def proven(ls: Column) -> Column:
        def evidence(i: Column) -> Column:
            nums = F.transform(
                F.filter(F.slice(ls, i + 2, F.lit(15)), lambda x: x.rlike(numbered)),
                lambda x: F.regexp_extract(x, numbered, 1).try_cast("long"))
            return tx.let(nums, lambda ns: (F.size(ns) >= 3) & F.exists(
                tx.index_of(ns), lambda j: (F.get(ns, j + 1) - F.get(ns, j)).between(1, 3)))

        hit = F.filter(tx.index_of(ls), lambda i: F.get(ls, i).rlike(heading) & evidence(i))
        return F.get(ls, F.get(hit, F.lit(0)))

    end_words = "(?imd)\\A([\\s\\S]*?)(?=^\\s*(?:Supplementary|Appendix|Methods|Acknowledgments|Author|Data)\\b|\\z)"
    out = df.withColumn("__head", tx.let(tx.lines(column), proven))
    out = out.withColumn("block_start", F.when(
        F.col("__head").isNotNull(), F.instr(F.col(column), F.col("__head")) - 1))
    rest = F.expr(f"substring({column}, block_start + 1, length({column}))")
    out = out.withColumn("block_end", F.col("block_start") + F.length(F.regexp_extract(rest, end_words, 1)))
    return out.drop("__head")


def parse_numbered_refs(df: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """C-14: ``1. …`` / ``1) …`` entries with their continuation lines; the last of a repeated number wins."""
    start = "^\\s*(\\d{1,4})[.)]\\s+(.*)"
    runs = tx.segments(tx.lines(column), lambda xs, i: F.get(xs, i).rlike(start))
    runs = F.filter(runs, lambda r: F.get(r["items"], F.lit(0)).rlike(start))
    entries = F.transform(runs, lambda r: F.struct(
        F.regexp_extract(F.get(r["items"], F.lit(0)), start, 1).try_cast("int").alias("num"),
        tx.strip(F.array_join(F.transform(r["items"], lambda x, i: F.when(
            i == 0, tx.strip(F.regexp_extract(x, start, 2))).otherwise(tx.strip(x))), " ")).alias("ref")))
    out = df.select(key, F.posexplode(entries).alias("pos", "e")).select(key, "pos", "e.*")
    return out.groupBy(key, "num").agg(F.max_by("ref", "pos").alias("ref"))


def is_supplement_title(line: Column) -> Column:
    s = tx.strip(line)
    first = F.get(F.split(s, "\\s+"), F.lit(0))
    return (
        (s != "")
        & (tx.word_count(s) <= 4)
        & s.rlike("^\\p{Lu}")
        & ~s.endswith(".")
        & (s.rlike("(?i)" + TITLE_WORDS) | ~first.isin(PARAGRAPH_OPENERS))
    )


def split_supplement(df: DataFrame, column: str = "text") -> DataFrame:
    """C-15: sections under title-like lines; a title with nothing under it is passed over."""
    runs = tx.segments(tx.lines(column), lambda xs, i: is_supplement_title(F.get(xs, i)))
    runs = F.filter(runs, lambda r: (F.size(r["items"]) > 1) & is_supplement_title(F.get(r["items"], F.lit(0))))
    keep = [c for c in df.columns if c != column]
    out = df.select(*keep, F.posexplode(runs).alias("n", "r"))
    title = F.regexp_replace(tx.strip(F.get("r.items", F.lit(0))), "(?U)[^\\w\\d]+", "_")
    return out.select(
        *keep, (F.col("n") + 1).alias("section_no"),
        F.concat(F.format_string("%02d_", F.col("n") + 1), title).alias("section"),
        tx.strip(F.array_join(F.expr("slice(r.items, 2, size(r.items))"), "\n")).alias("content"))


def number_bullets(df: DataFrame, column: str = "text") -> DataFrame:
    """C-17: non-blank lines without their bullet marks, ``BP_001`` … per row."""
    bare = F.transform(tx.lines(column), lambda x: F.regexp_replace(tx.strip(x), "^[•\\-*]+\\s*", ""))
    out = _explode(df, F.filter(bare, lambda x: x != ""), "n", "bullet", column)
    return out.withColumn("bullet_id", F.format_string("BP_%03d", F.col("n") + 1)).drop("n")


def split_slides(df: DataFrame, column: str = "text") -> DataFrame:
    """C-18: one row per ``Slide n:`` part with its header; text without any stays whole."""
    t = F.col(column)
    parts = F.split(F.regexp_replace(t, "(Slide \\d+:)", f"{tx.MARK}$1"), tx.MARK)
    slides = F.when(t.rlike("Slide \\d+:"), F.slice(parts, F.lit(2), F.size(parts))).otherwise(F.array(t))
    return _explode(df, slides, "slide_pos", "slide", column)


def split_plan_blocks(df: DataFrame, column: str = "text") -> DataFrame:
    """C-18: one row per ``===SLIDE_GROUP:`` block."""
    marked = F.regexp_replace(F.col(column), "(?md)^(===SLIDE_GROUP:)", f"{tx.MARK}$1")
    blocks = F.filter(F.transform(F.split(marked, tx.MARK), tx.strip), lambda b: b != "")
    return _explode(df, blocks, "block_no", "block", column)


def _field(c: Column, name: str) -> Column:
    return tx.strip(F.regexp_extract(c, f"(?imd)^\\s*{name}:[ \\t]*(.*)$", 1))


def parse_plan_blocks(df: DataFrame, column: str = "block") -> DataFrame:
    """C-19: fields of one group block, with its slides and figures as arrays."""
    b = F.col(column)
    terms = F.filter(F.transform(F.split(_field(b, "KEY_TERMS"), ","), tx.strip), lambda k: k != "")
    numbers = F.regexp_extract_all(b, F.lit("(?i)Slide\\s+(\\d+):\\s*(.*)"), F.lit(1))
    plans = F.regexp_extract_all(b, F.lit("(?i)Slide\\s+(\\d+):\\s*(.*)"), F.lit(2))
    span = "Slides\\s*([0-9]+)[–-]([0-9]+)"
    header = tx.strip(F.regexp_extract(b, "(?md)^\\s*(===SLIDE_GROUP:.*)$", 1))
    title = tx.strip(F.regexp_extract(b, "(?i)===\\s*SLIDE_GROUP:\\s*(.*?)\\s*\\|", 1))
    return df.select(
        *[c for c in df.columns if c != column],
        header.alias("header"),
        F.when(title != "", title).otherwise("UNNAMED_GROUP").alias("group_name"),
        F.nullif(F.regexp_extract(header, span, 1), F.lit("")).try_cast("int").alias("slide_from"),
        F.nullif(F.regexp_extract(header, span, 2), F.lit("")).try_cast("int").alias("slide_to"),
        _field(b, "PURPOSE").alias("purpose"),
        _field(b, "CONTENT_SCOPE").alias("content_scope"),
        _field(b, "KEY_TRANSITIONS").alias("key_transitions"),
        _field(b, "Transition").alias("transition"),
        tx.strip(F.regexp_extract(b, "(?md)^\\s*\\[SupMat\\]\\s*(.*)$", 1)).alias("supmat_notes"),
        terms.alias("key_terms"),
        F.transform(F.regexp_extract_all(b, F.lit("Include:\\s*(.*)"), F.lit(1)), tx.strip).alias("available_figures"),
        F.zip_with(numbers, plans, lambda n, p: F.struct(
            n.try_cast("int").alias("slide_id"), tx.strip(p).alias("plan"))).alias("slides"),
    )


def split_exercises(df: DataFrame, fmt: str = "C", key: Sequence[str] = ("doc_id",), column: str = "text") -> DataFrame:
    """C-20: numbered items; a new group starts when the numbering goes back.

    Item 0 of group 1 is the introduction before the first item. Rows that are chunks of one
    document start groups of their own, because a chunk change ends a group.
    """
    pattern = f"(?<!\\d)(?<![A-Za-z]){ITEM_FORMATS[fmt]}"
    marked = F.regexp_replace(F.col(column), pattern, f"{tx.MARK}$0")
    head = "^" + ITEM_FORMATS[fmt].split("(?=")[0]

    def placed(part: Column) -> Column:
        tag = F.regexp_extract(part, head, 1)
        return F.when(tag.rlike("^\\d+$"), tag.try_cast("int")).otherwise(F.ascii(tag) - F.ascii(F.lit("a")) + 1)

    def groups(parts: Column) -> Column:
        items = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.struct(
            placed(p).alias("placement"), tx.strip(p).alias("item")))
        runs = tx.segments(items, lambda xs, i: F.get(xs, i)["placement"] < F.get(xs, i - 1)["placement"])
        rows = F.flatten(F.transform(runs, lambda r, g: F.transform(r["items"], lambda x, k: F.struct(
            (g + 1).alias("grp"), (k + 1).alias("item_no"), x["placement"].alias("placement"), x["item"].alias("item")))))
        intro = F.array(F.struct(F.lit(1).alias("grp"), F.lit(0).alias("item_no"),
                                 F.lit(None).cast("int").alias("placement"),
                                 tx.strip(F.get(parts, F.lit(0))).alias("item")))
        return F.concat(intro, rows)

    return df.select(*key, F.inline(tx.let(F.split(marked, tx.MARK), groups)))


# --- extractors ----------------------------------------------------------------------------


def bracket_citations(df: DataFrame, column: str = "text", out: str = "citations") -> DataFrame:
    """C-21: distinct citation numbers, ascending."""
    nums = F.transform(F.regexp_extract_all(F.col(column), F.lit("\\[(\\d{1,4})\\]"), F.lit(1)), lambda n: n.try_cast("int"))
    return df.withColumn(out, F.array_sort(F.array_distinct(nums)))


def figure_tokens_expr(c: Column | str) -> Column:
    t = tx.col(c)
    plain = F.regexp_extract_all(t, F.lit("(?iU)\\b(Fig(?:ure)?\\.?\\s*\\d+[a-zA-Z]?)\\b"), F.lit(1))
    supp = F.regexp_extract_all(t, F.lit("(?iU)\\b(Supp(?:lementary)?\\.?\\s*Fig(?:ure)?\\.?\\s*\\d+)\\b"), F.lit(1))
    named = F.transform(F.array_union(plain, supp), lambda f: tx.strip(F.regexp_replace(
        F.regexp_replace(f, "(?i)fig(?:ure)?\\.?", "Figure"), "(?i)^Supp(?:lementary)?\\.?", "Supplementary")))
    return F.array_sort(F.array_distinct(named))


def figure_tokens(df: DataFrame, column: str = "text", out: str = "figures") -> DataFrame:
    """C-22: distinct figure mentions as ``Figure n`` / ``Supplementary Figure n``, ascending."""
    return df.withColumn(out, figure_tokens_expr(column))


def normalize_refs(df: DataFrame, column: str = "text", out: str = "figures") -> DataFrame:
    """C-23: bibliographic markers removed, figure markers to ``(fig target: text)`` and collected."""
    ref = "<ref\\b(?=[^>]*\\btype=\"%s\")%s[^>]*>([^<]*)</ref>"
    target = "(?=[^>]*\\btarget=\"#*([^\"#][^\"]*)\")"
    t = F.regexp_replace(F.col(column), "(?s)<ref\\b(?=[^>]*\\btype=\"bibr\")[^>]*?(?:/>|>.*?</ref>)", "")
    t = F.regexp_replace(t, ref % ("figure", target), "(fig $1: $2)")
    t = F.regexp_replace(t, "(?i)<ref\\b(?=[^>]*\\btype=\"figure\")[^>]*>([^<]*?fig(?:ure)?\\s*[_\\s]?(\\d+)[^<]*)</ref>",
                         "(fig $2: $1)")
    t = F.regexp_replace(t, ref % ("figure", ""), "(fig unknown: $1)")
    t = tx.squash(F.regexp_replace(t, "<[^>]+>", " "))
    labels = F.regexp_extract_all(t, F.lit("\\(fig ((?:[^()]|\\([^()]*\\))*)\\)"), F.lit(1))
    return df.withColumn(column, t).withColumn(out, F.array_sort(F.array_distinct(labels)))


def chunk_figures(df: DataFrame, column: str = "text") -> DataFrame:
    """C-23: parse the trailing ``Figures used in this chunk`` block; ``clean`` is the text before it."""

    def parse(ls: Column) -> Column:
        at = F.filter(tx.index_of(ls), lambda i: (i > F.size(ls) - 20) & F.get(ls, i).contains("Figures used in this chunk"))
        return tx.let(F.element_at(F.concat(F.array(F.lit(-1)), at), -1), lambda k: F.struct(
            F.concat(tx.strip(F.array_join(F.when(k >= 0, F.slice(ls, F.lit(1), F.greatest(k, F.lit(0)))).otherwise(ls), "\n")),
                     F.lit("\n")).alias("clean"),
            F.when(k >= 0, F.array_join(F.filter(F.transform(
                F.slice(ls, F.greatest(k, F.lit(0)) + 1, F.size(ls)), tx.strip), lambda x: x != ""), " ")).alias("meta")))

    out = df.withColumn("__p", tx.let(tx.lines(column), parse))
    hit = "#(fig_\\d+)(?=(.{0,40}))"
    ids = F.regexp_extract_all(F.col("__p.meta"), F.lit(hit), F.lit(1))
    tails = F.regexp_extract_all(F.col("__p.meta"), F.lit(hit), F.lit(2))
    found = F.filter(F.zip_with(ids, tails, lambda a, b: F.struct(
        a.alias("fig_id"), F.regexp_extract(b, ":\\s*([^\\s,]+)", 1).alias("label"),
        F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(b), F.lit("[a-z]"), F.lit(0)))).alias("panels"))),
        lambda x: x["label"] != "")
    none = F.array().cast("array<struct<fig_id:string,label:string,panels:array<string>>>")
    return out.withColumn("clean", F.col("__p.clean")).withColumn("mentions", F.coalesce(found, none)).drop("__p")


def normalize_doi(c: Column | str) -> Column:
    t = F.replace(F.replace(tx.strip(c), F.lit("DOI:"), F.lit("")), F.lit("doi:"), F.lit(""))
    return tx.strip(F.regexp_replace(tx.strip(t), "https?://doi\\.org/", ""))


def extract_doi(df: DataFrame, column: str = "text") -> DataFrame:
    """C-24: first ``doi`` in the text, its normal form and registrant ``prefix``."""
    doi = F.nullif(F.regexp_extract(column, "(?i)(10\\.\\d{4,9}/[-._;()/:A-Z0-9]+)", 1), F.lit(""))
    return df.withColumn("doi", normalize_doi(doi)).withColumn("prefix", F.get(F.split("doi", "/"), F.lit(0)))


def pdf_candidates(df: DataFrame, doi: str = "doi", links: str = "links", url: str = "url",
                   publisher: str = "publisher") -> DataFrame:
    """C-25: candidate download addresses of a paper in trial order, first occurrence kept."""
    d, u = F.col(doi), F.col(url)
    ref = F.concat(F.lit("https://doi.org/"), d)
    has = d.isNotNull() & (d != "")
    none = F.lit(None).cast("string")

    def cand(cond: Column, target: Column, referer: Column = none) -> Column:
        return F.when(cond & target.isNotNull() & (tx.strip(target) != ""),
                      F.struct(tx.strip(target).alias("url"), referer.alias("referer")))

    def rule(prefix: str, suffix: str = "", cond: Column = has, tail: Column = d, referer: Column = ref) -> Column:
        return cand(cond, F.concat(F.lit(prefix), tail, F.lit(suffix)), referer)

    arxiv = "(?:abs|pdf)/([0-9]{4}\\.[0-9]{4,5}(?:v\\d+)?)"
    given = F.coalesce(F.col(links), F.array().cast("array<string>"))
    known = F.filter(F.concat(F.array(u), given), lambda x: x.contains("arxiv.org") & x.rlike(arxiv))
    after_slash = F.element_at(F.split(d, "/"), -1)
    suffix = F.regexp_extract(d, "^[^/]*/([\\s\\S]*)$", 1)
    fixed = F.array(
        rule("https://link.aps.org/doi/", cond=has & d.startswith("10.1103/")),
        rule("https://journals.aps.org/pdf/", cond=has & d.startswith("10.1103/")),
        rule("https://www.science.org/doi/pdf/"),
        rule("https://www.science.org/doi/full/"),
        rule("https://www.nature.com/articles/", ".pdf", has & d.startswith("10.1038/"), suffix),
        rule("https://link.springer.com/content/pdf/", ".pdf"),
        rule("https://onlinelibrary.wiley.com/doi/pdf/"),
        rule("https://onlinelibrary.wiley.com/doi/epdf/"),
        rule("https://doi.org/", referer=none),
        rule("https://journals.plos.org/plosone/article/file?id=", "&type=printable",
             has & F.lower(F.coalesce(F.col(publisher), F.lit(""))).contains("plos")),
        cand(u.isNotNull(), u),
    )
    ordered = F.concat(
        F.transform(given, lambda x: cand(F.lit(True), x, F.when(has, ref))),
        F.array(rule("https://arxiv.org/pdf/", ".pdf", has & F.lower(d).contains("arxiv") & (after_slash != ""),
                     after_slash, none)),
        F.transform(known, lambda x: cand(F.lit(True), F.concat(
            F.lit("https://arxiv.org/pdf/"), F.regexp_extract(x, arxiv, 1), F.lit(".pdf")))),
        fixed,
    )
    first = tx.let(F.array_compact(ordered), lambda xs: F.filter(xs, lambda x, i: F.array_position(
        F.transform(xs, lambda y: y["url"]), x["url"]) == i + 1))
    keep = [c for c in df.columns if c not in (links, url, publisher)]
    out = df.select(*keep, F.posexplode(first).alias("cand_rank", "__c"))
    return out.select(*keep, "cand_rank", F.col("__c.url").alias("pdf_url"), F.col("__c.referer").alias("referer"))


def strip_fences(c: Column | str) -> Column:
    s = tx.strip(F.coalesce(tx.col(c), F.lit("")))
    inner = F.regexp_extract(s, "\\A```[^\\n]*\\n([\\s\\S]*)\\z", 1)
    inner = F.when(inner.contains("```"), F.regexp_extract(inner, "\\A([\\s\\S]*)```[\\s\\S]*?\\z", 1)).otherwise(inner)
    return F.when(s.startswith("```"), tx.strip(inner)).otherwise(s)


def _object(c: Column) -> Column:
    """The text if it is exactly one JSON object. The parser stops after a value and ignores what
    follows, so the text is read as the only element of a list."""
    v = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    return F.when(F.schema_of_variant(v).startswith("ARRAY<OBJECT") & F.try_variant_get(v, "$[1]", "variant").isNull(), c)


def extract_json(df: DataFrame, column: str = "raw", out: str = "json") -> DataFrame:
    """C-26: the JSON object in free model output, null when there is none.

    Order: fenced or plain text, first ``{`` to last ``}``, the same with raw control
    characters in strings escaped, then the longest head that ends in ``}`` and parses.
    """
    s = strip_fences(column)
    cand = F.regexp_extract(s, "\\{[\\s\\S]*\\}", 0)

    def escape(x: Column) -> Column:
        tokens = F.regexp_extract_all(x, F.lit("\"[^\"\\\\]*(?:\\\\[\\s\\S][^\"\\\\]*)*\"?|[^\"]+"), F.lit(0))
        return F.array_join(F.transform(tokens, lambda t: F.when(t.startswith("\""), F.replace(F.replace(F.replace(
            t, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))).otherwise(t)), "")

    def heads(x: Column) -> Column:
        return tx.let(F.split(x, "\\}"), lambda ps: F.get(F.filter(F.transform(
            F.when(F.size(ps) > 2, F.sequence(F.size(ps) - 2, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>")),
            lambda k: _object(F.concat(F.array_join(F.slice(ps, F.lit(1), k), "}"), F.lit("}")))),
            lambda y: y.isNotNull()), F.lit(0)))

    found = tx.let(escape(cand), lambda e: F.coalesce(_object(s), _object(cand), _object(e), heads(e)))
    return df.withColumn(out, found)


def extract_json_items(df: DataFrame, column: str = "raw", out: str = "items") -> DataFrame:
    """C-26: every top-level array's elements and every top-level object, merged in order, as JSON text."""

    @F.pandas_udf("array<string>")
    def scan(col: pd.Series) -> pd.Series:
        import json

        closers = {"[": "]", "{": "}"}

        def items(s: str) -> list[str]:
            found, i = [], 0
            while i < len(s):
                if s[i] not in closers:
                    i += 1
                    continue
                depth, j = 1, i + 1
                while j < len(s) and depth:
                    depth += (s[j] == s[i]) - (s[j] == closers[s[i]])
                    j += 1
                try:
                    value = json.loads(s[i:j])
                except ValueError:
                    value = []
                found += value if isinstance(value, list) else [value]
                i = j
            return [json.dumps(v, ensure_ascii=False) for v in found]

        return col.map(lambda s: items(s or ""))

    return df.withColumn(out, scan(strip_fences(column)))


def tagged_lines(df: DataFrame, tags: Sequence[str], column: str = "raw", out: str = "lines") -> DataFrame:
    """C-27: lines that carry one of the tags once list marks are gone; all lines if none does."""
    tag = "(?i)^\\[(" + "|".join(re.escape(t) for t in tags) + ")\\]\\s*"
    plain = F.filter(F.transform(tx.lines(strip_fences(column)), tx.strip), lambda x: x != "")
    bare = F.transform(plain, lambda x: tx.strip(F.regexp_replace(x, "^\\s*(?:[-*]|\\d+[).\\]]|•)\\s*", "")))
    kept = F.filter(bare, lambda x: x.rlike(tag))
    return df.withColumn(out, F.when(F.size(kept) > 0, kept).otherwise(plain))


def flatten_json(c: Column, depth: int = 3) -> Column:
    """``key: value`` lines of a JSON list of objects; lists nest, other values print as they are."""
    items = F.from_json(F.when(tx.strip(c).startswith("{"), F.concat(F.lit("["), c, F.lit("]"))).otherwise(c), "array<string>")

    def value(v: Column) -> Column:
        if depth <= 1:
            return v
        return F.when(v.startswith("["), F.coalesce(flatten_json(v, depth - 1), v)).otherwise(v)

    def item(x: Column) -> Column:
        pairs = F.map_entries(F.from_json(x, "map<string,string>"))
        as_lines = F.array_join(F.transform(pairs, lambda p: F.concat(
            p["key"], F.lit(": "), F.coalesce(value(p["value"]), F.lit("None")))), "\n")
        return F.when(x.startswith("{"), as_lines).otherwise(value(x))

    return F.array_join(F.transform(items, item), "\n")


def flatten_variant(df: DataFrame, column: str, out: str = "lines", depth: int = 3) -> DataFrame:
    """C-28: nested list/dict JSON to ``key: value`` lines."""
    return df.withColumn(out, flatten_json(F.col(column), depth))


def labelled_lines(df: DataFrame, labels: Sequence[str], key: str, order: str, column: str = "text") -> DataFrame:
    """C-29: value after each ``label:``; ``<label>`` of this row or null, ``<label>_carried`` from
    the nearest earlier row of the key that had one."""
    out = df
    for label in labels:
        value = F.nullif(tx.strip(F.regexp_extract(column, f"(?i){re.escape(label)}:[ \\t]*(.+)", 1)), F.lit(""))
        out = out.withColumn(label, value)
    return carried(out, [key], order, {f"{label}_carried": F.col(label) for label in labels})


def section_roles(df: DataFrame, key: str, order: str, n_paras: str = "n_paras", text: str = "text") -> DataFrame:
    """C-30: role of each section from paragraph counts and keywords.

    ``order`` numbers a document's sections 0, 1, 2 … Both starts are aggregates, so no
    document is gathered in one place.
    """
    pos, n = F.col(order), F.col(n_paras)
    kw = F.col(text).rlike("(?i)" + "|".join(SUPPLEMENT_HEADINGS))
    first = F.max(F.when(pos == 0, n)) >= 5
    second = F.max(F.when(pos == 1, n)) >= 5
    starts = df.groupBy(key).agg(
        F.when(first, 0).when(second, 1).otherwise(
            F.coalesce(F.min(F.when(~kw & (n >= 3), pos)), F.lit(0))).alias("main_start"),
        F.coalesce(first | second, F.lit(False)).alias("sure"),
    )
    marked = df.join(starts, key)
    supp = marked.filter((pos > F.col("main_start")) & ((n >= 3) | (~F.col("sure") & kw))).groupBy(key).agg(
        F.min(order).alias("supp_start"))
    out = marked.join(supp, key, "left")
    role = F.when(pos < F.col("main_start"), "front").when(pos >= F.col("supp_start"), "supplement").otherwise("main")
    return out.withColumn("role", role).drop("sure")
