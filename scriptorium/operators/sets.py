"""Set operations: tagged unions, first-seen dedupe, except (H).

First-seen is ``min_by`` over a hash: it combines before the shuffle, so a group of copies
that holds a third of all rows is reduced where it lies.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as tx


def union_sources(sources: Mapping[str, DataFrame]) -> DataFrame:
    """H-01: union of sources tagged by name; columns a source lacks are null."""
    tagged = [df.withColumn("source", F.lit(name)) for name, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def dedupe_evidence(df: DataFrame, key: Sequence[str], order: Sequence[str], column: str = "text") -> DataFrame:
    """H-02: first row in ``order`` of each whole normal text, blank texts dropped.

    Rows are grouped by the hash of the text; the aggregate carries the first row and merges copies before the shuffle.
    """
    norm = F.lower(tx.squash(F.coalesce(column, F.lit(""))))
    rest = [c for c in df.columns if c not in key]
    hashed = df.withColumn("__n", norm).filter(F.col("__n") != "").withColumn("__h", F.sha2("__n", 256)).drop("__n")
    kept = hashed.groupBy(*key, "__h").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return kept.select(*key, "__r.*").select(df.columns)


def merge_fact_banks(banks: Sequence[DataFrame], key: Sequence[str], order: Sequence[str], column: str = "line") -> DataFrame:
    """H-03: tagged lines of all banks, first of each body kept whatever its tag; untagged lines dropped."""
    tagged = [b.withColumn("bank_no", F.lit(i)) for i, b in enumerate(banks)]
    rows = reduce(DataFrame.unionByName, tagged)
    s = tx.strip(column)
    rows = rows.filter(s.startswith("[") & s.contains("]"))
    tag, body = F.regexp_extract(s, "^([^\\]]*\\])", 1), F.regexp_extract(s, "^[^\\]]*\\]([\\s\\S]*)$", 1)
    rows = rows.withColumn("__h", F.sha2(F.lower(tx.squash(body)), 256)).withColumn(
        "fact", tx.strip(F.concat(tag, F.lit(" "), tx.strip(body))))
    kept = rows.groupBy(*key, "__h").agg(F.min_by(F.struct("bank_no", *order, "fact"), F.struct("bank_no", *order)).alias("r"))
    return kept.select(*key, "r.*")


def merge_edges(edges: DataFrame, cap: int | None = None, key: str = "slide_uid", order: Sequence[str] = ("pos",)) -> DataFrame:
    """H-04: distinct edges, self and untyped ones dropped, in order; with ``cap`` the first so many of each slide.

    ``edges``: key, src, dst, type, label and the order columns.
    """
    e = edges.withColumn("type", tx.strip(F.coalesce("type", F.lit("")))).withColumn("label", tx.strip(F.coalesce("label", F.lit(""))))
    e = e.filter(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("type") != "") & (F.col("src") != F.col("dst")))
    first = e.groupBy(key, "src", "dst", "type", "label").agg(F.min(F.struct(*order)).alias("__f"))
    w = Window.partitionBy(key).orderBy("__f")
    ranked = first.withColumn("rank", F.row_number().over(w)).drop("__f")
    return ranked if cap is None else ranked.filter(F.col("rank") <= cap)


def first_seen(df: DataFrame, column: str) -> DataFrame:
    """H-05: array column without repeats, first occurrences kept in order."""
    return df.withColumn(column, F.array_distinct(column))


def add_missing_figures(chunks: DataFrame, captions: DataFrame, key: str = "doc_id") -> DataFrame:
    """H-06: captions whose figure no chunk of the document lists, to be added to its first chunk.

    ``chunks``: key, chunk_no, figures array<string>. ``captions``: key, fig_id, caption.
    """
    have = chunks.select(key, F.explode("figures").alias("fig_id")).distinct()
    first = chunks.groupBy(key).agg(F.min("chunk_no").alias("chunk_no"))
    return captions.join(have, [key, "fig_id"], "left_anti").join(first, key).select(key, "chunk_no", "fig_id", "caption")


def shift_boundary(chunks: DataFrame, paras: DataFrame, key: str = "doc_id") -> DataFrame:
    """H-07: the first main chunk that contains the supplement's first paragraph is cut there.

    ``chunks``: key, kind (main/sup), chunk_no, text. ``paras``: key, para. The head stays main, the tail opens
    the supplement with number 0; documents without a supplement or a hit inside a chunk stay as they are.
    """
    has_sup = chunks.filter(F.col("kind") == "sup").select(key).distinct()
    main = chunks.filter(F.col("kind") == "main").join(paras.filter(F.col("para") != ""), key).join(has_sup, key, "left_semi")
    hits = main.filter(F.col("text").contains(F.col("para"))).groupBy(key).agg(F.min("chunk_no").alias("hit"), F.first("para").alias("para"))
    c = chunks.join(hits, key, "left")
    at = F.instr(F.col("text"), F.col("para")) - 1
    cut = F.coalesce((F.col("kind") == "main") & (F.col("chunk_no") == F.col("hit")) & (at > 0), F.lit(False))
    whole = F.array(F.struct("kind", "chunk_no", "text"))
    two = F.array(
        F.struct("kind", "chunk_no", tx.strip(F.left("text", at)).alias("text")),
        F.struct(F.lit("sup").alias("kind"), F.lit(0).cast(chunks.schema["chunk_no"].dataType).alias("chunk_no"),
                 tx.strip(F.substring("text", at + 1, F.length("text"))).alias("text")))
    return c.select(key, F.inline(F.when(cut, two).otherwise(whole)))
