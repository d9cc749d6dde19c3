"""Aggregations and quality reports (E).

Reports that name every owner of a repeated item give one row per owner: a list of owners
would grow with the corpus, rows do not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import text as tx


def figure_index(chunks: DataFrame, key: str = "doc_id", figures: str = "figures") -> DataFrame:
    """E-01: inverted index, one row per (key, figure, chunk_no); order by them at read time."""
    return chunks.select(key, F.explode(figures).alias("figure"), "chunk_no").distinct()


def figure_index_lists(chunks: DataFrame, key: str = "doc_id", figures: str = "figures") -> DataFrame:
    """E-01: the index as text per figure, ``001, 004``; bounded by the chunks of one document."""
    idx = figure_index(chunks, key, figures).groupBy(key, "figure").agg(F.array_sort(F.collect_list("chunk_no")).alias("c"))
    return idx.select(key, "figure", F.array_join(F.transform("c", lambda n: F.lpad(n.cast("string"), 3, "0")), ", ").alias("chunks"))


def count_by_source(df: DataFrame, column: str = "source") -> DataFrame:
    """E-02: rows per upper-case source, blank counted as ``UNKNOWN``."""
    name = F.upper(tx.strip(F.coalesce(column, F.lit(""))))
    return df.groupBy(F.when(name == "", "UNKNOWN").otherwise(name).alias("source")).agg(F.count("*").alias("n"))


def slice_by_source(df: DataFrame, source: str, column: str = "source") -> DataFrame:
    """E-02: rows of one source, compared trimmed and upper-case."""
    return df.filter(F.upper(tx.strip(F.coalesce(column, F.lit("")))) == source.upper().strip())


def consensus(df: DataFrame, min_occurrences: int, item: str = "item", pos: Sequence[str] = ("pos",),
              key: Sequence[str] = ()) -> DataFrame:
    """E-03: items seen at least ``min_occurrences`` times, with their first position for ordering."""
    return df.groupBy(*key, item).agg(F.count("*").alias("n"), F.min(F.struct(*pos)).alias("__f")).filter(
        F.col("n") >= min_occurrences).select(*key, item, "n", F.col("__f.*"))


def _normal(c: Column | str) -> Column:
    return tx.squash(F.lower(tx.strip(c)))


def repetition_report(df: DataFrame, owner: str = "doc_id", column: str = "text", unit: str = "line", min_len: int = 0) -> DataFrame:
    """E-04: normalised units owned at least twice, with number of uses, of owners and the first owner.

    ``unit="line"`` takes lines, ``"sentence"`` cuts at ``.!?`` and applies ``min_len`` (40 in the
    source behaviour). Counting is combined on the map side, so a unit held by a third of all
    documents shuffles one row per task.
    """
    return _units(df, owner, column, unit, min_len).groupBy("unit").agg(
        F.count("*").alias("n_uses"), F.min(owner).alias("first_owner")).filter(F.col("n_uses") >= 2)


def _units(df: DataFrame, owner: str, column: str, unit: str, min_len: int) -> DataFrame:
    parts = tx.lines(column) if unit == "line" else F.split(F.col(column), "[.!?]\\s+")
    units = F.filter(F.transform(parts, _normal), lambda u: (u != "") & (F.length(u) >= min_len))
    return df.select(owner, F.explode(units).alias("unit"))


def repetition_owners(df: DataFrame, owner: str = "doc_id", column: str = "text", unit: str = "line", min_len: int = 0) -> DataFrame:
    """E-04: one row per repeated unit and owner, with its uses there. Owners are pre-counted, so a hot
    unit joins as few rows as it has owners and adaptive execution can split it."""
    uses = _units(df, owner, column, unit, min_len).groupBy("unit", owner).agg(F.count("*").alias("n"))
    totals = uses.groupBy("unit").agg(F.sum("n").alias("n_uses")).filter(F.col("n_uses") >= 2)
    return uses.join(totals, "unit")


def reused_figures(df: DataFrame, figure: str = "figure") -> DataFrame:
    """E-05: figures mentioned more than once over all groups."""
    return df.groupBy(figure).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def resolution_report(usages: DataFrame, cands: DataFrame, slides: DataFrame) -> DataFrame:
    """E-06: one row of counts over the resolved usages; bullets are counted over all candidates."""
    per = cands.groupBy("bullet_id").agg(F.count("*").alias("n"))
    kinds = usages.agg(*[F.count_if(F.col("usage") == u).alias(name) for u, name in (
        ("primary", "primary_assignments"), ("reminder", "reminders"), ("drop", "drops"))])
    return kinds.select(
        slides.select("slide_uid").distinct().agg(F.count("*")).scalar().alias("num_slides"),
        per.agg(F.count("*")).scalar().alias("num_bullets_seen"),
        per.agg(F.count_if(F.col("n") > 1)).scalar().alias("bullets_with_duplicates"), "*")


def run_summary(df: DataFrame, ok: Column) -> DataFrame:
    """E-07: total, succeeded, failed and percentage (0 for no rows)."""
    t = df.agg(F.count("*").alias("total"), F.count_if(ok).alias("ok"))
    return t.select("total", "ok", (F.col("total") - F.col("ok")).alias("failed"),
                    F.when(F.col("total") > 0, 100.0 * F.col("ok") / F.col("total")).otherwise(0.0).alias("pct"))


def papers_per_notion(df: DataFrame, notion: str = "notion") -> DataFrame:
    """E-08: papers of each notion; ascending by ``n`` at read time."""
    return df.groupBy(notion).agg(F.count("*").alias("n"))


def has_real_references(bib: DataFrame, min_real: int = 3, key: str = "doc_id",
                        fields: Sequence[str] = ("authors", "title", "year", "journal", "doi", "publisher")) -> DataFrame:
    """E-09: whether a document has at least ``min_real`` entries with any filled field."""
    have = [f for f in fields if f in bib.columns]
    filled = tx.any_of([F.coalesce(tx.strip(F.col(f).cast("string")), F.lit("")) != "" for f in have])
    return bib.groupBy(key).agg(F.count_if(filled).alias("n_real")).withColumn("has_real", F.col("n_real") >= min_real)


def distinct_references(df: DataFrame, column: str = "ref") -> DataFrame:
    """E-10: distinct references; ``sorted_by`` them at the sink."""
    return df.select(column).distinct()


def length_stats(df: DataFrame, column: str = "text", by: Sequence[str] = ()) -> DataFrame:
    """E-11: number of chunks and whole mean length."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.length(column).cast("long")).alias("chars")).withColumn(
        "mean_len", F.floor(F.col("chars") / F.col("n")).cast("long"))


def allocate_slots(groups: DataFrame, total: int, key: Sequence[str], order: str) -> DataFrame:
    """E-12: ``total`` slots over the groups of a key; the first groups get the remainder.

    Closed form of position and group count, so no running sum is needed: ``order`` numbers the
    groups 0, 1, 2 … inside the key.
    """
    n = groups.groupBy(*key).agg(F.count("*").alias("n"))
    i = F.col(order)
    base, rem = F.floor(F.lit(total) / F.col("n")), F.lit(total) % F.col("n")
    start = base * i + F.least(i, rem) + 1
    size = base + F.when(i < rem, 1).otherwise(0)
    return groups.join(n, list(key)).select(
        *groups.columns, size.cast("long").alias("slots"), start.cast("long").alias("slot_from"),
        (start + size - 1).cast("long").alias("slot_to"))


def roll_up(df: DataFrame, key: str | Sequence[str], order: str | Sequence[str], sep: str = "\n", column: str = "text") -> DataFrame:
    """E-13: texts of a group joined in order. The result is one cell, so the group must be one
    that belongs in one text, such as a document or a deck."""
    ks = [key] if isinstance(key, str) else list(key)
    os_ = [order] if isinstance(order, str) else list(order)
    item = F.struct(*os_, F.col(column).alias("__t"))
    return df.groupBy(*ks).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(item)), lambda x: x["__t"]), sep).alias(column))


def figures_overview(figures: DataFrame, docs: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """E-14: ``Figure label: summary`` lines per document by figure id; ``No figures.`` for a
    document of ``docs`` without any."""
    label = F.coalesce("label", F.replace(F.col("fig_id"), F.lit("fig_"), F.lit("")))
    line = F.concat(F.lit("Figure "), label, F.lit(": "), F.coalesce("summary", F.lit("")))
    out = roll_up(figures.withColumn("overview", line), key, "fig_id", "\n", "overview")
    if docs is not None:
        out = docs.select(key).distinct().join(out, key, "left").withColumn("overview", F.coalesce("overview", F.lit("No figures.")))
    return out
