"""Nested plan JSON to flat tables and back (A)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators.resolve import slide_number

CANDIDATE = "struct<bullet_id:string,priority:double,exclusivity:string,argument:string>"
SLIDE = f"struct<slide_uid:string,slide_id:int,plan:string,slide_context:string,figure_used:string,candidates:array<{CANDIDATE}>>"
GROUP = ("struct<group_id:string,group_name:string,purpose:string,scope:string,transition:string,supmat_notes:string,"
         f"available_figures:array<string>,slides:array<{SLIDE}>>")
PLAN_FILE = f"groups array<{GROUP}>, numbered_bullets array<struct<bullet_id:string,text:string>>"
PLAN = f"struct<groups:array<{GROUP}>,numbered_bullets:array<struct<bullet_id:string,text:string>>>"
DECK_SLIDE = ("struct<slide_uid:string,title:string,figure_used:string,on_slide_bullets:array<string>,speaker_notes:string,"
              "transition:string,reminders:array<string>>")


def read_plan_files(spark: SparkSession, path: str) -> DataFrame:
    """A-12: plan files as (deck_id, plan) with the given schema; the file name is the deck."""
    df = spark.read.schema(PLAN_FILE).option("multiLine", True).json(path)
    return df.select(F.regexp_replace(F.col("_metadata.file_name"), "\\.json$", "").alias("deck_id"), F.struct("groups", "numbered_bullets").alias("plan"))


def parse_plans(df: DataFrame, column: str = "raw") -> DataFrame:
    """A-12: plan text column to the typed ``plan``."""
    return df.withColumn("plan", F.from_json(column, PLAN)).drop(column)


def plan_tables(df: DataFrame, deck: str = "deck_id") -> dict[str, DataFrame]:
    """A-12: groups, slides, candidates and bullets of (deck, plan) rows."""
    g = df.select(deck, F.posexplode("plan.groups").alias("group_index", "g"))
    slides = g.select(deck, "group_index", F.col("g.group_id").alias("group_id"), F.col("g.group_name").alias("group_name"), F.explode("g.slides").alias("s"))
    cands = slides.select(deck, "group_id", F.col("s.slide_uid").alias("slide_uid"), F.posexplode("s.candidates").alias("pos", "c"))
    return {
        "groups": g.select(deck, "group_index", *[F.col(f"g.{c}").alias(c) for c in (
            "group_id", "group_name", "purpose", "scope", "transition", "supmat_notes", "available_figures")]),
        "slides": slides.select(deck, "group_index", "group_id", "group_name", *[F.col(f"s.{c}").alias(c) for c in (
            "slide_uid", "slide_id", "plan", "slide_context", "figure_used")]),
        "candidates": cands.select(deck, "group_id", "slide_uid", "pos", "c.*"),
        "bullets": df.select(deck, F.posexplode("plan.numbered_bullets").alias("pos", "b")).select(
            deck, "pos", F.col("b.bullet_id").alias("bullet_id"), F.col("b.text").alias("bullet_text")),
    }


def build_plan(tables: dict[str, DataFrame], deck: str = "deck_id") -> DataFrame:
    """A-13: the inverse of ``plan_tables``: one JSON text per deck, groups and slides in order."""
    c = tables["candidates"].groupBy(deck, "slide_uid").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "bullet_id", "priority", "exclusivity", "argument"))),
        lambda x: F.struct(x["bullet_id"], x["priority"], x["exclusivity"], x["argument"])).alias("candidates"))
    fields = ("slide_uid", "slide_id", "plan", "slide_context", "figure_used", "candidates")
    s = tables["slides"].join(c, [deck, "slide_uid"], "left").withColumn(
        "candidates", F.coalesce("candidates", F.array().cast(f"array<{CANDIDATE}>")))
    s = s.groupBy(deck, "group_index").agg(F.transform(F.array_sort(F.collect_list(F.struct(
        slide_number("slide_uid").alias("__n"), *fields))), lambda x: F.struct(*[x[f] for f in fields])).alias("slides"))
    names = ("group_id", "group_name", "purpose", "scope", "transition", "supmat_notes", "available_figures", "slides")
    g = tables["groups"].join(s, [deck, "group_index"], "left").groupBy(deck).agg(F.transform(F.array_sort(F.collect_list(
        F.struct("group_index", *names))), lambda x: F.struct(*[x[f] for f in names])).alias("groups"))
    b = tables["bullets"].groupBy(deck).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "bullet_id", "bullet_text"))),
                                                       lambda x: F.struct(x["bullet_id"], x["bullet_text"].alias("text"))).alias("numbered_bullets"))
    return g.join(b, deck, "left").select(deck, F.to_json(F.struct("groups", "numbered_bullets")).alias("raw"))


def write_plan(tables: dict[str, DataFrame], path: str, deck: str = "deck_id") -> None:
    """A-13: one JSON document per line and deck."""
    build_plan(tables, deck).select("raw").write.mode("overwrite").text(path)


def read_deck(spark: SparkSession, path: str) -> DataFrame:
    """A-12: finished decks, one row per slide with its position."""
    df = spark.read.schema(f"slides array<{DECK_SLIDE}>").option("multiLine", True).json(path)
    return df.select(F.regexp_replace(F.col("_metadata.file_name"), "\\.json$", "").alias("deck_id"), F.posexplode("slides").alias("idx", "s")).select("deck_id", "idx", "s.*")
