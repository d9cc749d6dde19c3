"""Projections, filters and predicates over text columns (B).

All line rules run inside the row with higher-order functions: cleaning a corpus is a map.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import text as tx

# Unit names that mark an axis label.
UNITS = ["kHz", "Hz", "s", "ms", "nm", "μm", "cm", "dB", "mol", "K", "°C", "×10"]
# Words that mark a submission or publication line.
SUBMISSION_WORDS = [
    "Received", "Accepted", "Submitted", "Revised", "Published",
    "Publication", "Online", "Posted", "Issued",
]
# Characters of a formula-only line.
MATH_LINE = "^[±√∞α-ωΑ-Ω0-9∇=+\\-*/^≈∑∏∫≤≥≠÷⋅×·]+$"
# Phrases that disqualify a notion line, and over-specific fragments.
NOTION_STOP = [
    "slide", "here", "note", "new slide", "central to", "provided", "based on", "core",
    "scientific", "identified", "analysis", "content available", "presentation", "work",
    "not provided",
]
NOTION_SPECIFIC = [
    "gain in", "frequency difference", "maximum gain", "specific atomic", "implied by",
]
# Terms of the results classifier.
RESULT_TERMS = [
    "results", "result", "data", "measurement", "measured", "observed", "scan", "spectrum",
]
REGIME_TERMS = [
    "regime", "regimes", "zones", "zone i", "zone ii", "zone iii", "zone iv", "hysteresis",
    "frequency pinning", "linewidth", "threshold", "bistability",
]
# Phrases that announce a conclusion.
CONCLUSION_TERMS = [
    "in conclusion", "we conclude", "to summarize", "overall", "in summary",
    "this work demonstrates", "we have shown", "our results indicate", "conclusions",
]
# Weights and defaults of candidate coercion.
PRIORITY_DEFAULT, PRIORITY_FLOOR, PRIORITY_CEIL = 0.5, 0.35, 1.0
EXCLUSIVITY = ["strong", "medium", "weak"]

# Accented Latin letters and their plain forms, for ASCII folding of keys.
FOLD_FROM = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöøùúûüýÿ"
FOLD_TO = "AAAAAACEEEEIIIINOOOOOOUUUUYaaaaaaceeeeiiiinoooooouuuuyy"


# --- line predicates -------------------------------------------------------------------


def is_axis_line(line: Column) -> Column:

    def test(s: Column) -> Column:
        crowd = tx.let(F.split(s, "\\s+"), lambda tokens: (F.size(tokens) >= 3) & (
            F.size(F.filter(tokens, lambda t: F.length(t) < 3)) > F.size(tokens) / 2))
        return (
            (F.length(s) <= 2)
            | s.rlike("^[\\d\\s.()×eE\\-+]+$")
            | s.rlike("(?U)\\b(" + "|".join(UNITS) + ")\\b")
            | crowd
        )

    return tx.let(tx.strip(line), test)


def is_equation_line(line: Column) -> Column:

    def test(s: Column) -> Column:
        return (
            (s != "")
            & (F.length(s) <= 100)
            & (
                s.rlike(MATH_LINE)
                | (s.rlike("[α-ωΑ-Ω]") & (F.regexp_count(s, F.lit("(?U)\\w")) < 3))
                | (tx.count_of(s, "=") > 1)
                | (tx.count_of(s, "+") > 2)
                | (tx.count_of(s, "–") > 1)
            )
        )

    return tx.let(tx.strip(line), test)


def is_metadata_line(line: Column) -> Column:

    def test(s: Column) -> Column:
        submission = s.rlike("(?iU)\\b(" + "|".join(SUBMISSION_WORDS) + ")\\b") & s.rlike("\\d{4}")
        volume = s.rlike(
            "(?U)\\b(?:Volume|Vol\\.?|Issue|pp?\\.?\\s*\\d+[–-]\\d+|\\|\\s*\\d+\\s*[–-]\\d+)\\b"
        )
        return (s != "") & (s.contains("@") | submission | volume)

    return tx.let(tx.strip(line), test)


def is_author_line(line: Column, ratio: float = 0.60) -> Column:
    """Uppercase letters per alphabetic word at or above ``ratio``, at least two of them."""

    def test(s: Column) -> Column:
        word = "[\\p{L}\\p{N}_.\\-]"
        n_words = F.regexp_count(s, F.lit(f"{word}*\\p{{L}}{word}*"))
        n_upper = F.regexp_count(s, F.lit("\\p{Lu}"))
        return (
            (s != "")
            & (F.length(s) <= 600)
            & (n_upper > 1)
            & (n_words > 0)
            & (n_upper / n_words >= ratio)
        )

    return tx.let(tx.strip(line), test)


def is_running_line(line: Column) -> Column:

    def test(s: Column) -> Column:
        return (
            s.rlike("^https?://|^DOI|^doi|^www\\.|^Nature|^Science|^arXiv")
            | s.rlike("^\\d{1,3}\\s*$")
            | s.rlike("^\\(?\\d{4}\\)?$")
            | s.rlike("^[A-Z][A-Za-z,\\-\\s]+et al\\.$")
            | s.rlike("^[A-Z][A-Za-z\\-\\s]+[A-Z][A-Za-z\\-\\s]+$")
        )

    return tx.let(tx.strip(line), test)


def is_short_junk(line: Column) -> Column:

    def test(s: Column) -> Column:
        return (F.length(s) < 100) & (
            s.rlike("^\\p{Nd}+$") | s.rlike("^https?://") | s.rlike("^[A-Z]{3,}$")
        )

    return tx.let(tx.strip(line), test)


def is_caps_line(line: Column) -> Column:
    """Shorter than 180 characters and more than 45% of its letters uppercase."""

    def test(s: Column) -> Column:
        letters = F.regexp_count(s, F.lit("\\p{L}"))
        upper = F.regexp_count(s, F.lit("\\p{Lu}"))
        return (s != "") & (F.length(s) < 180) & (letters > 0) & (upper / letters > 0.45)

    return tx.let(tx.strip(line), test)


def is_header_line(line: Column) -> Column:

    def test(s: Column) -> Column:
        low = F.lower(s)
        all_caps = s.rlike("\\p{Lu}") & ~s.rlike("\\p{Ll}")
        return (
            (s != "")
            & (F.length(s) <= 150)
            & (all_caps | s.rlike("^\\d+\\.") | low.contains("supplementary") | low.contains("method"))
        )

    return tx.let(tx.strip(line), test)


# --- operators -------------------------------------------------------------------------


def normalize_ws(df: DataFrame, column: str = "text") -> DataFrame:
    """B-01: blanks and tabs to one space, any line end to ``\\n``, at most one blank line."""
    t = F.regexp_replace(F.col(column), "[ \\t]+", " ")
    t = F.regexp_replace(t, "\\r\\n|\\r", "\n")
    return df.withColumn(column, F.regexp_replace(t, "\\n{3,}", "\n\n"))


def normalize_match(df: DataFrame, column: str = "text", out: str = "norm") -> DataFrame:
    """B-02: the form both sides of a fuzzy link are compared in."""
    return df.withColumn(out, tx.match_form(column))


def safe_key_expr(c: Column | str, variant: str = "folded", max_len: int = 120) -> Column:
    c = F.coalesce(tx.col(c), F.lit(""))
    if variant == "folded":
        c = F.regexp_replace(F.translate(c, FOLD_FROM, FOLD_TO), "ß", "ss")
        return F.left(F.btrim(F.regexp_replace(
            F.regexp_replace(c, "(?U)[^\\w\\s\\-().\\[\\]]+", ""), "\\s+", "_"), F.lit("_")), F.lit(max_len))
    if variant == "basic":
        return F.left(F.btrim(F.regexp_replace(
            F.regexp_replace(c, "(?U)[^\\w\\s\\-().\\[\\]]+", ""), "\\s+", "_"), F.lit("_")), F.lit(max_len))
    if variant == "path":
        return F.left(F.btrim(F.regexp_replace(
            F.regexp_replace(c, "[\\\\/*?:\"<>|]", ""), "\\s+", "_"), F.lit("_")), F.lit(max_len))
    if variant == "short":
        return F.left(F.replace(
            F.regexp_replace(c, "[\\\\/*?:\"<>|]", ""), F.lit(" "), F.lit("_")), F.lit(80))
    if variant == "title":
        return F.left(F.btrim(F.regexp_replace(
            F.regexp_replace(c, "(?U)[^\\w\\s\\-]", ""), "\\s+", "_"), F.lit("_")), F.lit(100))
    raise ValueError(f"unknown key variant: {variant}")


def safe_key(df: DataFrame, variant: str = "folded", column: str = "text", out: str = "key",
             max_len: int = 120) -> DataFrame:
    """B-03: file-safe key. Variants: folded, basic, path (120), short (80), title (100)."""
    return df.withColumn(out, safe_key_expr(column, variant, max_len))


def token_set(df: DataFrame, min_len: int = 4, column: str = "text", out: str = "tokens") -> DataFrame:
    """B-04: distinct lower-case alphanumeric tokens of at least ``min_len`` characters."""
    return df.withColumn(out, tx.token_set(column, min_len))


def first_string(df: DataFrame, column: str, out: str = "value") -> DataFrame:
    """B-05: list column to its first element, scalar to string, null stays null.

    A string column holding JSON is read as VARIANT first; a JSON list gives its first element.
    """
    kind = df.schema[column].dataType.typeName()
    c = F.col(column)
    if kind == "array":
        value = F.get(c, F.lit(0)).cast("string")
    elif kind == "string":
        v = F.try_parse_json(c)
        value = F.when(F.schema_of_variant(v).startswith("ARRAY"),
                       F.coalesce(F.try_variant_get(v, "$[0]", "string"), c)).otherwise(c)
    else:
        value = c.cast("string")
    return df.withColumn(out, value)


def assemble_query_expr(plan: Column, context: Column, bullets: Column, requirements: Column) -> Column:
    """B-06: PLAN / CONTEXT / PRIMARY BULLETS / BULLET REQUIREMENTS, blank parts skipped.

    ``bullets`` is array<string>; ``requirements`` is array<struct<level,text>>.
    """
    bullet_lines = F.transform(F.filter(bullets, lambda b: tx.strip(b) != ""), lambda b: F.concat(F.lit("- "), b))
    req_lines = F.transform(
        F.filter(requirements, lambda r: tx.strip(r["text"]) != ""),
        lambda r: F.concat(F.lit("- ("), r["level"], F.lit(") "), r["text"]),
    )
    plan_block = F.concat_ws("\n", F.concat(F.lit("PLAN: "), plan),
                             F.when(context != "", F.concat(F.lit("CONTEXT: "), context)))
    bullet_block = F.when(F.size(bullet_lines) > 0,
                          F.concat_ws("\n", F.lit("PRIMARY BULLETS:"), F.array_join(bullet_lines, "\n")))
    req_block = F.when(F.size(req_lines) > 0,
                       F.concat_ws("\n", F.lit("BULLET REQUIREMENTS:"), F.array_join(req_lines, "\n")))
    return F.concat_ws("\n\n", plan_block, bullet_block, req_block)


def assemble_queries(df: DataFrame, plan: str = "plan", context: str = "context",
                     bullets: str = "bullets", requirements: str = "requirements") -> DataFrame:
    """B-06: add ``query`` built from the named columns."""
    return df.withColumn("query", assemble_query_expr(
        F.col(plan), F.col(context), F.col(bullets), F.col(requirements)))


def annotate(df: DataFrame, items: str, column: str = "text",
             mention: str = "(?i)Figure|Fig\\.", note: str = "This chunk appears to discuss the following figure(s): ") -> DataFrame:
    """B-07: append a note naming ``items`` when there are some and the text mentions none."""
    needed = (F.size(items) > 0) & ~F.col(column).rlike(mention)
    added = F.concat(F.col(column), F.lit("\n\n[NOTE: " + note), F.array_join(items, ", "), F.lit("]"))
    return df.withColumn(column, F.when(needed, added).otherwise(F.col(column)))


def annotate_decision(df: DataFrame, decision: str = "decision", column: str = "text") -> DataFrame:
    """B-07: append the supplement line unless the decision column says ``NO``."""
    added = F.concat(F.col(column), F.lit("\n[SupMat] Additional insight available — "),
                     tx.strip(decision), F.lit("\n"))
    return df.withColumn(column, F.when(tx.strip(decision) == "NO", F.col(column)).otherwise(added))


def _drop(df: DataFrame, column: str, drop: Callable[[Column], Column]) -> DataFrame:
    return df.withColumn(column, tx.keep_lines(column, lambda line: ~drop(line)))


def drop_lines(df: DataFrame, rules: Sequence[Callable[[Column], Column]], column: str = "text") -> DataFrame:
    """Several line rules in one pass over the text."""
    return _drop(df, column, lambda line: tx.any_of([rule(line) for rule in rules]))


def drop_axis_lines(df: DataFrame, column: str = "text") -> DataFrame:
    """B-10."""
    return _drop(df, column, is_axis_line)


def drop_equation_lines(df: DataFrame, column: str = "text") -> DataFrame:
    """B-11."""
    return _drop(df, column, is_equation_line)


def drop_metadata_lines(df: DataFrame, column: str = "text") -> DataFrame:
    """B-12."""
    return _drop(df, column, is_metadata_line)


def drop_author_lines(df: DataFrame, ratio: float = 0.60, column: str = "text") -> DataFrame:
    """B-13."""
    return _drop(df, column, lambda line: is_author_line(line, ratio))


def drop_running_lines(df: DataFrame, column: str = "text") -> DataFrame:
    """B-14: running heads and feet go, kept lines are trimmed, blank lines stay."""
    kept = F.filter(tx.lines(column), lambda line: (tx.strip(line) == "") | ~is_running_line(line))
    return df.withColumn(column, F.array_join(F.transform(kept, tx.strip), "\n"))


def drop_short_junk(df: DataFrame, column: str = "text") -> DataFrame:
    """B-15."""
    return _drop(df, column, is_short_junk)


def clean_sections(df: DataFrame, ratio: float = 0.60, column: str = "text") -> DataFrame:
    """B-16: composite cleaner.

    Consecutive caps lines are judged as one merged line and kept or dropped whole. A dropped
    run takes the line that ends it along, as the source behaviour does; that line is not
    judged again. Each other line passes the equation, metadata, author and junk rules.
    """

    def bad_line(line: Column) -> Column:
        return (
            is_equation_line(line)
            | is_metadata_line(line)
            | is_author_line(line, ratio)
            | is_short_junk(line)
        )

    def judge(run: Column) -> Column:
        caps = F.filter(run, is_caps_line)
        rest = F.filter(run, lambda line: ~is_caps_line(line) & ~bad_line(line))
        merged = F.array_join(F.transform(caps, tx.strip), " ")
        drop_run = tx.let(merged, lambda m: is_metadata_line(m) | is_author_line(m, ratio))
        nothing = F.array().cast("array<string>")
        return F.when(F.size(caps) == 0, rest).when(drop_run, nothing).otherwise(F.concat(caps, rest))

    flagged = F.transform(tx.lines(column), lambda line: F.struct(
        line.alias("line"), is_caps_line(line).alias("caps")))
    # A run is either one plain line, or caps lines plus the plain line that ends them.
    runs = tx.segments(flagged, lambda xs, i: ~F.get(xs, i - 1)["caps"])
    kept = F.flatten(F.transform(runs, lambda r: judge(F.transform(r["items"], lambda e: e["line"]))))
    return df.withColumn(column, tx.strip(F.array_join(kept, "\n")))


def clean_wiki_expr(c: Column | str) -> Column:
    t = tx.col(c)
    for pattern in (
        "(?i)\\[citation needed\\]",
        "\\[\\d+\\]",
        "\\{\\{[^}]{0,400}\\}\\}",
        "<[^>]+>",
        "\\$[^$]{0,200}\\$",
        "\\\\\\[[^\\\\\\]]{0,400}\\\\\\]",
    ):
        t = F.regexp_replace(t, pattern, "")
    paras = F.filter(
        F.transform(F.split(t, "\n\n"), tx.strip),
        lambda p: (F.length(p) >= 50)
        & (F.regexp_count(p, F.lit("[A-Za-z0-9]")) / F.length(p) >= 0.25),
    )
    return F.array_join(F.transform(paras, lambda p: F.regexp_replace(p, "\\s+", " ")), "\n\n")


def clean_wiki(df: DataFrame, column: str = "text") -> DataFrame:
    """B-17: markup stripped; paragraphs of 50+ characters with enough alphanumerics kept."""
    return df.withColumn(column, clean_wiki_expr(column))


def filter_notions(df: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """B-18: distinct notions per key; order by ``notion`` at read time."""

    def keep(n: Column) -> Column:
        low = F.lower(n)
        bad = tx.any_of([low.contains(t) for t in NOTION_STOP + NOTION_SPECIFIC])
        return (n != "") & (tx.word_count(n) <= 3) & ~bad

    stripped = F.transform(tx.lines(column), lambda line: tx.strip(F.btrim(line, F.lit("-•* "))))
    return df.select(key, F.explode(F.array_distinct(F.filter(stripped, keep))).alias("notion"))


def valid_sentences(df: DataFrame, min_words: int, column: str = "text") -> DataFrame:
    """B-19: rows whose text is a proper sentence."""
    return df.filter(tx.is_valid_sentence(F.col(column), min_words))


def is_header(df: DataFrame, column: str = "line", out: str = "is_header") -> DataFrame:
    """B-20."""
    return df.withColumn(out, is_header_line(F.col(column)))


def classify_results(df: DataFrame, column: str = "text", explicit: Sequence[str] = RESULT_TERMS,
                     regime: Sequence[str] = REGIME_TERMS, out: str = "is_results") -> DataFrame:
    """B-21: one explicit term, or two regime terms, contained in the lower-case text."""
    low = F.lower(column)
    hits = sum((low.contains(t).cast("int") for t in regime), F.lit(0))
    return df.withColumn(out, tx.any_of([low.contains(t) for t in explicit]) | (hits >= 2))


def first_conclusion(df: DataFrame, key: str, order: str, column: str = "text",
                     terms: Sequence[str] = CONCLUSION_TERMS) -> DataFrame:
    """B-22: first position whose text has a conclusion phrase, else -1."""
    low = F.lower(column)
    hit = tx.any_of([low.contains(t) for t in terms])
    return df.groupBy(key).agg(
        F.coalesce(F.min(F.when(hit, F.col(order))), F.lit(-1)).cast("long").alias("conclusion_at"))


def oversize_chunks(df: DataFrame, max_tokens: int, column: str = "text") -> DataFrame:
    """B-23: chunks longer than five characters per allowed token."""
    return df.filter(F.length(column) > max_tokens * 5).withColumn("n", F.length(column).cast("long"))


def filter_ids(df: DataFrame, kind: str, column: str = "raw", out: str = "ids", top: int | None = None) -> DataFrame:
    """B-24: lines shaped like an identifier (``arxiv``) or category, with ``top`` the first so many."""
    shape = {
        "arxiv": lambda x: x.rlike("\\d") & (F.length(x) > 5),
        "category": lambda x: x.contains(".") & x.rlike("\\p{L}"),
    }[kind]
    ids = F.filter(F.transform(F.split(F.col(column), "\n"), tx.strip), lambda x: (x != "") & shape(x))
    return df.withColumn(out, ids if top is None else F.slice(ids, 1, top))


def validate_specs(df: DataFrame, expected_uid: str = "expected_uid") -> DataFrame:
    """B-25: add ``reason``, null when the row passes; the first failing rule wins."""
    bullets = F.filter("on_slide_bullets", lambda b: tx.strip(b) != "")
    n = F.size(bullets)
    reason = (
        F.when(~F.col("slide_uid").eqNullSafe(F.col(expected_uid)), "slide_uid mismatch")
        .when(F.coalesce(tx.strip("title"), F.lit("")) == "", "missing title")
        .when(F.col("figure_used").isNotNull()
              & ~F.array_contains("suggested", F.col("figure_used")), "figure not suggested")
        .when(F.col("on_slide_bullets").isNull(), "bullets not a list")
        .when((n < 5) | (n > 7), "bullet count outside 5-7")
        .when(F.coalesce(tx.strip("transition"), F.lit("")) == "", "missing transition")
        .when(F.exists("reminders", lambda r: F.coalesce(tx.strip(r), F.lit("")) == ""), "empty reminder")
    )
    return df.withColumn("reason", reason)


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """B-25: passing rows and rejected rows with their reason."""
    return df.filter(F.col("reason").isNull()).drop("reason"), df.filter(F.col("reason").isNotNull())


def coerce_candidates(df: DataFrame) -> DataFrame:
    """B-26: blank ids dropped, priority defaulted and clamped, unknown exclusivity to medium."""
    priority = F.coalesce(F.expr("try_cast(priority AS double)"), F.lit(PRIORITY_DEFAULT))
    excl = F.lower(F.coalesce(F.col("exclusivity").cast("string"), F.lit("medium")))
    arg = tx.strip(F.coalesce(F.col("argument").cast("string"), F.lit("")))
    out = df.withColumn("bullet_id", tx.strip(F.col("bullet_id").cast("string")))
    out = out.withColumn("slide_uid", tx.strip(F.col("slide_uid").cast("string")))
    out = out.filter((F.col("bullet_id") != "") & (F.col("slide_uid") != ""))
    return (
        out.withColumn("priority", F.greatest(F.lit(PRIORITY_FLOOR), F.least(priority, F.lit(PRIORITY_CEIL))))
        .withColumn("exclusivity", F.when(excl.isin(EXCLUSIVITY), excl).otherwise("medium"))
        .withColumn("argument", F.when(arg == "", "MISSING_ARGUMENT").otherwise(arg))
    )
