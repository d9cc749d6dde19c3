"""Windows and sequence logic: order, primaries, usage, context, plan checks (F).

An argmax per key is an aggregate, not a window: it combines before the shuffle, so a key
with a third of all rows costs no more than any other. Windows are used only where rows
need neighbours, and then over a document.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as tx
from scriptorium.functions.neighbours import carried, numbered, previous
from scriptorium.session import cut, reuse, spread

# Weight of each exclusivity, usage ranks and cut-offs.
WEIGHTS = {"strong": 1.20, "medium": 1.00, "weak": 0.85}
LOW_CUTOFF, EARLY_BONUS = 0.55, 0.06


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def weight(excl: Column | str) -> Column:
    e = F.lower(tx.strip(tx.col(excl)))
    out = F.when(e == "strong", WEIGHTS["strong"]).when(e == "weak", WEIGHTS["weak"])
    return out.otherwise(WEIGHTS["medium"])


def slide_number(uid: Column | str) -> Column:
    """Number at the end of ``group::Slide_n``, 0 when there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(uid, "::Slide_(\\d+)$", 1), F.lit("")).try_cast("int"), F.lit(0))


def slide_order(slides: DataFrame, group_order: str = "group_index", slide_id: str = "slide_id") -> DataFrame:
    """F-01: 0-based global order: groups in order, slides by number inside a group.

    ``idx`` is the offset of the group plus the rank inside it. Offsets come from the table of
    group sizes, so no global sort of the slides is needed.
    """
    sizes = reuse(slides.groupBy(group_order).agg(F.count("*").alias("n")))
    offsets = running_total(sizes, group_order, "n", "before")
    w = Window.partitionBy(group_order).orderBy(slide_id, "slide_uid")
    ranked = slides.withColumn("__r", F.row_number().over(w) - 1)
    return ranked.join(offsets.select(group_order, "before"), group_order).select(
        *slides.columns, (F.col("before") + F.col("__r")).cast("long").alias("idx"))


def running_total(df: DataFrame, order: str, value: str, out: str, buckets: int = 1024) -> DataFrame:
    """Sum of ``value`` over all rows of smaller ``order``, without one global window.

    Rows are cut into ordered buckets; the bucket totals are few, so their running sum is a small
    window, and each bucket then sums on its own.
    """
    low, high = df.agg(F.min(order)).scalar(), df.agg(F.max(order)).scalar()
    b = df.withColumn("__b", F.floor((F.col(order) - low) * F.lit(buckets) / F.greatest(high - low + 1, F.lit(1))))
    totals = b.groupBy("__b").agg(F.sum(value).alias("s"))
    head = totals.withColumn("__base", F.coalesce(F.sum("s").over(
        Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("s")
    inner = F.coalesce(F.sum(value).over(
        Window.partitionBy("__b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return b.withColumn("__in", inner).join(F.broadcast(head), "__b").withColumn(
        out, F.col("__base") + F.col("__in")).drop("__b", "__in", "__base")


def _scored(cands: DataFrame, order: DataFrame, n_slides: DataFrame, early_bonus: float) -> DataFrame:
    """Candidates with ``idx`` (null when the slide is unknown) and ``score``.

    The slide list grows with the decks, so the join is left to adaptive execution, which
    broadcasts it only if its measured size allows and splits a hot slide otherwise.
    """
    c = cands.join(order.select("slide_uid", "idx"), "slide_uid", "left")
    n = n_slides.scalar()
    bonus = F.lit(early_bonus) * (1.0 - F.coalesce("idx", n) / F.greatest(F.lit(1), n - 1))
    return c.withColumn("score", F.col("priority") * weight("exclusivity") + bonus)


def primary_per_bullet(cands: DataFrame, order: DataFrame, early_bonus: float = EARLY_BONUS) -> DataFrame:
    """F-02: slide that introduces each bullet: best score, then priority, then the earlier slide.

    A slide missing from ``order`` counts as one past the end and may win, as in the source behaviour.
    """
    n = order.agg(F.greatest(F.lit(1), F.count("*")).alias("n_slides"))
    s = _scored(cands, order, n, early_bonus)
    rank = F.struct("score", "priority", -F.coalesce("idx", F.lit(10**9)), F.col("slide_uid"))
    return s.groupBy("bullet_id").agg(F.max_by(F.struct("slide_uid", "score"), rank).alias("m")).select(
        "bullet_id", F.col("m.slide_uid").alias("primary_slide_uid"), F.round("m.score", 6).alias("score"))


def classify_usage(cands: DataFrame, primary: DataFrame, order: DataFrame, low_cutoff: float = LOW_CUTOFF) -> DataFrame:
    """F-03: usage of every candidate on a known slide; read a slide's list by (usage_rank, -priority).

    Every candidate of a bullet on its primary slide is primary.
    """
    known = cands.join(order.select("slide_uid", "idx"), "slide_uid")
    j = known.join(primary.select("bullet_id", "primary_slide_uid"), "bullet_id")
    usage = F.when(F.col("slide_uid") == F.col("primary_slide_uid"), "primary").when(
        F.col("priority") < low_cutoff, "drop").otherwise("reminder")
    j = j.withColumn("usage", usage)
    return j.withColumn("usage_rank", F.when(F.col("usage") == "primary", 0).when(F.col("usage") == "reminder", 1).otherwise(2))


def unique_placement(cands: DataFrame, pos: str = "pos") -> DataFrame:
    """F-04: one placement per bullet, best priority times weight, the first on a tie."""
    s = cands.withColumn("score", F.coalesce("priority", F.lit(0.0)) * weight("exclusivity")).filter(F.col("score") > -1.0)
    row = F.struct("slide_uid", "score", "priority", "exclusivity")
    return s.groupBy("bullet_id").agg(F.max_by(row, F.struct("score", -F.col(pos))).alias("m")).select(
        "bullet_id", "m.slide_uid", F.round("m.score", 6).alias("score"), "m.priority", "m.exclusivity")


def effective_priority(usages: DataFrame, cands: DataFrame, slides: DataFrame) -> DataFrame:
    """F-05: priority of a bullet on a slide, raised by token overlap with the slide's text.

    ``usages``: slide_uid, bullet_id, bullet_text. ``cands``: slide_uid, bullet_id, priority.
    ``slides``: slide_uid, plan, slide_context. The 0.95 cap binds only when tokens overlap.
    """
    per_slide = cands.groupBy("slide_uid").agg(F.count("*").alias("n_cands"))
    top = cands.groupBy("slide_uid", "bullet_id").agg(F.max("priority").alias("top"))
    u = usages.join(per_slide, "slide_uid", "left").join(top, ["slide_uid", "bullet_id"], "left").join(slides, "slide_uid", "left")
    base = F.when(F.col("n_cands").isNull(), 0.70).otherwise(F.greatest(F.lit(0.65), F.coalesce("top", F.lit(0.65))))
    shared = F.size(F.array_intersect(tx.token_set("bullet_text"), tx.token_set(F.concat_ws(
        " ", F.coalesce("plan", F.lit("")), F.coalesce("slide_context", F.lit(""))))))
    u = u.withColumn("overlap", shared)
    raised = F.when(F.col("overlap") > 0, F.least(F.lit(0.95), base + F.least(F.lit(0.15), 0.03 * F.col("overlap")))).otherwise(base)
    return u.select("slide_uid", "bullet_id", "bullet_text", "overlap",
                    F.greatest(F.lit(0.0), F.least(F.lit(1.0), raised)).alias("priority"))


def requirement_level(df: DataFrame, must: float = 0.75, should: float = 0.55) -> DataFrame:
    """F-06: level and rank of each requirement; read by (level_rank, -priority). Blank bullets go."""
    p = F.col("priority")
    level = F.when(p >= must, "MUST").when(p >= should, "SHOULD").otherwise("OPTIONAL")
    out = df.filter(tx.strip("bullet_text") != "").withColumn("level", level)
    return out.withColumn("level_rank", F.when(F.col("level") == "MUST", 0).when(F.col("level") == "SHOULD", 1).otherwise(2)).withColumn(
        "priority", tx.round_half_up("priority", 3))


def fallback_requirements(cands: DataFrame, n: int = 4, must: float = 0.80, pos: str = "pos") -> DataFrame:
    """F-07: the ``n`` strongest candidates of a slide, MUST from ``must`` on.

    Spark limits each group before the shuffle, so a hot slide moves ``n`` rows per task.
    """
    w = Window.partitionBy("slide_uid").orderBy(F.desc(F.coalesce("priority", F.lit(0.0))), F.asc(pos))
    top = cands.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    p = F.coalesce("priority", F.lit(0.6))
    return top.withColumn("level", F.when(p >= must, "MUST").otherwise("SHOULD")).withColumn("priority", tx.round_half_up(p, 3))


def balanced_assignment(edges: DataFrame, key: str = "doc_id", paper: str = "bib_id", pos: str = "pos") -> DataFrame:
    """F-08: every paper goes to the candidate notion with the fewest papers so far, then the lower line.

    ``edges``: key, pos, paper, notion, line. Papers are taken in first-seen order. The running counts
    make this sequential inside an article; Spark sorts each article's papers (spilling if it
    must) and feeds them in batches, so memory holds only one counter per notion.
    """
    per_paper = edges.groupBy(key, paper).agg(
        F.min(pos).alias("seen"), F.array_sort(F.collect_set(F.struct("line", "notion"))).alias("o"))
    per_paper = per_paper.select(key, paper, "seen", F.col("o.line").alias("lines"), F.col("o.notion").alias("notions"))
    ordered = spread(per_paper, key).sortWithinPartitions(key, "seen", paper)
    fields = {f.name: f.dataType.simpleString() for f in per_paper.schema}

    def assign(batches):
        doc, load = object(), {}
        for pdf in batches:
            picked = []
            for k, ls, ns in zip(pdf[key], pdf["lines"], pdf["notions"]):
                if k != doc:
                    doc, load = k, {}
                # Options come sorted by line, so the first of the least loaded has the lowest line.
                n, line = min(zip(ns, ls), key=lambda o: load.get(o[0], 0))
                load[n] = load.get(n, 0) + 1
                picked.append((n, line))
            yield pd.DataFrame({key: pdf[key], paper: pdf[paper], "notion": [n for n, _ in picked], "line": [x for _, x in picked]})

    return ordered.mapInPandas(assign, f"{key} {fields[key]}, {paper} {fields[paper]}, notion string, line int")


def neighbour_context(df: DataFrame, n: int = 2, column: str = "text", parts: Column | None = None) -> DataFrame:
    """F-09: each sentence of a text with its ``n`` neighbours on both sides, joined by a bar.

    Neighbours come from the same text, so this is a slice inside the row rather than a window.
    """
    ss = parts if parts is not None else F.filter(F.transform(tx.split_sentences(column), tx.strip), lambda s: s != "")
    ctx = tx.let(ss, lambda xs: F.transform(xs, lambda x, i: F.struct(i.alias("sent_no"), F.array_join(F.slice(
        xs, F.greatest(i - n, F.lit(0)) + 1, F.least(i, F.lit(n)) + 1 + n), " | ").alias("context"))))
    return df.select(*[c for c in df.columns if c != column], F.inline(ctx))


def formula_context(anchored: DataFrame, sentences: DataFrame, n: int = 2, key: str = "doc_id") -> DataFrame:
    """F-10: sentences up to ``n`` away from the one a formula follows, with relative offsets.

    The offsets are generated per formula, so the lookup is an equi-join on (key, num).
    """
    wanted = anchored.select(key, "formula_no", F.col("num").alias("anchor_num"), F.explode(F.filter(
        F.sequence(F.lit(-n), F.lit(n)), lambda o: o != 0)).alias("offset")).withColumn("num", F.col("anchor_num") + F.col("offset"))
    return wanted.join(sentences.select(key, "num", "text"), [key, "num"]).select(key, "formula_no", "offset", "text")


def interleave(sentences: DataFrame, formulas: DataFrame, key: str = "doc_id") -> DataFrame:
    """F-11: formulas placed after their sentence (``num``) and the stream renumbered from 1.

    New number = old rank of the sentence plus the formulas before it; a document with very many sentences is ranked in parts.
    """
    label = F.coalesce("label", F.lit(""))
    text = tx.squash(F.concat(F.when(label != "", F.concat(F.lit("Formula "), label, F.lit(": "))).otherwise("Formula: "), F.col("formula_text")))
    f = formulas.select(key, "num", F.lit(1).alias("kind"), F.col("formula_no").cast("long").alias("seq"),
                        F.concat(F.lit("FORMULA;"), F.col("xml_id")).alias("meta"), text.alias("text"))
    s = sentences.select(key, "num", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("seq"), "meta", "text")
    return numbered(s.unionByName(f), [key], "num", ["kind", "seq"], "new_num").select(key, "new_num", "kind", "meta", "text")


def carry_previous(df: DataFrame, key: str, order: str, n: int | None = None, column: str = "text") -> DataFrame:
    """F-12: ``previous`` item of the key, or its last ``n`` characters."""
    value = F.col(column) if n is None else F.right(column, F.lit(n))
    return previous(df, [key], order, {"previous": value})


def suppress_false_splits(matches: DataFrame, cut: float = 0.75, key: str | Sequence[str] = "pair_id", pos: str = "num") -> DataFrame:
    """F-13: drop a rejected row when a row at most two positions away holds the same right row strongly.

    ``pos`` numbers the rows of a key without gaps, so neighbourhood is a condition on an equi-join
    over (key, right_num) and no window is needed.
    """
    ks = _keys(key)
    strong = matches.filter((F.col("status") == "match") & (F.col("score") >= cut)).select(
        *[F.col(k).alias(f"__{k}") for k in ks], F.col("right_num").alias("__r"), F.col(pos).alias("__p"))
    near = (F.col("right_num") == F.col("__r")) & (F.col("status") == "rejected") & (F.abs(F.col(pos) - F.col("__p")) <= 2)
    for k in ks:
        near = near & (F.col(k) == F.col(f"__{k}"))
    return matches.join(strong, near, "left_anti")


def reorder_instructions(matches: DataFrame, majority: DataFrame | None = None, key: str = "pair_id", jump: int = 10) -> DataFrame:
    """F-14: edit operations that bring the right-hand order to the left-hand order.

    ``matches``: key, num, block (figure label, null for main text), partner_num and partner_fig (null
    when the row has no match), false splits already removed. ``majority``: key, block, majority. Rows that are in
    place give no operation. Each row leaves itself as the anchor of the next one of its block, so the state is
    the previous row alone. Apply figure blocks first, in order of their first row.
    """
    m = matches.withColumn("block", F.coalesce("block", F.lit("")))
    if majority is not None:
        major = majority.select(key, F.coalesce("block", F.lit("")).alias("block"), "majority")
        m = m.join(major, [key, "block"], "left")
    else:
        m = m.withColumn("majority", F.lit(None).cast("string"))
    m = previous(m, [key, "block"], "num", {"prev_num": F.col("num"), "prev_partner": F.col("partner_num")})
    main, first = F.col("block") == "", F.col("prev_num").isNull()
    partner, matched = F.col("partner_num"), F.col("partner_num").isNotNull()
    foreign = matched & ~main & ~F.coalesce(F.col("partner_fig") == F.col("majority"), F.lit(False))
    after_left = ~first & F.col("prev_partner").isNull()
    back = (partner <= F.col("prev_partner")) & (~main | (partner > F.col("prev_partner") - jump))
    op = (
        F.when(~matched, "insert").when(foreign, F.when(first, "place").otherwise("move"))
        .when(after_left, "place").when(~first & back, "move"))
    after_type = F.when(first, F.when(main, "end").otherwise("fig_begin")).when(after_left, "left").otherwise("right")
    return m.select(
        key, F.nullif("block", F.lit("")).alias("block"), "num", op.alias("op"),
        F.when(matched, "right").otherwise("left").alias("what"), F.coalesce(partner, F.col("num")).cast("long").alias("id"),
        after_type.alias("after_type"), F.when(~first, F.coalesce("prev_partner", "prev_num")).cast("long").alias("after_id"),
        F.when(foreign & F.col("partner_fig").isNotNull(), "wrong figure").alias("label"),
    ).filter(F.col("op").isNotNull())


def parse_instructions(df: DataFrame, column: str = "line") -> DataFrame:
    """F-15: instruction text to op, what, id, after_type, after_id; other lines give no row.

    Text form: ``INSERT LEFT 3 AFTER RIGHT 2``, ``PLACE RIGHT 5 … AT BEGINNING OF FIGURE``,
    ``… AT END OF DOCUMENT``. A ``#`` starts a comment.
    """
    s = tx.strip(F.get(F.split(column, "#", 2), F.lit(0)))
    head = "(?i)^(INSERT|PLACE|MOVE)\\s+(LEFT|RIGHT)\\s*(\\d+)"
    tail = "(?i)(?:AFTER|FOLLOWING)\\s+(LEFT|RIGHT)\\s*(\\d+)"
    kind = F.when(s.rlike(tail), F.lower(F.regexp_extract(s, tail, 1))).when(
        s.rlike("(?i)AT\\s+BEGINNING\\s+OF\\s+FIGURE"), "fig_begin").when(s.rlike("(?i)AT\\s+END\\s+OF\\s+DOCUMENT"), "end")
    out = df.select(*[c for c in df.columns if c != column], F.lower(F.regexp_extract(s, head, 1)).alias("op"),
                    F.lower(F.regexp_extract(s, head, 2)).alias("what"),
                    F.nullif(F.regexp_extract(s, head, 3), F.lit("")).try_cast("long").alias("id"), kind.alias("after_type"),
                    F.nullif(F.regexp_extract(s, tail, 2), F.lit("")).try_cast("long").alias("after_id"))
    return out.filter((F.col("op") != "") & F.col("after_type").isNotNull())


def apply_instructions(right: DataFrame, left: DataFrame, ops: DataFrame, key: str = "pair_id") -> DataFrame:
    """F-15: right-hand sentence table after the operations, which take effect in order of ``op_no``.

    ``right``: key, num, block (null = main), text. ``left``: key, num, text. ``ops``: key, op_no, block, op,
    what, id, after_type, after_id; ``num`` and ``op_no`` are unique in a key. Figure operations append to their figure; main operations put
    the sentence after its anchor, or at the end when the anchor is unknown.
    Output: key, block, pos (1-based in the block), source, num, text.

    The operations are not replayed one by one. Each row and each operation is an occurrence of a sentence, and an occurrence never
    moves: it hangs below the anchor's latest earlier occurrence, before what was put there earlier, or at the end of a
    block. The final order is that of these trees; only the last occurrence of a sentence is seen. Trees become lists by
    joins, and pointer jumping ranks a list of n occurrences in log n rounds, so one document may be spread over all tasks.
    """
    main, text = F.lit(None).cast("string"), F.coalesce("text", F.concat(F.lit("[MISSING "), F.upper("what"), F.lit(" "), F.col("id").cast("string"), F.lit("]")))
    source = right.select(key, F.lit("right").alias("what"), F.col("num").alias("id"), "text").unionByName(
        left.select(key, F.lit("left").alias("what"), F.col("num").alias("id"), "text"))
    # ``o`` names an occurrence: even for rows, odd for operations; ``at`` orders the ends of blocks
    rows = right.select(key, (F.col("num") * 2).cast("long").alias("o"), F.lit(-(1 << 62)).alias("t"), F.col("num").cast("long").alias("at"),
                        "block", F.lit("right").alias("what"), F.col("num").cast("long").alias("id"), main.alias("a_what"), F.lit(None).cast("long").alias("a_id"), "text")
    anchored = F.col("block").isNull() & F.col("after_type").isin("left", "right") & F.col("after_id").isNotNull() & ~(
        (F.col("after_type") == F.col("what")) & (F.col("after_id") == F.col("id")))
    steps = ops.join(source, [key, "what", "id"], "left").select(
        key, (F.col("op_no") * 2 + 1).cast("long").alias("o"), F.col("op_no").cast("long").alias("t"), (F.col("op_no") + F.lit(1 << 60)).cast("long").alias("at"), "block", "what",
        F.col("id").cast("long").alias("id"), F.when(anchored, F.col("after_type")).alias("a_what"), F.when(anchored, F.col("after_id")).cast("long").alias("a_id"), text.alias("text"))
    occ = cut(rows.unionByName(steps))
    asked = occ.filter(F.col("a_what").isNotNull()).select(key, F.col("a_what").alias("what"), F.col("a_id").alias("id"), "t", F.lit(None).cast("long").alias("seen"), F.col("o").alias("asker"))
    events = occ.select(key, "what", "id", "t", F.col("o").alias("seen"), F.lit(None).cast("long").alias("asker")).unionByName(asked)
    parents = carried(events, [key, "what", "id"], "t", {"parent": F.col("seen")}).filter(F.col("asker").isNotNull() & F.col("parent").isNotNull())
    below = cut(parents.select(key, F.col("asker").alias("o"), "parent", "t"))
    places = _tree_places(below, key)
    last = occ.groupBy(key, "what", "id").agg(F.max_by("o", "t").alias("o"))
    seen = occ.join(last.select(key, "o"), [key, "o"], "left_semi").join(places, [key, "o"], "left")
    root = occ.select(key, F.col("o").alias("root"), "block", "at")
    out = seen.drop("block", "at").withColumn("root", F.coalesce("root", "o")).join(root, [key, "root"])
    out = out.withColumn("rank", F.coalesce("rank", F.lit(0).cast("long"))).withColumn("home", F.coalesce(F.concat(F.lit("block "), "block"), F.lit("main")))
    return numbered(out, [key, "home"], "at", ["rank"], "pos").select(key, "block", "pos", F.col("what").alias("source"), F.col("id").alias("num"), "text")


def _tree_places(below: DataFrame, key: str) -> DataFrame:
    """Preorder places in trees of ``(key, o, parent, t)``, later children first: ``(key, o, root, rank)``, the root's rank being 0."""
    younger = previous(below, [key, "parent"], "t", {"next": F.col("o")})  # the child put there before stands behind
    first = below.groupBy(key, F.col("parent").alias("o")).agg(F.max_by("o", "t").alias("first"))
    # behind a subtree comes the next child of the nearest ancestor that has one
    ends = cut(younger.select(key, "o", F.col("next").alias("to"), F.when(F.col("next").isNull(), F.col("parent")).alias("via")))
    while not (open_ := ends.filter("to is null and via is not null")).isEmpty():
        up = ends.select(key, F.col("o").alias("via"), F.col("to").alias("to2"), F.col("via").alias("via2"))
        moved = open_.join(up, [key, "via"], "left").select(key, "o", F.col("to2").alias("to"), F.when(F.col("to2").isNull(), F.col("via2")).alias("via"))
        ends = cut(ends.filter("to is not null or via is null").unionByName(moved))
    nodes = below.select(key, "o").unionByName(first.select(key, "o")).distinct()
    links = nodes.join(first, [key, "o"], "left").join(ends.select(key, "o", "to"), [key, "o"], "left")
    # list ranking: how many occurrences follow, and which is the last
    lists = cut(links.select(key, "o", F.coalesce("first", "to").alias("next"), F.when(F.coalesce("first", "to").isNull(), 0).otherwise(1).cast("long").alias("left"),
                             F.coalesce("first", "to", "o").alias("end")))
    while not (open_ := lists.filter("next is not null")).isEmpty():
        on = lists.select(key, F.col("o").alias("next"), F.col("next").alias("next2"), F.col("left").alias("left2"), F.col("end").alias("end2"))
        moved = open_.join(on, [key, "next"]).select(key, "o", F.col("next2").alias("next"), (F.col("left") + F.col("left2")).alias("left"), F.col("end2").alias("end"))
        lists = cut(lists.filter("next is null").unionByName(moved))
    roots = lists.join(below.select(key, "o"), [key, "o"], "left_anti").select(key, "end", F.col("o").alias("root"), F.col("left").alias("all"))
    return lists.join(roots, [key, "end"]).select(key, "o", "root", (F.col("all") - F.col("left")).alias("rank"))


def check_ranges(plans: DataFrame, key: str = "doc_id") -> DataFrame:
    """F-16: groups whose slide range does not start right after the previous one."""
    ranged = plans.filter(F.col("slide_from").isNotNull()).select(key, "header", "slide_from", "slide_to")
    want = F.coalesce("__before", F.lit(0)) + 1
    return previous(ranged, [key], "slide_from", {"__before": F.col("slide_to")}).withColumn("want", want).filter(F.col("slide_from") != F.col("want")).select(
        key, "header", F.lit("range").alias("kind"), F.concat(F.lit("expected start "), F.col("want").cast("string")).alias("detail"))


def check_plan(plans: DataFrame, details: DataFrame, key: str = "doc_id") -> DataFrame:
    """F-16: all warnings of a plan: ranges, reused figures, transitions, slide counts and focus lengths.

    ``plans`` and ``details`` are parsed group blocks (``parse_plan_blocks``).
    """
    tr = tx.strip(F.coalesce("key_transitions", F.lit("")))
    weak = plans.withColumn("__d", F.when((tr == "") | F.lower(tr).isin("none", "n/a", "no transition"), "weak or missing").when(
        tx.word_count(tr) < 6, "very short")).filter(F.col("__d").isNotNull()).select(
        key, "header", F.lit("transition").alias("kind"), F.col("__d").alias("detail"))
    ranged = details.filter(F.col("slide_from").isNotNull())
    declared, found = F.col("slide_to") - F.col("slide_from") + 1, F.size("slides")
    count = ranged.filter(declared != found).select(key, "header", F.lit("count").alias("kind"), F.concat(
        F.lit("declared "), declared.cast("string"), F.lit(", found "), found.cast("string")).alias("detail"))
    focus = ranged.select(key, "header", F.explode("slides").alias("s")).withColumn("n", tx.word_count("s.plan")).filter(
        (F.col("n") < 6) | (F.col("n") > 22)).select(key, "header", F.lit("focus").alias("kind"), F.concat(
            F.lit("slide "), F.col("s.slide_id").cast("string"), F.lit(": "), F.col("n").cast("string"), F.lit(" words")).alias("detail"))
    figs = details.select(key, F.explode("available_figures").alias("f")).withColumn(
        "fig", F.regexp_extract("f", "^Figure\\s*([0-9A-Za-z_]+)", 1)).filter(F.col("fig") != "").groupBy(key, "fig").agg(
        F.count("*").alias("n")).filter(F.col("n") > 1).select(
        key, F.lit(None).cast("string").alias("header"), F.lit("figure").alias("kind"),
        F.concat(F.lit("reused "), F.col("fig")).alias("detail"))
    out = check_ranges(plans, key)
    for part in (weak, count, focus, figs):
        out = out.unionByName(part)
    return out


def head_words(c: Column | str, n: int | None = None) -> Column:
    return F.array_join(tx.words(c) if n is None else F.slice(tx.words(c), 1, n), " ")


def cumulative_coverage(items: DataFrame, key: str, group: str, kind: str = "kind", item: str = "item", n_words: int | None = None) -> DataFrame:
    """F-17: group that covers each item first; an item is covered before every later group.

    ``covered_before`` of group g is the set of rows with ``first_group < g``; the set itself is never
    repeated per group, so the result stays as large as the number of distinct items.
    """
    norm = F.when(F.col(kind) == "concept", head_words(item, n_words)).otherwise(tx.strip(item))
    return items.withColumn("__i", norm).filter(F.col("__i") != "").groupBy(key, kind, F.col("__i").alias("item")).agg(
        F.min(group).alias("first_group"), F.count("*").alias("n_mentions"))


def harvest_new_lines(lines: DataFrame, key: str, order: Sequence[str], column: str = "line") -> DataFrame:
    """F-18: each line once, where it first occurs in the key."""
    return lines.groupBy(key, column).agg(F.min(F.struct(*order)).alias("__f")).select(key, column, F.col("__f.*"))


def merge_continuous(sections: DataFrame, key: str, order: str, decision: str = "decision", column: str = "text") -> DataFrame:
    """F-19: consecutive sections joined while ``decision`` says ``yes``; the decision is an input.

    A section belongs to the latest one that was not continued; ``start_at`` is where a merged text begins.
    """
    opens = F.coalesce(F.lower(tx.strip(decision)), F.lit("no")) != "yes"
    runs = carried(sections, [key], order, {"__run": F.when(opens, F.col(order))})
    return runs.groupBy(key, "__run").agg(F.array_sort(F.collect_list(F.struct(order, column))).alias("i")).select(
        key, F.get("i", F.lit(0))[order].alias("start_at"), F.size("i").alias("n_sections"),
        F.array_join(F.transform("i", lambda x: x[column]), "\n").alias(column))


def leftover_figures(available: DataFrame, used: DataFrame, slides: DataFrame, group: str = "group_id") -> DataFrame:
    """F-20: a slide row for each available figure of a group that no slide uses.

    ``available``: group, fig_no, figure. The new uid extends the group's last slide by number.
    """
    left = available.join(used.select(group, "figure"), [group, "figure"], "left_anti")
    base = slides.groupBy(group).agg(F.max_by("slide_uid", slide_number("slide_uid")).alias("base_uid"))
    n = F.row_number().over(Window.partitionBy(group).orderBy("fig_no"))
    return left.join(base, group).withColumn("n", n).select(
        group, "figure", F.concat(F.col("base_uid"), F.lit("::Figure_"), F.col("n").cast("string")).alias("slide_uid"))


def match_strength(matches: DataFrame) -> DataFrame:
    """F-21: STRONG from 0.75, WEAK from 0.4, else VERY WEAK; unmatched rows have none."""
    s = F.col("score")
    return matches.withColumn("strength", F.when(F.col("status") == "match", F.when(s >= 0.75, "STRONG").when(
        s >= 0.4, "WEAK").otherwise("VERY WEAK")))
