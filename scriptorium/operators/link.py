"""Joins: fuzzy, range, containment and lookup (D).

A comparison of every left row with every right row of a key is never emitted as pairs.
Both sides are cut into blocks of about ``BLOCK`` rows by a hash of the position, so the spacing of
positions does not matter; one row per pair of blocks goes to a scorer that returns only results, and an
aggregation merges blocks. Rows are dealt straight to those pairs, so a key that holds a third of the data
becomes many equal tasks before pairs exist, and results stay exact.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import similarity as sim
from scriptorium.functions import text as tx
from scriptorium.session import BROADCAST_ROWS, broadcast_if_small, compute_partitions, fits, reuse, spread

#: Rows of a block; a block of short texts may hold ``WIDE`` times as many rows and ``CHARS`` characters.
BLOCK, WIDE, CHARS = 256, 8, 1 << 16


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def blocks(df: DataFrame, key: Sequence[str], pos: str, fields: Sequence[str], name: str, size: int = BLOCK) -> DataFrame:
    """Rows of a key to arrays of about ``size`` rows in no order; ``pos`` numbers the rows of a key, with gaps or without."""
    item = F.struct(F.col(pos).cast("long").alias("pos"), *fields)
    dealt = df.join(_block_counts(df, key, size), list(key)).withColumn("__b", F.pmod(F.xxhash64(pos), F.col("__n")))
    return dealt.groupBy(*key, F.col("__b").alias(f"{name}_block")).agg(F.collect_list(item).alias(f"{name}_items"))


def _block_counts(df: DataFrame, key: Sequence[str], size: int) -> DataFrame:
    return df.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / size).alias("__n"))


def block_pairs(left: DataFrame, right: DataFrame, key: Sequence[str], lpos: str, rpos: str,
                lfields: Sequence[str], rfields: Sequence[str], size: int = BLOCK, chars: int | None = None) -> DataFrame:
    """Cells ``(key, l_items, r_items)`` in which every left row of a key meets every right row of it once.

    A key with few rows is one cell. One with many is cut into blocks on both sides, and a row goes to the cells of all blocks of the other
    side, so a hot key becomes many tasks of bounded size. Rows are dealt straight to their cells: the texts are shuffled once.
    With ``chars`` a block may hold more than ``size`` rows, up to ``WIDE`` times as many, as long as its first fields have about so many characters.
    The counts are never broadcast: there may be as many keys as rows.
    """
    ks = list(key)
    side = lambda df, l, r, f: df.select(*ks, F.lit(l).alias("__l"), F.lit(r).alias("__r"), (F.coalesce(F.length(f), F.lit(0)) if chars else F.lit(0)).cast("long").alias("__c"))

    def parts(n: str) -> Column:
        narrow = F.ceil(F.sum(n) / size)
        return narrow if chars is None else F.least(narrow, F.greatest(F.ceil(F.sum(n) / (WIDE * size)), F.ceil(F.sum(F.col(n) * F.col("__c")) / chars)))

    counts = side(left, 1, 0, lfields[0]).unionByName(side(right, 0, 1, rfields[0])).groupBy(*ks).agg(
        parts("__l").alias("__nl"), parts("__r").alias("__nr")).filter("__nl > 0 and __nr > 0").hint("merge")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda pos, n: F.pmod(F.xxhash64(pos), F.col(n))
    lrows = left.select(*ks, F.col(lpos).alias("__p"), F.struct(F.col(lpos).cast("long").alias("pos"), *lfields).alias("__item")).join(counts, ks)
    rrows = right.select(*ks, F.col(rpos).alias("__p"), F.struct(F.col(rpos).cast("long").alias("pos"), *rfields).alias("__item")).join(counts, ks)
    lrows = lrows.select(*ks, own("__p", "__nl").alias("l_block"), every("__nr").alias("r_block"), F.col("__item").alias("__l"))
    rrows = rrows.select(*ks, every("__nl").alias("l_block"), own("__p", "__nr").alias("r_block"), F.col("__item").alias("__r"))
    dealt = spread(lrows.unionByName(rrows, allowMissingColumns=True), *ks, "l_block", "r_block")
    cells = dealt.groupBy(*ks, "l_block", "r_block").agg(F.collect_list("__l").alias("l_items"), F.collect_list("__r").alias("r_items"))
    return cells.filter((F.size("l_items") > 0) & (F.size("r_items") > 0))


MATCH = "array<struct<text:string,r:long,score:double>>"


def _best_in_blocks(min_score: float):
    @F.pandas_udf(MATCH)
    def score(ltexts: pd.Series, rnums: pd.Series, rtexts: pd.Series) -> pd.Series:
        out = []
        for ltext, rnum, rtext in zip(ltexts, rnums, rtexts):
            rights = sorted(zip(rnum.tolist(), rtext), key=lambda x: x[0])
            block = sim.RatioBlock([text.lower() for _, text in rights])
            found = [(text, block.best(text.lower(), min_score)) for text in ltext]
            out.append([{"text": text, "r": rights[m[0]][0], "score": m[1]} for text, m in found if m])
        return pd.Series(out)

    return score


def best_match(left: DataFrame, right: DataFrame, key: str | Sequence[str], min_score: float = 0.25,
               size: int = BLOCK) -> DataFrame:
    """D-01: most similar right row for each left row (``num``, ``text``), ties to the first.

    Equal texts of a key are scored once and the result goes to all of them. Output: key, num, right_num, score rounded to 4 places;
    rows under the threshold are absent.
    """
    ks = _keys(key)
    best = lambda by: F.max_by(F.struct("r", "score"), F.struct("score", -F.col("r"))).alias(by)
    lrows = left.select(*ks, "num", F.coalesce("text", F.lit("")).alias("text"))
    ltexts = lrows.select(*ks, "text").distinct().withColumn("__at", F.xxhash64("text"))
    rtexts = right.select(*ks, "num", F.coalesce("text", F.lit("")).alias("text")).groupBy(*ks, "text").agg(F.min("num").alias("num"))
    pairs = block_pairs(ltexts, rtexts, ks, "__at", "num", ["text"], ["text"], size, CHARS)
    hits = pairs.select(*ks, F.inline(_best_in_blocks(min_score)("l_items.text", "r_items.pos", "r_items.text")))
    hits = hits.groupBy(*ks, "text").agg(best("m")).select(*ks, "text", "m.*")
    out = lrows.join(hits.hint("merge"), [*ks, "text"]).groupBy(*ks, "num").agg(best("m"))
    return out.select(*ks, "num", F.col("m.r").alias("right_num"), tx.round_half_up("m.score", 4).alias("score"))


def resolve_claims(left: DataFrame, matches: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """D-02: each right row keeps its best claimant (then the lower ``num``).

    Status: ``match``, ``rejected`` (lost the claim; score 0) or ``not_found``.
    """
    ks = _keys(key)
    winners = matches.groupBy(*ks, "right_num").agg(
        F.min_by("num", F.struct(-F.col("score"), F.col("num"))).alias("winner"))
    judged = matches.join(winners, [*ks, "right_num"]).withColumn("won", F.col("num") == F.col("winner"))
    out = left.select(*ks, "num").join(judged, [*ks, "num"], "left")
    return out.select(
        *ks, "num", "right_num",
        F.when(F.col("won"), F.col("score")).otherwise(0.0).alias("score"),
        F.when(F.col("right_num").isNull(), "not_found").when(F.col("won"), "match").otherwise("rejected").alias("status"))


def _text_counts(left: DataFrame, right: DataFrame, tk: list[str]) -> DataFrame:
    """How often a text occurs on the left (``lc``) and on the right (``rc``), where that differs; computed once for both sides."""
    side = lambda df, l, r: df.select(*tk, F.lit(l).alias("__l"), F.lit(r).alias("__r"))
    counts = side(left, 1, 0).unionByName(side(right, 0, 1)).groupBy(*tk).agg(F.sum("__l").alias("lc"), F.sum("__r").alias("rc"))
    return reuse(counts.filter(F.col("lc") != F.col("rc")))


def _surplus(df: DataFrame, counts: DataFrame, tk: list[str], own: str, other: str) -> DataFrame:
    """Rows beyond the number of equal rows on the other side, the later occurrences."""
    from pyspark.sql import Window

    # never broadcast: the counts are as many as the texts, and equal ones compress far below their size in memory
    rows = reuse(df.join(counts.filter(F.col(own) > F.col(other)).hint("merge"), tk))
    none = rows.filter(F.col(other) == 0)
    # Ranks are needed only where both sides have copies and this one has more of them.
    some = rows.filter(F.col(other) > 0).withColumn(
        "occ", F.row_number().over(Window.partitionBy(*tk).orderBy("num"))).filter(F.col("occ") > F.col(other))
    return none.select(df.columns).unionByName(some.select(df.columns))


def sequence_diff(left: DataFrame, right: DataFrame, key: str | Sequence[str], cut: float = 0.7,
                  min_chars: int = 15, size: int = BLOCK) -> DataFrame:
    """D-03: left sentences without an equal on the right.

    ``missing`` if no surplus right sentence is more similar than ``cut``; otherwise the first
    such sentence by position, reported as ``possible_misplaced`` when at least ``min_chars``
    characters changed and not reported when fewer did.
    """
    ks = _keys(key)
    tk = [*ks, "text"]
    counts = _text_counts(left, right, tk)
    lost, extra = _surplus(left, counts, tk, "lc", "rc"), _surplus(right, counts, tk, "rc", "lc")

    @F.pandas_udf("array<struct<num:long,right_num:long,right_text:string,score:double,char_diff:int>>")
    def first_near(lnums: pd.Series, ltexts: pd.Series, rnums: pd.Series, rtexts: pd.Series) -> pd.Series:
        out = []
        for lnum, ltext, rnum, rtext in zip(lnums, ltexts, rnums, rtexts):
            rs = sorted(zip(rnum.tolist(), rtext), key=lambda x: x[0])
            block = sim.RatioBlock([(text or "").lower() for _, text in rs])
            found = []
            for num, text in zip(lnum.tolist(), ltext):
                m = block.first_over((text or "").lower(), cut)
                if m:
                    right_num, right_text = rs[m[0]]
                    found.append({"num": num, "right_num": right_num, "right_text": right_text, "score": round(m[1], 6),
                                  "char_diff": sim.py_changed_chars(text, right_text)})
            out.append(found)
        return pd.Series(out)

    pairs = block_pairs(lost, extra, ks, "num", "num", ["text"], ["text"], size)
    near = pairs.select(*ks, F.inline(first_near("l_items.pos", "l_items.text", "r_items.pos", "r_items.text"))).groupBy(*ks, "num").agg(
        F.min_by(F.struct("right_num", "right_text", "score", "char_diff"), "right_num").alias("m"))
    out = lost.join(near.hint("merge"), [*ks, "num"], "left").select(*ks, "num", "text", "m.*")
    kind = F.when(F.col("right_num").isNull(), "missing").when(F.col("char_diff") >= min_chars, "possible_misplaced")
    return out.withColumn("kind", kind).filter(F.col("kind").isNotNull())


def _breaks(n: int, threshold: float) -> int:
    """Most breaks between ``n`` characters and a window no longer than ``n`` within the threshold.

    Ratio t leaves at most (1-t)(n+window) <= 2(1-t)n unmatched characters on both sides.
    """
    return int(2 * (100.0 - threshold) / 100.0 * n + 1e-9)


def _pieces(s: str, threshold: float) -> list[tuple[int, str]]:
    """(offset, piece) of ``s``; with one piece more than breaks, any window within the threshold
    holds a whole piece, shifted by no more than the breaks."""
    n = min(_breaks(len(s), threshold) + 1, len(s))
    cuts = [len(s) * i // n for i in range(n + 1)]
    return [(a, s[a:b]) for a, b in zip(cuts, cuts[1:])]


def _finder(places: dict):
    """Function that lists (end, (length, places)) of every known piece in a text."""
    try:
        import ahocorasick
    except ImportError:

        def scan(s):
            for p, where in places.items():
                at = s.find(p)
                while at >= 0:
                    yield at + len(p) - 1, (len(p), where)
                    at = s.find(p, at + 1)

        return scan
    auto = ahocorasick.Automaton()
    for p, where in places.items():
        auto.add_word(p, (len(p), where))
    auto.make_automaton()
    return auto.iter


class _NotionIndex:
    """Notions indexed by pieces and tokens; every notion it skips is provably under the threshold."""

    def __init__(self, items, threshold: float):
        self.items, self.threshold = items, threshold
        self.by_token: dict[str, list[int]] = {}
        self.by_length: dict[int, list[int]] = {}
        by_piece: dict[str, list[tuple[int, int]]] = {}
        by_sorted: dict[str, list[int]] = {}
        for i, x in enumerate(items):
            self.by_length.setdefault(len(x["norm"]), []).append(i)
            for at, p in _pieces(x["norm"], threshold):
                by_piece.setdefault(p, []).append((i, at))
            tokens = sorted(set(x["norm"].split()))
            for t in tokens:
                self.by_token.setdefault(t, []).append(i)
            for _, p in _pieces(" ".join(tokens), threshold - 2):
                by_sorted.setdefault(p, []).append(i)
        self.widths = [len(" ".join(sorted(set(x["norm"].split())))) for x in items]
        self.probe = [sim.WindowProbe(x["norm"], threshold, _breaks(len(x["norm"]), threshold)) for x in items]
        self.scan, self.scan_sorted = _finder(by_piece), _finder(by_sorted)

    def links(self, s: str) -> list[int]:
        found: set[int] = set()
        for end, (size, places) in self.scan(s):
            start = end - size + 1
            for i, at in places:
                if i not in found and self.probe[i].size <= len(s) and self.probe[i].near(s, start - at):
                    found.add(i)
        # A notion longer than the sentence swaps roles, so its pieces prove nothing.
        for n, ids in self.by_length.items():
            if n > len(s):
                found.update(i for i in ids if i not in found and sim.py_partial_ratio(self.items[i]["norm"], s) >= self.threshold)
        tokens = sorted(set(s.split()))
        joined = " ".join(tokens)
        maybe = {i for t in tokens for i in self.by_token.get(t, ())}
        # Without a shared token the sorted token texts themselves must be alike: of like length, with a
        # whole piece in common. The longer side adds up to (1-t)/t of breaks, hence the lower threshold.
        for _, (_, ids) in self.scan_sorted(joined):
            maybe.update(i for i in ids if 200.0 * min(self.widths[i], len(joined)) >= self.threshold * (self.widths[i] + len(joined)))
        found.update(i for i in maybe - found if sim.py_token_set_ratio(self.items[i]["norm"], s) >= self.threshold)
        return sorted(found)


def link_notions(notions: DataFrame, sentences: DataFrame, threshold: float = 90.0,
                 max_local: int = BROADCAST_ROWS, block: int = 4096) -> DataFrame:
    """D-04: notion ↔ sentence links by partial or token-set ratio of the normal forms.

    ``notions``: notion, line. ``sentences``: any key columns plus ``sentence``. A list of at
    most ``max_local`` notions travels to the tasks and sentences stay where they are; a longer
    one is joined block by block, salted so that no block meets all sentences in one task.
    Only links are emitted.
    """
    spark = sentences.sparkSession
    listed = notions.filter(tx.strip("notion") != "").groupBy(tx.match_form("notion").alias("norm")).agg(
        F.max_by(F.struct("notion", "line"), "line").alias("n")).select("norm", "n.*")
    link_type = "array<struct<notion:string,line:int>>"
    keep = [c for c in sentences.columns if c != "sentence"]
    # as a generator the form is made once a row; a filter behind it would be pushed below and make it again
    s = sentences.select(*keep, F.explode(F.filter(F.array(tx.match_form("sentence")), lambda n: tx.strip(n) != "")).alias("__norm"))

    def links(norm: str, index: _NotionIndex) -> list[dict]:
        return [{"notion": index.items[i]["notion"], "line": index.items[i]["line"]} for i in index.links(norm)]

    if fits(listed, max_local):
        local = spark.sparkContext.broadcast([r.asDict() for r in listed.collect()])

        @F.pandas_udf(link_type)
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            index = _NotionIndex(local.value, threshold)
            for norms in batches:
                seen = {n: links(n, index) for n in norms.unique()}
                yield norms.map(seen)

        return s.select(*keep, F.inline(score("__norm")))

    n_blocks = -(-listed.count() // block)
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lists = listed.groupBy(F.pmod(F.xxhash64("norm"), F.lit(n_blocks)).alias("__b")).agg(
        F.collect_list(F.struct("norm", "notion", "line")).alias("items"))
    lists = lists.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # Sentence groups of a few hundred rows share one index build.
    s = s.withColumn("__row", F.struct(*keep, "__norm")).withColumn(
        "__g", F.pmod(F.xxhash64("__row"), F.lit(max(1, s.count() // BLOCK)))).groupBy("__g").agg(
        F.collect_list("__row").alias("rows"))
    s = s.withColumn("__b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    s = s.withColumn("__salt", F.pmod(F.hash("__g"), F.lit(salts)))

    @F.pandas_udf(f"array<{link_type}>")
    def score_block(norms: pd.Series, items: pd.Series) -> pd.Series:
        out = []
        for ns, its in zip(norms, items):
            index = _NotionIndex(list(its), threshold)
            out.append([links(n, index) for n in ns])
        return pd.Series(out)

    pairs = s.join(lists, ["__b", "__salt"]).withColumn(
        "__l", score_block(F.transform("rows", lambda r: r["__norm"]), F.col("items")))
    rows = pairs.select(F.inline(F.arrays_zip("rows", "__l"))).filter(F.size("__l") > 0)
    return rows.select(*[F.col(f"rows.{c}").alias(c) for c in keep], F.inline("__l"))


def link_citations(refs: DataFrame, sentences: DataFrame, slack: int = 30, key: str | Sequence[str] = "doc_id") -> DataFrame:
    """D-05: citations whose position lies in a sentence's span, ``slack`` characters generous.

    ``refs``: key, bib_id, pos. ``sentences``: key, sent_no, start, length. Offsets are cut into
    buckets, so the range condition becomes an equi-join on (key, bucket).
    """
    ks, width = _keys(key), 1024
    end = F.col("start") + F.col("length") + slack
    spans = sentences.withColumn("__b", F.explode(F.sequence(
        F.floor(F.col("start") / width), F.floor((end - 1) / width))))
    marks = refs.withColumn("__b", F.floor(F.col("pos") / width))
    return marks.join(spans, [*ks, "__b"]).filter((F.col("pos") >= F.col("start")) & (F.col("pos") < end)).select(
        *ks, "sent_no", "bib_id").distinct()


def notion_paper_edges(notion_links: DataFrame, citation_links: DataFrame, key: str | Sequence[str] = "doc_id") -> DataFrame:
    """D-06: distinct (key, bib_id, notion, line) of sentences that carry both."""
    ks = _keys(key)
    return notion_links.join(citation_links, [*ks, "sent_no"]).select(*ks, "bib_id", "notion", "line").distinct()


def lookup_bib(edges: DataFrame, bib: DataFrame, on: str | Sequence[str], fields: Sequence[str], default: str = "UNKNOWN") -> DataFrame:
    """D-07: left lookup of the fields as strings, ``default`` where nothing is found."""
    ks = _keys(on)
    out = edges.join(bib.select(*ks, *fields), ks, "left")
    return out.select(*edges.columns, *[F.coalesce(F.col(f).cast("string"), F.lit(default)).alias(f) for f in fields])


def lookup_citation(tokens: DataFrame, refs: DataFrame, key: str = "doc_id", missing: bool = False) -> DataFrame:
    """D-08: ``[n]`` token to its reference; null, or a not-found text with ``missing``."""
    num = F.nullif(F.regexp_extract("token", "^\\s*\\[?\\s*(\\d{1,4})\\s*\\]?\\s*$", 1), F.lit("")).try_cast("int")
    out = tokens.withColumn("num", num).join(refs.select(key, "num", "ref"), [key, "num"], "left")
    if missing:
        out = out.withColumn("ref", F.coalesce("ref", F.concat(
            F.lit("Reference ["), F.col("num").cast("string"), F.lit("] not found"))))
    return out.select(*tokens.columns, "num", "ref")


POLICIES = ("best>", "first>", "best>=")


def resolve_title(papers: DataFrame, candidates: DataFrame, policy: str = "best>", cut: float = 0.60, key: str = "paper_id") -> DataFrame:
    """D-09: candidate whose title resembles the paper's.

    ``papers``: key, title. ``candidates``: key, cand_rank, cand_title. ``best>`` and ``best>=`` take
    the highest score (then lowest rank) over the cut, ``first>`` the lowest rank over it.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy: {policy}")
    pairs = candidates.join(papers.select(key, "title"), key)
    scored = spread(pairs, key, "cand_rank").withColumn("score", sim.ratio_from(cut)("title", "cand_title"))
    # The cut is made in the aggregate: a filter would be pushed below the spread and score every pair there as well.
    over = F.col("score") >= cut if policy == "best>=" else F.col("score") > cut
    row = F.struct("cand_rank", "cand_title", "score")
    pick = F.min_by(row, F.when(over, F.col("cand_rank"))) if policy == "first>" else F.max_by(
        row, F.when(over, F.struct("score", -F.col("cand_rank"))))
    return scored.groupBy(key).agg(pick.alias("m")).filter(F.col("m").isNotNull()).select(
        key, "m.cand_rank", "m.cand_title", F.round("m.score", 6).alias("score"))


def match_page(candidates: DataFrame, cut: float = 0.45, top: int | None = None, key: str = "notion") -> DataFrame:
    """D-10: best page title among a notion's candidates, with ``top`` its first so many.

    ``candidates``: notion, cand_rank (0-based), title; score = 0.7 token overlap + 0.3 ratio.
    """
    score = 0.7 * sim.token_overlap(key, "title") + 0.3 * sim.ratio(F.col(key), F.col("title"))
    some = candidates if top is None else candidates.filter(F.col("cand_rank") < top)
    scored = spread(some, key, "cand_rank").withColumn("score", score)
    best = scored.groupBy(key).agg(F.max_by(
        F.struct("title", "score"), F.struct("score", -F.col("cand_rank"))).alias("m"))
    return best.select(key, "m.title", F.round("m.score", 6).alias("score"), (F.col("m.score") >= cut).alias("ok")).filter("ok").drop("ok")


def figure_mentions(chunks: DataFrame, figures: DataFrame, key: str = "doc_id", size: int = BLOCK) -> DataFrame:
    """D-11: figures and panels a chunk mentions.

    ``chunks``: key, chunk_no, text. ``figures``: key, fig_no, name, panels array<string>. A panel
    is mentioned as ``name_panel`` or ``(panel)``; a whole figure has a null panel.
    """
    base = F.lower(F.regexp_replace("name", "\\.txt$", ""))
    figs = blocks(figures.withColumn("base", base), [key], "fig_no", ["name", "base", "panels"], "f", size)
    joined = chunks.withColumn("__low", F.lower("text")).join(figs, key)

    def found(f: Column) -> Column:
        low = F.col("__low")
        whole = F.filter(F.array(F.lit(None).cast("string")), lambda _: low.contains(f["base"]))
        panels = F.filter(f["panels"], lambda p: low.contains(F.concat(f["base"], F.lit("_"), p))
                          | low.contains(F.concat(F.lit("("), p, F.lit(")"))))
        return F.transform(F.concat(whole, panels), lambda p: F.struct(f["name"].alias("name"), p.alias("panel")))

    return joined.select(key, "chunk_no", F.inline(F.flatten(F.transform("f_items", found))))


def supplement_link(chunks: DataFrame, sections: DataFrame, key: str, n_terms: int | None = None, size: int = BLOCK) -> DataFrame:
    """D-12: first section one of whose terms (with ``n_terms`` the leading ones) occurs in the chunk.

    ``chunks``: key, chunk_no, text. ``sections``: key, section_no, summary.
    """
    terms = tx.words(F.lower("summary"))
    terms = F.array_distinct(terms if n_terms is None else F.slice(terms, 1, n_terms))
    secs = blocks(sections.withColumn("terms", terms), [key], "section_no", ["terms"], "s", size)
    low = F.col("__low")
    hits = F.transform(F.filter("s_items", lambda s: F.exists(s["terms"], lambda t: low.contains(t))), lambda s: s["pos"])
    joined = chunks.withColumn("__low", F.lower("text")).join(secs, key)
    found = joined.select(key, "chunk_no", F.array_min(hits).alias("h")).groupBy(key, "chunk_no").agg(F.min("h").alias("section_no"))
    return chunks.select(key, "chunk_no").join(found, [key, "chunk_no"], "left")


def containing_paragraph(sentences: DataFrame, paragraphs: DataFrame, key: str = "doc_id", size: int = BLOCK) -> DataFrame:
    """D-13: first paragraph that contains the sentence, null if none.

    ``sentences``: key, num, text. ``paragraphs``: key, pos, text. Both compared whitespace-normal.
    """
    left = sentences.select(key, "num", tx.squash("text").alias("text"))
    right = paragraphs.select(key, "pos", tx.squash("text").alias("text"))
    pairs = block_pairs(left, right, [key], "num", "pos", ["text"], ["text"], size)
    found = F.transform("l_items", lambda s: F.struct(s["pos"].alias("num"), F.array_min(F.transform(
        F.filter("r_items", lambda p: (s["text"] != "") & p["text"].contains(s["text"])), lambda p: p["pos"])).alias("para")))
    hits = pairs.select(key, F.inline(found)).filter(F.col("para").isNotNull()).groupBy(key, "num").agg(F.min("para").alias("para"))
    return sentences.select(key, "num").join(hits, [key, "num"], "left")


def tail_words(c: Column | str, n: int) -> Column:
    toks = F.regexp_extract_all(tx.squash(c), F.lit("(?U)\\w+"), F.lit(0))
    return tx.let(toks, lambda ws: F.array_join(F.slice(ws, F.greatest(F.size(ws) - n, F.lit(0)) + 1, F.lit(n)), " "))


def anchor_formulas(formulas: DataFrame, sentences: DataFrame, cut: float = 0.55, key: str = "doc_id", size: int = BLOCK) -> DataFrame:
    """D-14: sentence a formula follows: first containing its anchor, else the most similar tail at
    or over the cut, else the last sentence.

    ``formulas``: key, formula_no, anchor. ``sentences``: key, num, text.
    """
    formulas = reuse(formulas)  # read for the sizes of the cells, for the cells and for the result
    left = formulas.withColumn("__a", F.lower(F.coalesce("anchor", F.lit(""))))
    right = sentences.withColumn("__t", F.lower("text")).withColumn("__tail", F.lower(tail_words("text", 14)))

    @F.pandas_udf("array<struct<formula_no:long,inside:long,near:long,score:double,last:long>>")
    def score(nos: pd.Series, anchors: pd.Series, nums: pd.Series, texts: pd.Series, ends: pd.Series) -> pd.Series:
        out = []
        for fno, fs, num, ts, es in zip(nos, anchors, nums, texts, ends):
            order = sorted(zip(num.tolist(), ts, es), key=lambda x: x[0])
            tails = [(pos, tail) for pos, _, tail in order if tail]
            block: sim.RatioBlock | None = None
            rows = []
            for no, a in zip(fno.tolist(), fs):
                inside = next((pos for pos, text, _ in order if a in text), None) if a else None
                near, best = None, 0.0
                if a and inside is None and tails:
                    # the bound tells which tails can reach the cut at all
                    block = block or sim.RatioBlock([tail for _, tail in tails])
                    if m := block.best(a, cut):
                        near, best = tails[m[0]][0], m[1]
                rows.append({"formula_no": no, "inside": inside, "near": near, "score": best, "last": order[-1][0]})
            out.append(rows)
        return pd.Series(out)

    pairs = block_pairs(left, right, [key], "formula_no", "num", ["__a"], ["__t", "__tail"], size)
    hits = pairs.select(key, F.inline(score("l_items.pos", "l_items.__a", "r_items.pos", "r_items.__t", "r_items.__tail"))).groupBy(key, "formula_no").agg(
        F.min("inside").alias("inside"),
        F.max_by(F.struct("near", "score"), F.struct("score", -F.col("near"))).alias("n"),
        F.max("last").alias("last"))
    how = F.when(F.col("inside").isNotNull(), "contained").when(F.col("n.score") >= cut, "similar").otherwise("last")
    num = F.coalesce("inside", F.when(F.col("n.score") >= cut, F.col("n.near")), "last")
    return formulas.join(hits.select(key, "formula_no", num.alias("num"), how.alias("how")), [key, "formula_no"], "left")


# The plan of a slide made for a left-over figure, and the words that place it.
FORCED_PLAN = ("Explain {fig}: what it shows, why it was measured, "
               "and how it supports the broader narrative of this section.")
EARLY_FIGURE = ("setup", "experimental", "apparatus")
MIDDLE_FIGURE = ("mechanism", "gain", "dynamics", "loss")


def _bound(slides: Column, free: Column, choose) -> Column:
    """Slides with figures and the figures left over: a slide without one takes what ``choose(free, slide)`` names, if anything."""

    def step(acc: Column, s: Column) -> Column:
        empty = F.coalesce(s["figure_used"], F.lit("")) == ""
        return tx.let(F.when(empty, choose(acc["free"], s)), lambda fig: tx.let(F.array_position(acc["free"], fig), lambda at: F.struct(
            F.filter(acc["free"], lambda f, i: fig.isNull() | (i != at - 1)).alias("free"),
            F.array_append(acc["slides"], F.struct(s["plan"].alias("plan"), F.coalesce(fig, s["figure_used"]).alias("figure_used"),
                                                   F.lit(False).alias("forced"))).alias("slides"))))

    none = F.array().cast("array<struct<plan:string,figure_used:string,forced:boolean>>")
    return F.aggregate(slides, F.struct(free.alias("free"), none.alias("slides")), step)


def _with_leftovers(slides: Column, free: Column) -> Column:
    """A slide of its own for each left-over figure, at the place its name suggests."""

    def insert(out: Column, fig: Column) -> Column:
        low, n = F.lower(fig), F.size(out)
        has = lambda words: F.greatest(*[low.contains(w) for w in words])
        at = F.when(has(EARLY_FIGURE), F.least(F.lit(1), n)).when(
            has(MIDDLE_FIGURE), F.least(F.greatest(F.lit(1), F.floor(n / 2).cast("int")), n)).otherwise(n)
        own = F.struct(F.replace(F.lit(FORCED_PLAN), F.lit("{fig}"), fig).alias("plan"), fig.alias("figure_used"), F.lit(True).alias("forced"))
        return tx.let(at, lambda k: F.concat(F.slice(out, F.lit(1), k), F.array(own), F.slice(out, k + 1, n)))

    return F.aggregate(free, slides, insert)


def assign_figures(plans: DataFrame, min_score: int = 2) -> DataFrame:
    """D-15: slides of each group with figures bound and renumbered.

    ``plans`` has one row per group with ``slides`` (array of slide_id, plan[, figure_used]),
    ``available_figures``, ``content_scope`` and ``purpose``, as ``parse_plan_blocks`` gives it. Named figures are bound
    first, then those that share ``min_score`` long words with a plan, then the rest get slides; all within the row.
    """
    fields = plans.schema["slides"].dataType.elementType.fieldNames()
    shaped = F.transform("slides", lambda s: F.struct(
        F.coalesce(s["plan"], F.lit("")).alias("plan"),
        (s["figure_used"] if "figure_used" in fields else F.lit(None).cast("string")).alias("figure_used")))
    context = F.concat_ws(" ", "content_scope", "purpose")
    figures = F.filter(F.coalesce("available_figures", F.array().cast("array<string>")), lambda f: f.isNotNull())

    def named(free: Column, s: Column) -> Column:
        return F.get(F.filter(free, lambda f: F.lower(s["plan"]).contains(F.lower(f))), F.lit(0))

    def similar(free: Column, s: Column) -> Column:
        body = F.lower(F.concat(s["plan"], F.lit(" "), context))
        score = lambda f: F.size(F.filter(F.regexp_extract_all(F.lower(f), F.lit("(?U)\\w+"), F.lit(0)),
                                          lambda t: (F.length(t) > 4) & body.contains(t)))
        best = F.array_max(F.transform(free, lambda f, i: F.struct(score(f).alias("score"), (-i).alias("i"), f.alias("f"))))
        return tx.let(best, lambda b: F.when(b["score"] >= min_score, b["f"]))

    keep = [c for c in plans.columns if c not in ("slides", "available_figures")]
    out = plans.withColumn("__one", _bound(shaped, figures, named))
    out = out.withColumn("__two", _bound(F.col("__one.slides"), F.col("__one.free"), similar))
    placed = F.transform(_with_leftovers(F.col("__two.slides"), F.col("__two.free")), lambda s, i: F.struct(
        (i + 1).alias("slide_id"), s["plan"].alias("plan"), s["figure_used"].alias("figure_used"), s["forced"].alias("forced")))
    return out.select(*keep, F.inline(placed))


def attach_bullet_text(df: DataFrame, bullets: DataFrame, keep: str = "first") -> DataFrame:
    """D-16: bullet text by id; the ``first`` or ``last`` definition by ``pos`` wins, blank if none."""
    src = bullets if keep == "first" else bullets.filter((tx.strip("bullet_id") != "") & (tx.strip("bullet_text") != ""))
    pick = F.min_by("bullet_text", "pos") if keep == "first" else F.max_by("bullet_text", "pos")
    return df.join(src.groupBy("bullet_id").agg(pick.alias("bullet_text")), "bullet_id", "left").withColumn(
        "bullet_text", F.coalesce("bullet_text", F.lit("")))


def restrict(df: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """D-17: rows whose key is requested."""
    ks = _keys(on)
    return df.join(keys.select(*ks), ks, "left_semi")


def skip_existing(df: DataFrame, done: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """D-18: rows whose key is not done yet."""
    ks = _keys(on)
    return df.join(done.select(*ks), ks, "left_anti")


def papers_by_notion(papers: DataFrame, notions: DataFrame, key: str = "notion") -> DataFrame:
    """D-19: papers of listed notions; a notion without papers keeps one row of nulls."""
    return notions.select(key).distinct().join(papers, key, "left")


def resolve_keys(requests: DataFrame, slides: DataFrame, deck: str = "deck_id") -> DataFrame:
    """D-20: slide reference to slide_uid, with a status.

    ``requests``: deck, req_id, slide_uid, group_id, slide_id, group_index, name_contains.
    ``slides``: deck, slide_uid, group_id, group_index, group_name, slide_id. Rules in order: uid, group id, group index,
    name part, slide id alone.
    """
    groups = slides.select(deck, "group_id", "group_index", "group_name").distinct()
    named = blocks(groups, [deck], "group_index", ["group_id", "group_name"], "g").withColumnRenamed("g_items", "items")
    by_name = requests.filter(F.col("name_contains").isNotNull()).join(named, deck).select(
        deck, "req_id", F.filter("items", lambda g: F.lower(g["group_name"]).contains(F.lower(F.col("name_contains")))).alias("m")
    ).groupBy(deck, "req_id").agg(
        F.sum(F.size("m")).alias("n_name"), F.min(F.get(F.transform("m", lambda g: g["group_id"]), F.lit(0))).alias("name_gid"))
    by_id = slides.groupBy(deck, "slide_id").agg(F.count("*").alias("n_id"), F.min("slide_uid").alias("only_uid"))
    by_index = groups.select(deck, "group_index", F.col("group_id").alias("index_gid"))

    def uid(gid: str) -> Column:
        return F.concat(F.col(gid), F.lit("::Slide_"), F.col("slide_id").cast("string"))

    r = requests.join(by_index, [deck, "group_index"], "left").join(by_name, [deck, "req_id"], "left").join(
        by_id, [deck, "slide_id"], "left")
    rule = (
        F.when(F.coalesce("slide_uid", F.lit("")) != "", "uid").when(F.col("slide_id").isNull(), "none")
        .when(F.col("group_id").isNotNull(), "group").when(F.col("group_index").isNotNull(), "index")
        .when(F.col("name_contains").isNotNull(), "name").otherwise("id"))
    r = r.withColumn("rule", rule)
    is_ = lambda x: F.col("rule") == x
    want = (F.when(is_("uid"), F.col("slide_uid")).when(is_("group"), uid("group_id")).when(is_("index"), uid("index_gid"))
            .when(is_("name") & (F.col("n_name") == 1), uid("name_gid")).when(is_("id") & (F.col("n_id") == 1), F.col("only_uid")))
    known = slides.select(deck, F.col("slide_uid").alias("want"), F.lit(True).alias("known"))
    r = r.withColumn("want", want).join(known, [deck, "want"], "left")
    status = (F.when(is_("none"), "slide_id required").when(is_("index") & F.col("index_gid").isNull(), "group_index out of range")
              .when(is_("name") & (F.coalesce("n_name", F.lit(0)) == 0), "no group matches").when(is_("name") & (F.col("n_name") > 1), "ambiguous group")
              .when(is_("id") & (F.coalesce("n_id", F.lit(0)) == 0), "no slide").when(is_("id") & (F.col("n_id") > 1), "ambiguous slide")
              .when(F.col("known"), "ok").otherwise("not found"))
    return r.select(deck, "req_id", F.when(status == "ok", F.col("want")).alias("resolved_uid"), status.alias("status"))


def majority_figure(matches: DataFrame, min_share: float = 0.4, key: str | Sequence[str] = "block") -> DataFrame:
    """D-21: figure most matched partners of a block lie in, when at least ``min_share`` of all rows do.

    ``matches``: key, num, partner_fig (null if unmatched or not in a figure). Ties go to the
    figure met first.
    """
    ks = _keys(key)
    total = matches.groupBy(*ks).agg(F.count("*").alias("n"))
    votes = matches.filter(F.col("partner_fig").isNotNull()).groupBy(*ks, "partner_fig").agg(
        F.count("*").alias("c"), F.min("num").alias("met"))
    top = votes.groupBy(*ks).agg(F.min_by(F.struct("partner_fig", "c"), F.struct(-F.col("c"), "met", "partner_fig")).alias("t"))
    return total.join(top, ks, "left").select(
        *ks, F.when(F.col("t.c") >= F.col("n") * min_share, F.col("t.partner_fig")).alias("majority"), "n",
        F.coalesce("t.c", F.lit(0)).alias("votes"))


def word_windows(df: DataFrame, n: int = 10, key: str = "doc_id", column: str = "text") -> DataFrame:
    """Each run of ``n`` lower-case words as a 128-bit fingerprint, with word offset and line number."""

    def of(tagged: Column) -> Column:
        return tx.let(tagged["w"], lambda ws: F.transform(
            F.when(F.size(tagged) >= n, F.sequence(F.lit(0), F.size(tagged) - n)).otherwise(F.array().cast("array<int>")),
            lambda i: F.struct(i.alias("at"), F.get(tagged, i)["line"].alias("line"), F.array_join(F.slice(ws, i + 1, F.lit(n)), " ").alias("win"))))

    tagged = F.flatten(F.transform(tx.let(F.lower(column), tx.lines), lambda x, i: F.transform(
        tx.words(x), lambda w: F.struct(w.alias("w"), i.alias("line")))))
    out = df.select(key, F.inline(tx.let(tagged, of)))
    return out.select(key, "at", "line", F.xxhash64("win").alias("h1"), F.xxhash64(F.lit(7), "win").alias("h2"))


def match_passages(passages: DataFrame, docs: DataFrame, n: int = 10, pkey: str = "item_id", dkey: str = "doc_id") -> DataFrame:
    """D-22: earliest place in a document where any ``n``-word window of a passage occurs.

    Windows meet in an equi-join on their fingerprint; a passage list within the size bound is
    broadcast, so document windows are not shuffled.
    """
    wp = word_windows(passages, n, pkey).select(pkey, "h1", "h2").distinct()
    hits = word_windows(docs, n, dkey).join(broadcast_if_small(wp), ["h1", "h2"])
    return hits.groupBy(pkey, dkey).agg(
        F.min("at").alias("word_at"), F.min_by("line", "at").alias("line_no"), F.countDistinct("at").alias("n_windows"))
