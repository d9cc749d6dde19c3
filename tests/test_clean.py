"""Line rules on one positive and one near miss each, and the record operators."""

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import clean

LINES = [
    (clean.is_axis_line, "0.1 0.2 (3)", True), (clean.is_axis_line, "0.1 per cent of all", False),
    (clean.is_axis_line, "Frequency kHz axis", True), (clean.is_axis_line, "Frequency khz axis", False),
    (clean.is_axis_line, "ab", True), (clean.is_axis_line, "abc", False),
    (clean.is_axis_line, "a b c word", True), (clean.is_axis_line, "a big word here", False),
    (clean.is_equation_line, "α+β=γ", True), (clean.is_equation_line, "alpha plus beta", False),
    (clean.is_equation_line, "x=1, y=2", True), (clean.is_equation_line, "x=1 only", False),
    (clean.is_equation_line, "a + b + c + d", True), (clean.is_equation_line, "", False),
    (clean.is_equation_line, "x=1, y=2 " + "w" * 100, False),
    (clean.is_metadata_line, "write to a@b.org", True), (clean.is_metadata_line, "write to a at b", False),
    (clean.is_metadata_line, "Received 3 May 2020", True), (clean.is_metadata_line, "Received with thanks", False),
    (clean.is_metadata_line, "see Volume three", True), (clean.is_metadata_line, "see volumes three", False),
    (clean.is_metadata_line, "pp. 12–15", True), (clean.is_metadata_line, "ppm values", False),
    (clean.is_author_line, "Vera M. Schäfer and Ann Lee", True), (clean.is_author_line, "Methods", False),
    (clean.is_author_line, "The Results of our long survey of many things", False),
    (clean.is_running_line, "https://x.org/a", True), (clean.is_running_line, "see https://x.org", False),
    (clean.is_running_line, "12", True), (clean.is_running_line, "(2020)", True), (clean.is_running_line, "12345", False),
    (clean.is_running_line, "Smith et al.", True), (clean.is_running_line, "Quantum Optics", True),
    (clean.is_running_line, "quantum Optics", False),
    (clean.is_short_junk, "ABC", True), (clean.is_short_junk, "AB", False), (clean.is_short_junk, "http://x", True),
    (clean.is_header_line, "RESULTS", True), (clean.is_header_line, "Results", False), (clean.is_header_line, "1. Setup", True),
    (clean.is_header_line, "Our Methods", True), (clean.is_header_line, "A" * 151, False),
]


def test_line_rules(spark):
    for rule in {r for r, _, _ in LINES}:
        cases = [(s, want) for r, s, want in LINES if r is rule]
        df = spark.createDataFrame(cases, "line string, want boolean")
        bad = df.withColumn("got", rule(F.col("line"))).filter(~F.col("got").eqNullSafe(F.col("want"))).collect()
        assert not bad, (rule.__name__, bad)


def texts(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id long, text string")


def column(df, name="text"):
    return [r[name] for r in df.orderBy("doc_id").collect()]


def test_clean_sections_judges_runs_as_one(spark):
    # The run of two caps lines is an author block; the line that ends it goes with it.
    doc = "INTRO ANN LEE\nBOB MAY\nplain line after the run\nkept line of plain words"
    # A caps run that is no author block would need few capitals per word, so it is kept whole.
    keep = "aBC dE word1 word2\nplain words follow here"
    got = column(clean.clean_sections(texts(spark, doc, keep, "", "  ")))
    assert got[0] == "kept line of plain words"
    assert got[2:] == ["", ""]


def test_line_ends_and_empty_text(spark):
    df = texts(spark, "one two three\r\nab\rfour five six\n", "", "ab\n")
    assert column(clean.drop_axis_lines(df)) == ["one two three\nfour five six", "", ""]


def test_wiki(spark):
    para = "word " * 12
    got = column(clean.clean_wiki(texts(spark, f"{para}[12] {{{{box}}}} <b>$x$</b>\n\nshort\n\n{'-' * 60}")))
    assert got == [para.strip()]


def test_notions(spark):
    got = clean.filter_notions(texts(spark, "- Laser cavity\n* This note\n• one two three four\n\nLaser cavity\nphoton loss")).collect()
    assert sorted(r.notion for r in got) == ["Laser cavity", "photon loss"]


def test_validate_specs(spark):
    ok = dict(slide_uid="u", expected_uid="u", title="t", figure_used=None, suggested=["f"], on_slide_bullets=list("abcde"), transition="x", reminders=[])
    broken = [({}, None), ({"slide_uid": "v"}, "slide_uid mismatch"), ({"title": " "}, "missing title"), ({"figure_used": "g"}, "figure not suggested"),
              ({"figure_used": "f"}, None), ({"on_slide_bullets": None}, "bullets not a list"), ({"on_slide_bullets": list("abcd ")}, "bullet count outside 5-7"),
              ({"on_slide_bullets": list("abcdefg")}, None), ({"transition": None}, "missing transition"), ({"reminders": ["a", " "]}, "empty reminder")]
    schema = ("doc_id long, slide_uid string, expected_uid string, title string, figure_used string, suggested array<string>, "
              "on_slide_bullets array<string>, transition string, reminders array<string>")
    rows = [(i, *[{**ok, **b}[k] for k in ok]) for i, (b, _) in enumerate(broken)]
    df = clean.validate_specs(spark.createDataFrame(rows, schema))
    assert column(df, "reason") == [want for _, want in broken]
    good, rejected = clean.split_valid(df)
    assert (good.count(), rejected.count()) == (3, 7)


def test_coerce(spark):
    rows = [("b1", "s", "0.1", "Strong", " "), ("b2", "s", None, "x", "a"), (" ", "s", "1", None, "a"), ("b3", "s", "1.4", None, None), ("b4", "s", "bad", "WEAK", "q")]
    got = clean.coerce_candidates(spark.createDataFrame(rows, "bullet_id string, slide_uid string, priority string, exclusivity string, argument string"))
    assert {r.bullet_id: (r.priority, r.exclusivity, r.argument) for r in got.collect()} == {
        "b1": (0.35, "strong", "MISSING_ARGUMENT"), "b2": (0.5, "medium", "a"), "b3": (1.0, "medium", "MISSING_ARGUMENT"), "b4": (0.5, "weak", "q")}


def test_results_conclusions_ids(spark):
    df = texts(spark, "The data show it", "one regime with threshold", "one regime only", "nothing")
    assert column(clean.classify_results(df), "is_results") == [True, True, False, False]
    chunks = spark.createDataFrame([(1, 0, "a"), (1, 1, "In summary, b"), (1, 2, "overall"), (2, 0, "x")], "doc_id long, n int, text string")
    assert {r.doc_id: r.conclusion_at for r in clean.first_conclusion(chunks, "doc_id", "n").collect()} == {1: 1, 2: -1}
    ids = clean.filter_ids(spark.createDataFrame([("2301.01234\nabc\n12\ncs.LG\nmath.ST\nq-bio.GN\nstat.ML",)], "raw string"), "category")
    assert ids.first().ids == ["cs.LG", "math.ST", "q-bio.GN", "stat.ML"]


@pytest.mark.parametrize("variant,want", [("folded", "Ecole_a.b_(c)"), ("basic", "École_a.b_(c)"), ("path", "École!_a.b_(c)"), ("short", "École!_a.b_(c)"), ("title", "École_ab_c")])
def test_keys(spark, variant, want):
    assert clean.safe_key(texts(spark, "École! a.b (c)"), variant).first().key == want
