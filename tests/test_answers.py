"""Answers in sections, and small helpers of pages, names and paths, against fixtures by the rules."""

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import scalars as S
from tallyloom.operators import answers, cells, layout, missing
from tallyloom.plans import standardise

TEXTS = {
    1: "Key insights:\n1. Sales: up 12% over the year\n2. Costs: flat\n\nWe recommend a review.",
    2: "- Growth: strong\nand lasting\n* Risk: low",
    3: "Intro only.\n\nThese findings matter.\n\nConclusions follow here.",
    4: "Cause: wrong column\nname used\nSolution: rename it\nTips: check the schema",
    5: "This works because the key is unique. For example id 7. Short.",
    6: "1. Compare regions\n2. Wait",
    7: "",
    8: None,
}


@pytest.fixture(scope="module")
def said(spark):
    return spark.createDataFrame(list(TEXTS.items()), "k int, text string")


def test_sections(said):
    got = {(r.k, r.place): (r.title, r.content) for r in answers.sections(said, "k").collect()}
    assert got[1, 0] == ("Sales", "up 12% over the year") and got[1, 1] == ("Costs", "flat")
    assert got[2, 0] == ("Growth", "strong\nand lasting") and got[2, 1] == ("Risk", "low")
    assert {v for (k, _), v in got.items() if k == 3} == {("Analysis 2", "These findings matter."), ("Analysis 3", "Conclusions follow here.")}
    assert not [k for k, _ in got if k in (5, 6, 7, 8)]


def test_suggestions_and_fields(said):
    got = {(r.k, r.place): (r.suggestion, r.actionable) for r in answers.suggestions(said, "k").collect()}
    assert got[6, 0] == ("Compare regions", True) and got[6, 1] == ("Wait", False)
    fields = {r.k: r for r in answers.diagnosis(said, "k").collect()}
    assert fields[4].cause == "wrong column\nname used" and fields[4].prevention == "check the schema" and fields[4].confidence == 1
    assert fields[4].solution.startswith("rename it") and fields[5].confidence == pytest.approx(0.2) and fields[8].cause is None


def test_judged(said):
    got = {r.k: r for r in answers.judged(said, "k").collect()}
    assert set(got) == set(range(1, 8))
    assert got[1].analysis_confidence == pytest.approx(1.0) and got[1].sections == 2 and got[1].has_recommendations
    assert got[7].analysis_confidence == pytest.approx(0.3) and got[7].explanation_confidence == pytest.approx(0.3)
    assert got[5].explaining == 2 and got[5].has_reasoning and got[5].has_examples and got[5].explanation_confidence == pytest.approx(0.7)
    assert got[6].actionable == 1 and got[6].suggestion_confidence == pytest.approx(0.7)
    assert [r.sentence for r in answers.explanations(said, "k").where("k = 5").orderBy("place").collect()] == ["This works because the key is unique", "For example id 7"]


@pytest.mark.parametrize("words, want", [(4, 0.4), (12, 0.6), (30, 0.8), (60, 0.6), (90, 0.4)])
def test_clarity(spark, words, want):
    """The piece after the last full stop counts as one of no words."""
    one = spark.createDataFrame([(" ".join(["w"] * words) + ".",)], "t string")
    assert one.select(answers.clarity(F.col("t"))).first()[0] == want


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_small_rules(spark):
    lit = F.lit
    for text, want in (("2024-01-05", "%Y-%m-%d"), ("01/05/2024", "%m/%d/%Y"), ("01-05-2024", "%m-%d-%Y"), ("2024/01/05", "%Y/%m/%d"), ("soon", None)):
        assert value(spark, S.date_format_of(lit(text))) == want
    assert value(spark, S.safe_filename(lit(' .a<b>:c"d/e\\f|g?h*. '))) == "a_b__c_d_e_f_g_h_"
    for path, want in (("/api/upload/x", "upload"), ("/export", "export"), ("/v1/chat", "chat"), ("/dashboard/1", "dashboard"), ("/other", "api")):
        assert value(spark, S.endpoint_class(lit(path))) == want
    for c, want in ((0.8, "high"), (0.79, "medium"), (0.6, "medium"), (0.59, "low")):
        assert value(spark, layout.confidence_band(lit(c))) == want
    for text, c, w, h, want in (("a", 0.5, 10, 10, 0.4), ("ab", 0.5, 10, 10, 0.5 * 0.9 * 1.1), ("table", 0.95, 10, 10, 1.0), ("x", 0.5, 300, 10, 0.5 * 0.8 * 0.8), ("aBcD3x", 0.5, 10, 10, 0.5 * 1.1 * 0.9)):
        assert value(spark, layout.word_confidence(lit(text), lit(c), lit(w), lit(h))) == pytest.approx(want)


def test_pages_and_engines(spark):
    words = spark.createDataFrame([("a", 0.31), ("b", 0.3), (" ", 0.9)], "text string, confidence double")
    assert [r.text for r in layout.sure_words(words).collect()] == ["a"]
    pages = spark.createDataFrame([(1, " ", 0.9), (2, None, 0.2), (3, "#§" * 60, 0.5), (4, "fine " * 30, 0.29)], "page int, text string, confidence double")
    got = {r.page: (r.empty, r.doubtful, r.garbled) for r in cells.sanity(pages, "page").collect()}
    assert got == {1: (True, False, False), 2: (True, True, False), 3: (False, False, True), 4: (False, True, False)}
    both = spark.createDataFrame([(1, "a", 0.80, 100), (1, "b", 0.84, 100), (2, "a", 0.80, 100), (2, "b", 0.86, 100), (3, "a", 0.80, 50), (3, "b", 0.80, 100)], "page int, engine string, confidence double, length int")
    assert {r.page: r.engine for r in layout.better_result(both, ["page"], preferred="a").collect()} == {1: "a", 2: "b", 3: "a"}
    assert {r.page: r.engine for r in layout.better_result(both, ["page"]).collect()} == {1: "b", 2: "b", 3: "b"}


def test_fragments(spark):
    """Leaders as by comparing all tables, nulls agreeing with nothing."""
    import random

    rng = random.Random(3)
    lists = [[rng.choice(["a", "b", "c", None, " A "]) for _ in range(rng.choice([1, 3, 5, 10]))] for _ in range(150)] + [[], []]
    for k in range(60):
        base = list(rng.choice(lists[:20]))
        if base:
            base[rng.randrange(len(base))] = f"x{k % 5}"
        lists.append(base)
    low = [[None if h is None else h.strip().lower() for h in x] for x in lists]
    want = {}
    for i, a in enumerate(low):
        like = [j for j in range(i) if a and len(low[j]) == len(a) and sum(x is not None and x == y for x, y in zip(a, low[j], strict=True)) >= 0.8 * len(a) - 1e-9]
        want[i] = min(like, default=i)
    got = layout.fragments(spark.createDataFrame(list(enumerate(lists)), "table_id int, headers array<string>"))
    assert {r.table_id: r.leader for r in got.collect()} == want


def test_auto_clean_and_policies(spark):
    df = spark.createDataFrame([(1, " 5 ", "x ", None, None), (2, "7", "y", None, True), (3, "7", "y", None, True), (4, None, None, None, None), (5, "$9", None, None, False)], "row int, n string, t string, void string, ok boolean")
    got = standardise.auto_clean(df, "row")
    assert "void" not in got.columns and dict(got.dtypes)["n"] == "double"
    assert sorted((r.n, r.t) for r in got.select("n", F.coalesce("t", F.lit("")).alias("t")).collect()) == [(5.0, "x"), (7.0, "y"), (9.0, "")]
    policies = missing.default_policies(df.withColumn("m", F.col("n").try_cast("double")))
    assert (policies["m"].strategy, policies["t"].strategy, policies["ok"].strategy) == ("median", "mode", "false") and "row" not in policies
