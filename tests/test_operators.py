"""Small tables with known results, and every catalogue query against DuckDB."""

import json
import math
import os
import random
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyloom.functions import scalars as S
from tallyloom.functions.similarity import similarity
from tallyloom.operators import cells, charts, dedup, filters, kpi, layout, logs, missing, privacy, ranks, recommend, schema, templates, text, types
from tallyloom.plans import catalogue, questions, standardise
from tallyloom.sources import io
from tallyloom.streaming import streams

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(testdata):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{testdata}/sf0.001/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{float(v):.3f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_catalogue(spark, duck, testdata, name):
    got = catalogue.QUERIES[name](spark, f"{testdata}/sf0.001")
    if name not in catalogue.SQL:
        assert got.collect() is not None
        return
    want = duck.sql(catalogue.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    mine = sorted(tuple(plain(r[c]) for c in order) for r in got.collect())
    theirs = sorted(tuple(plain(r[want.columns.index(c)]) for c in order) for r in want.fetchall())
    assert mine == theirs


def test_missing_values(spark):
    df = spark.createDataFrame([(0, 1.0, "A"), (1, 2.0, "B"), (2, None, ""), (3, 4.0, "D"), (4, 5.0, "E"), (5, None, None), (6, 7.0, "G")], "row_id int, n double, t string")
    clean = missing.sentinels_to_null(df)
    assert clean.where("t IS NULL").count() == 2
    values = lambda d: {r.row_id: r.n for r in d.collect()}
    assert values(missing.fill_mean(df, "n"))[2] == pytest.approx(3.8)
    assert values(missing.fill_median(df, "n"))[5] == 4
    assert values(missing.fill_mode(df, "n"))[2] == 1
    assert [values(missing.fill_forward(df, "n", ["row_id"]))[k] for k in (2, 5)] == [2, 5]
    assert [values(missing.fill_backward(df, "n", ["row_id"]))[k] for k in (2, 5)] == [4, 7]
    line = missing.interpolate(df.withColumn("g", F.lit(1)), "n", ["row_id"], ["g"])
    assert [values(line)[k] for k in (2, 5)] == [3, 6]
    assert missing.drop_missing(df, "n").count() == 5
    knn = missing.knn_impute(df.withColumn("o", F.col("row_id") * 10 + 10), "n", ["o"], "row_id", 2)
    assert [values(knn)[k] for k in (2, 5)] == [3, 6]


def test_duplicates(spark):
    df = spark.createDataFrame([(0, 1, "a", 10), (1, 2, "b", 20), (2, 1, "a", 10), (3, 3, "c", 30), (4, 2, "b", 20)], "r int, A int, B string, C int")
    assert {x.r for x in dedup.exact(df, "r").collect()} == {0, 1, 3}
    rows = ["john doe|25|nyc", "jane smith|30|la", "jon doe|25|nyc", "bob jones|35|chicago", "john doe|25|new york"]
    t = spark.createDataFrame(list(enumerate(rows)), "k long, t string")
    pairs = t.alias("a").join(t.alias("b"), F.expr("a.k < b.k")).select(F.col("a.k").alias("x"), F.col("b.k").alias("y"), similarity(F.col("a.t"), F.col("b.t")).alias("s"))
    s = {(r.x, r.y): round(r.s, 4) for r in pairs.collect()}
    assert (s[0, 2], s[0, 4], s[2, 4]) == (0.9655, 0.8, 0.7647)
    lead = lambda th: {r.row: r.leader for r in dedup.leader_groups(dedup.similar_pairs(t, "k", "t", th)).collect()}
    assert lead(0.70) == {0: 0, 2: 0, 4: 0} and lead(0.85) == {0: 0, 2: 0}
    people = spark.createDataFrame([("Name", "Age", "City"), ("John", "25", "NYC"), (" name ", "AGE", "city")], "Name string, Age string, City string")
    assert dedup.without_headers(people, people.columns).count() == 1
    odd = spark.createDataFrame([(0, "a@b.co", "$5.00"), (1, "c@d.org", "$7.25")], "r int, `Unnamed: 0` string, `1` string")
    assert dedup.meaningful_names(odd, "r").columns == ["r", "Email", "Currency"]


def test_types(spark):
    df = spark.createDataFrame([("yes", "$100.50", "25%", "2024-01-02", "100", "x"), ("no", "$1,200", "5%", "2024-02-03", "N/A", "100")], "b string, c string, p string, d string, n string, t string")
    assert [r.data_type for r in types.detect(df).collect()] == ["BOOLEAN", "CURRENCY", "PERCENTAGE", "DATE", "NUMBER", "TEXT"]
    some = spark.createDataFrame([("100",), ("200",), ("abc",), ("400",)], "v string")
    assert types.detect(some).first().data_type == "TEXT"
    assert types.detect(some, config=types.TypeConfig(threshold=0.7)).first().data_type == "NUMBER"
    assert standardise.standardise(df.withColumn("r", F.monotonically_increasing_id()), "r").count() == 2


def test_kpis(spark):
    def direction(*values):
        df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values)], "k int, t int, v double")
        r = kpi.trends(df, ["k"], "t", "v").first()
        return r.direction, round(r.percent, 4)

    assert direction(100, 110, 120, 130, 140, 150) == ("UP", 50.0)
    assert direction(150, 140, 130, 120, 110, 100) == ("DOWN", -33.3333)
    assert direction(100, 102, 98, 101, 99, 103) == ("STABLE", 3.0)
    assert direction(100, 200, 50, 180, 30, 170, 40, 190)[0] == "VOLATILE"
    assert direction(1, 2) == ("STABLE", 0.0)
    one = lambda v: spark.createDataFrame([("a", v)], "kpi_id string, value double")
    r = kpi.comparisons(one(10000.0), one(8000.0)).first()
    assert (r.difference, r.percent, r.improved) == (2000, 25, True)


def test_charts_and_filters(spark):
    df = spark.createDataFrame([("A", 10), ("B", 20), ("C", 15), ("A", 12), ("B", 18)], "category string, value int")
    assert {r.category: r.value for r in charts.bar(df, "category", "value").collect()} == {"A": 22, "B": 38, "C": 15}
    assert sum(r["count"] for r in charts.histogram(df, "value", 4).collect()) == 5
    assert filters.widget_filter(df, "select", "category", ["A", "B"]).count() == 4
    assert filters.widget_filter(df, "range", "value", (12, 18)).count() == 3
    head = spark.createDataFrame([(0, "a", " "), (1, "b", "c")], "r int, x string, y string")
    assert filters.promote_header(head, "r", 0).columns == ["r", "a", "col_1"]
    assert filters.drop_empty(spark.createDataFrame([(1, None), (None, None)], "a int, b int")).columns == ["a"]


def test_schema_levels(spark):
    old = spark.createDataFrame([("id", "NUMBER", False), ("age", "NUMBER", False)], "name string, data_type string, nullable boolean")
    level = lambda rows: schema.compatibility(schema.diff(old, spark.createDataFrame(rows, old.schema))).first().level
    assert level([("id", "NUMBER", False), ("age", "NUMBER", False)]) == "identical"
    assert level([("id", "NUMBER", False), ("age", "NUMBER", False), ("mail", "TEXT", True)]) == "minor"
    assert level([("id", "NUMBER", False)]) == "major"
    assert level([("id", "NUMBER", False), ("age", "TEXT", False)]) == "major"


def test_privacy(spark):
    df = spark.createDataFrame([(1, "SSN 123-45-6789 and 555-123-4567"), (2, "Employee: John Smith"), (3, "plain document"), (4, "card 4532-1234-5678-9012")], "id int, text string")
    got = {r.id: (r.level, r.m) for r in df.select("id", privacy.classification("text", "document").alias("level"), privacy.masked("text").alias("m")).collect()}
    assert [got[k][0] for k in (1, 2, 3, 4)] == ["RESTRICTED", "CONFIDENTIAL", "INTERNAL", "RESTRICTED"]
    assert got[1][1] == "SSN [SSN_REDACTED] and [PHONE_REDACTED]"
    assert {r.kind for r in privacy.spans(df.where("id = 1"), "id").collect()} == {"ssn", "phone"}


def test_scalars(spark):
    row = spark.range(1).select(
        S.all_numbers(F.lit("a -1.5 b 20")).alias("n"), S.file_size_text(F.lit(1536)).alias("f"), S.kpi_text(F.lit(2_500_000.0), "currency").alias("k"),
        S.decrypted(S.encrypted(F.lit("secret"), F.lit("0123456789abcdef")), F.lit("0123456789abcdef")).alias("e"), S.sane_name(F.lit("2nd Name!")).alias("s"), S.plain_double(F.lit("1d")).alias("d"),
    ).first()
    assert (row.n, row.f, row.k, row.e, row.s, row.d) == ([-1.5, 20.0], "1.5 KB", "$2.5M", "secret", "col_2nd_name", None)


def test_order_statistics_of_whole_columns(spark):
    rng = random.Random(2)
    values = [rng.choice([rng.gauss(0, 1), 7.0, float(rng.randint(-5, 5)), 1e300]) for _ in range(5000)] + [None, float("nan")]
    df = spark.createDataFrame([(v, 3, None) for v in values], "a double, b int, c double")
    known = sorted(v for v in values if v is not None and v == v)
    for few in (10, 100_000):
        got = ranks.at_ranks(df, {"a": [0, 1, 2499, 2500, 4998, 4999], "b": [17]}, few)
        assert got == {"a": {k: known[k] for k in (0, 1, 2499, 2500, 4998, 4999)}, "b": {17: 3.0}}
    import numpy as np

    q = ranks.quantiles(df, ["a", "b", "c"], [0.25, 0.5, 0.9], few=50)
    assert q["a"] == pytest.approx(np.quantile(known, [0.25, 0.5, 0.9]).tolist()) and q["b"] == [3.0] * 3 and q["c"] == [None] * 3


def test_plans_hold_no_whole_column_in_one_aggregate(spark, testdata):
    """No percentile, median or list over an ungrouped table."""
    for name in ("fill_median", "fill_outlier", "profile_numbers", "agg_median_std", "chart_box", "summary_statistics", "result_summary", "policies"):
        plan = catalogue.QUERIES[name](spark, f"{testdata}/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert not any(f in plan for f in ("percentile(", "median(", "collect_list(")), name


def test_date_shapes(spark):
    texts = ["2024-01-05", "1/5/2024", "31/12/2023", "2024/3/4", "5-1-2024", "January 5, 2024", "5 January 2024", "Jan 5, 2024", "5 Jan 2024", "12345.67", "2024-13-45", "$1,234.00", "soon", "1-2", ""]
    got = [r.d for r in spark.createDataFrame([(t,) for t in texts], "t string").select(S.parse_date(F.col("t")).alias("d")).collect()]
    plain = [r.d for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.coalesce(*[F.try_to_date("t", f) for f in S.DATE_FORMATS]).alias("d")).collect()]
    assert got == plain and sum(d is not None for d in got) == 9


def test_question_rules(spark):
    asked = {
        "what is the total sales": ("AGGREGATION", "SUM"), "where customer_name is 'john smith'": ("FILTERING", None), "compare products": ("COMPARISON", None), "decline of orders": ("TREND", None),
        "the median age": ("AGGREGATION", "MEDIAN"), "standard deviation of age": ("AGGREGATION", "STD"), "breakdown by region": ("DISTRIBUTION", None), "describe it": ("STATISTICAL", None), "hello": ("DESCRIPTIVE", None),
    }
    got = {r.text: (r.question_type, r.aggregation) for r in text.intents(spark.createDataFrame([(t,) for t in asked], "text string")).collect()}
    assert got == asked
    rated = text.weighted_types(spark.createDataFrame([(1, "What is the total sales count?"), (2, "top 5 customers"), (3, "hello there")], "k int, text string"), "k").collect()
    assert {r.k: (r.kind, round(r.score, 6)) for r in rated} == {1: ("AGGREGATION", 0.7), 2: ("RANKING", 0.5), 3: ("DESCRIPTIVE", 0.5)}
    mentioned = spark.createDataFrame([(1, "sales", 0.9), (1, "name", 0.9), (2, "sales", 1.0)], "k int, name string, confidence double")
    targets = text.aggregation_targets(mentioned, spark.createDataFrame([(1, "total sales by name"), (2, "list sales")], "k int, text string"), "k", ["sales"]).collect()
    assert {(r.name, r.confidence) for r in targets} == {("sales", 1.0), ("name", 0.9)}


def test_percentile_rules(spark):
    df = spark.createDataFrame([("a", float(v), v) for v in range(10, 101, 10)], "name string, v double, t int")
    code, test = (logs.percentiles(df, ["name"], "v", ["t"], rule=r).first() for r in ("upper", "lower"))
    assert (code.p50, code.p95, code.p99) == (60, 100, 100) and (test.p50, test.p95, test.p99) == (50, 90, 90)


def test_cells_and_layout(spark):
    box = lambda t, x, y: (1, t, x, y, 40, 10, 0.9)
    words = spark.createDataFrame([box(t, x, y) for y, row in ((10, ("Name", "Age", "City")), (42, ("John", "25", "NYC")), (71, ("Jane", "30", "LA"))) for t, x in zip(row, (10, 110, 210), strict=True)], "page int, text string, x int, y int, width int, height int, confidence double")
    got = layout.grid(layout.to_cells(layout.rows_by_running_mean(words, ["page"]), ["page"], "row_no"), ["page"])
    table = {(r.row_no, r.col_no): r.text for r in got.collect()}
    assert [[table[r, c] for c in range(3)] for r in range(3)] == [["Name", "Age", "City"], ["John", "25", "NYC"], ["Jane", "30", "LA"]]
    rows = [("1O0", "NUMBER", "100"), ("l5", "NUMBER", "15"), ("hello", "TEXT", None), ("S0,000", "NUMBER", "50,000"), ("Sol", "TEXT", None), ("12 34", "NUMBER", "1234"), ("1.234.50", "NUMBER", "1234.50"),
            ("1.234.567", "NUMBER", None), ("a  b ", "TEXT", "a b"), ("$1O 0x", "CURRENCY", "$100"), (" ", "NUMBER", None), ("5", None, None)]
    fixed = spark.createDataFrame(rows, "v string, k string, want string").withColumn("s", cells.suggestion(F.col("v"), F.col("k")))
    assert [(r.v, r.s) for r in fixed.collect()] == [(v, w) for v, _, w in rows]
    # the expression grows with the look-alikes, not as a power of them
    assert len(str(fixed.schema)) < 1000 and len(fixed._jdf.queryExecution().analyzed().toString()) < 5000
    spans = cells.split_span(spark.createDataFrame([(1, "ab cd", 0, 100)], "k int, text string, x int, width int"), "k").orderBy("place").collect()
    assert [r.word for r in spans] == ["ab", "cd"] and spans[1].x >= 50


def _cell_table(spark, headers, rows, name="t"):
    return spark.createDataFrame([(name, i, j, headers[j], v) for i, r in enumerate(rows) for j, v in enumerate(r)], "table_id string, row_no int, col_no int, header string, value string")


def test_table_validation(spark):
    good = _cell_table(spark, ["Name", "Age", "Salary", "Date"], [("John Doe", "25", "$50,000", "2024-01-01"), ("Jane Smith", "30", "$60,000", "2024-01-02"), ("Bob Johnson", "35", "$70,000", "2024-01-03")])
    got = cells.score(good, good.select("table_id").distinct().withColumn("confidence", F.lit(0.85))).first()
    assert got.score == pytest.approx(0.7) and got.valid and got.cell_issues == 3 and not got.structure_issues
    bad = _cell_table(spark, ["Name", "Age", "Age", ""], [("John", "3O", "$50,000", "x"), ("", "", "", ""), ("Jane", "25", "$6O,000", "y"), ("Jane", "25", "$6O,000", "y"), ("Bob", "abc", "70", "z")])
    facts = cells.structure(bad).first()
    assert (facts.duplicate_headers, facts.empty_headers, facts.empty_rows, facts.duplicate_rows, facts.structure_issues, facts.ragged) == (1, 1, 1, 1, 2, False)
    assert not cells.score(bad, bad.select("table_id").distinct().withColumn("confidence", F.lit(0.65))).first().valid
    assert {r.value: r.suggested for r in cells.checks(bad).where("suggested IS NOT NULL").collect()} == {"3O": "30"}
    kinds = {r.col_no: r.data_type for r in cells.column_types(_cell_table(spark, list("abcdefg"), [("1,234", "100 USD", "0.25", "Jan 5, 2024", "y", "5-1-2024", "Sol"), ("-2.5", "€5", "3%", "1/2/2024", "NO", "soon", "O"), ("x", "$7", "4.5%", "2024-01-01", "true", "2024-01-01", "l")])).collect()}
    assert kinds == {0: "NUMBER", 1: "CURRENCY", 2: "PERCENTAGE", 3: "DATE", 4: "BOOLEAN", 5: "DATE", 6: "TEXT"}
    odd = spark.createDataFrame([("l1",), ("OOO",), ("a1b",), ("1a2",), ("$5",), ("plain é",)], "v string").where(cells.suspicious(F.col("v")))
    assert [r.v for r in odd.collect()] == ["l1", "OOO", "a1b", "1a2", "$5"]
    old, new = _cell_table(spark, ["a", "b"], [("1", "2"), ("3", "4")]), _cell_table(spark, ["a", "b"], [("1", "x")])
    assert {(r.row_no, r.col_no, r.change) for r in cells.diff(old, new).collect()} == {(0, 1, "changed"), (1, 0, "removed"), (1, 1, "removed")}
    assert tuple(cells.shapes(old, new).first()) == ("t", 2, 2, 1, 2)


def test_questions(spark):
    df = spark.createDataFrame([(100, "Books"), (200, "Books"), (300, "Toys")], "sales_amount int, category string")
    assert questions.answer(df, "What is the total sales_amount?").first()[0] == 600
    assert questions.answer(df, "distribution of category").count() == 2
    assert [r.sales_amount for r in questions.answer(df, "top 2 by sales_amount").collect()] == [300, 200]
    q = spark.createDataFrame([(1, "where customer_name is 'John Smith'")], "id int, text string")
    r = text.filter_phrases(q, "id").first()
    assert (r.column, r.operator, r.value) == ("customer_name", "is", "John Smith")


def test_rate_limit_and_stream(spark, tmp_path, testdata):
    upload = streams.LIMITS["upload"]
    state = streams.Requests()
    assert [state.decide(100.0 * k, 1, upload)[0] for k in range(13)] == [True] * 12 + [False]  # ten and a burst of two
    state = streams.Requests()
    assert [state.decide(0.1 * k, 1, upload) for k in range(12)][-1] == (True, "ok")
    assert state.decide(1.2, 1, upload) == (False, "blocked") and state.decide(61.1, 1, upload) == (False, "blocked")  # hasty
    assert state.decide(61.3, 1, upload) == (False, "limit") and state.decide(3600.05, 1, upload) == (True, "ok")
    state = streams.Requests()
    assert [state.decide(100.0 * k, 5, upload)[0] for k in range(3)] == [True, True, False]  # cost
    source = spark.read.parquet(f"{testdata}/sf0.001/events.parquet")
    source.coalesce(1).write.parquet(str(tmp_path / "in"))
    for f in (tmp_path / "in").glob("part-*.parquet"):
        f.rename(f.with_name("events-" + f.name))
    live = streams.events(spark, str(tmp_path / "in"))
    run = streams.rate_limited_stream(live, streams.Limit(1)).writeStream.format("memory").queryName("decisions").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    key = ["event_id", "allowed", "reason"]
    assert sorted(map(tuple, spark.table("decisions").select(key).collect())) == sorted(map(tuple, streams.rate_limited(source, streams.Limit(1)).select(key).collect()))
    seen = []
    refresh = streams.Refresher(lambda df, i: seen.append(i))
    a, b = spark.createDataFrame([(1,), (2,), (3,)], "test int"), spark.createDataFrame([(4,), (5,), (6,)], "test int")
    assert [refresh(x, i) for i, x in enumerate((a, a, b, b.toDF("other")))] == [True, False, True, True]
    daily = streams.daily_counts(live, ("event_type",)).writeStream.format("memory").outputMode("complete").queryName("daily").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    daily.awaitTermination(120)
    assert spark.table("daily").agg(F.sum("accesses")).first()[0] == source.count()


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("t0", 1, "x"), ("t1", 2, "y")], "table_id string, n int, s string")
    io.to_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    io.to_json(df, str(tmp_path / "json"), source="test")
    assert spark.read.json(str(tmp_path / "json/manifest")).first().source == "test"
    io.export_tables(df, str(tmp_path / "many"))
    assert {p.name for p in (tmp_path / "many").glob("table_id=*")} == {"table_id=t0", "table_id=t1"}
    (tmp_path / "doc").mkdir()
    (tmp_path / "doc/a.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "doc/b.exe").write_bytes(b"MZ")
    got = {r.filename: (r.is_valid, r.errors) for r in io.admission(io.files(spark, str(tmp_path / "doc"))).collect()}
    assert got["a.pdf"] == (True, []) and "executable" in got["b.exe"][1]
    (tmp_path / "e.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    assert io.json_lines(spark, str(tmp_path / "e.jsonl"), "a int").count() == 2
    with pytest.raises(ValueError):
        io.exportable(df.withColumn("z", F.array("n")), "csv")


def test_plans_have_no_cartesian_products(spark, testdata):
    for name in ("profile_columns", "kpi_compare", "access_decision", "cells_correct"):
        plan = catalogue.QUERIES[name](spark, f"{testdata}/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan


def test_templates(spark):
    assert templates.aggregate(spark.createDataFrame([(1,)], "a int"), columns=[]).first().total_count == 1
    now = spark.createDataFrame([(datetime(2024, 1, 1), 2.0)], "d timestamp, v double")
    assert templates.trend(now, "d", "v").count() == 1


def test_similar_rows_that_start_differently(spark):
    rng = random.Random(5)
    texts = ["old ring|brand#11", "cold ring|brand#11", "bold ring|brand#11", "", "", "ring old|brand#11"]
    for _ in range(60):
        t = "".join(rng.choice("abé ") for _ in range(rng.randint(1, 24)))
        texts += [t, rng.choice("xy") + t, t[1:] + "z"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k long, t string")
    both = df.alias("x").join(df.alias("y"), F.expr("x.k < y.k")).select(F.col("x.k").alias("a"), F.col("y.k").alias("b"), similarity(F.col("x.t"), F.col("y.t")).alias("s"))
    for threshold in (0.6, 0.85, 0.9):
        want = {(r.a, r.b) for r in both.where(F.col("s") >= threshold).collect()}
        assert {(r.a, r.b) for r in dedup.similar_pairs(df, "k", "t", threshold).collect()} == want
    rows = spark.createDataFrame([(0, "old ring"), (1, "cold ring"), (2, "old ring"), (3, "cold ring"), (4, "hot bolt")], "k long, t string")
    assert {r.k for r in dedup.fuzzy(rows, "k", ["t"], 0.9).collect()} == {0, 4}
    values = rows.select("t").distinct()
    assert [r.spellings for r in dedup.similar_values(values, "t", 0.9).collect()] == [["cold ring", "old ring"]]


def test_knn_takes_all_donors_and_ancestry_all_parents(spark):
    rng = random.Random(2)
    rows = [(i, rng.randint(0, 40) / 2, None if i % 5 == 2 else float(rng.randint(0, 99))) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, x double, y double")
    want = {}
    for i, x, y in rows:
        near = sorted((abs(x - b), j, c) for j, b, c in rows if c is not None)[:3]
        want[i] = y if y is not None else sum(c for _, _, c in near) / 3
    got = {r.k: r.y for r in missing.knn_impute(df, "y", ["x"], "k", 3, donors=20).collect()}
    assert got == pytest.approx(want)
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(70)], "version long, parent_version long")
    assert {(r.version, r.depth) for r in schema.ancestry(chain, 69).collect()} == {(69 - d, d) for d in range(70)}


def test_session_rules(spark, testdata, tmp_path):
    hour = 3600.0
    own = streams.Sessions()
    assert own.use(1, 0.0, "a") == ("created", False, 24 * hour, None)
    assert own.use(1, 5 * hour, "b") == ("used", True, 24 * hour, None)
    assert own.use(1, 23.5 * hour, "a") == ("renewed", False, 47.5 * hour, None)
    assert own.use(1, 48 * hour, "a") == ("expired", False, None, None)
    own = streams.Sessions()
    for k in range(5):
        own.use(k, float(k), "a")
    own.use(0, 10.0, "a")
    assert own.use(9, 11.0, "a") == ("created", False, 11.0 + 24 * hour, 1)  # the one used longest ago goes
    # the batch form, the stream and plain loops agree
    made = spark.read.parquet(f"{testdata}/sf0.001/events.parquet").selectExpr("user_id", "event_id", "ts", "user_id * 100 + CAST(datediff(ts, DATE '2024-01-01') AS INT) DIV 2 AS session_id", "concat('10.0.0.', event_id % 3) AS address")
    want, users = [], {}
    for r in sorted(made.collect(), key=lambda r: (r.user_id, r.ts, r.event_id)):
        at = r.ts.timestamp() if r.ts.tzinfo else (r.ts - datetime(1970, 1, 1)).total_seconds()
        want.append((r.event_id, *users.setdefault(r.user_id, streams.Sessions()).use(r.session_id, at, r.address)[:2]))
    key = ["event_id", "outcome", "ip_differs"]
    got = streams.session_log(made).select(key)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    made.coalesce(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(made.schema).parquet(str(tmp_path / "in"))
    run = streams.session_log_stream(live).writeStream.format("memory").queryName("session_uses").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(map(tuple, spark.table("session_uses").select(key).collect())) == sorted(want)


def test_charts_that_suit(spark):
    df = spark.createDataFrame([(f"2024-01-{i % 28 + 1:02d}", "abcde"[i % 5], float(i), i * 7 % 100) for i in range(60)], "day string, kind string, v double, w int")
    roles = {r.name: (r.kind, r.categorical, r.numerical, r.temporal) for r in recommend.column_roles(df).collect()}
    assert roles == {"day": ("date", False, False, True), "kind": ("text", True, False, False), "v": ("number", False, True, False), "w": ("number", False, True, False)}
    configs = recommend.configurations(df)
    assert [c.chart for c in configs] == ["line", "scatter", "bar"]
    assert configs[0] == recommend.ChartConfig("line", "day", "v", aggregation="avg") and configs[1].colour == "kind"
    assert recommend.drawn(df, configs[2]).count() == 5
    one = recommend.recommendations(recommend.column_roles(df.select("v"))).orderBy("place").first()
    assert one.chart == "histogram"
    assert recommend.headline(df).first().quality == 100


def test_header_and_fragment_rules(spark):
    rows = [("a", 0, 0, "Name"), ("a", 0, 1, "77"), ("a", 1, 0, "John"), ("b", 0, 0, "JOHN 12"), ("b", 0, 1, "x9"), ("c", 0, 0, "12"), ("c", 0, 1, ""), ("c", 0, 2, "34")]
    marked = layout.marked_headers(spark.createDataFrame(rows, "page string, row_no int, col_no int, text string"), ["page"])
    assert {(r.page, r.col_no) for r in marked.where("is_header").collect()} == {("a", 0), ("b", 0), ("c", 0), ("c", 2)}
    assert sorted(tuple(r) for r in layout.header_names(marked, ["page"]).collect()) == [("a", 0, "Name"), ("b", 0, "JOHN 12"), ("c", 0, "12"), ("c", 1, "Column_2"), ("c", 2, "34")]
    whole = layout.union_of([spark.createDataFrame([(1, "x")], "id int, name string"), spark.createDataFrame([(2, 3)], "id int, size int")])
    assert sorted(map(tuple, whole.collect())) == [(1, "x", None), (2, None, 3)]


def test_edits_reports_and_exports(spark, tmp_path):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(20)], "place int, v string").repartition(4)
    assert [tuple(r) for r in filters.without_rows(df, "place", [0, 7]).orderBy("place").collect()] == [(k, f"v{i}") for k, i in enumerate(i for i in range(20) if i not in (0, 7))]
    assert filters.with_row(df, {"v": "new"}).where("place IS NULL").first().v == "new"
    with pytest.raises(ValueError):
        filters.renamed(df, {"v": "place"})
    sql = spark.createDataFrame([("SELECT * FROM t;",), ("SELECT * FROM t LIMIT 5",), ("SELECT a FROM t",)], "s string").select(filters.safe_limit(F.col("s")).alias("s"))
    assert [r.s for r in sql.collect()] == ["SELECT * FROM t LIMIT 1000", "SELECT * FROM t LIMIT 5", "SELECT a FROM t"]
    dirty = spark.createDataFrame([(0, "John", "25"), (1, "John", "25"), (2, "name", "age"), (3, "Jon", "25"), (4, "Mary Poppins", "61")], "row_id int, name string, age string")
    clean, log = dedup.pipeline(dirty, "row_id", 0.8)
    assert [r.row_id for r in clean.orderBy("row_id").collect()] == [0, 4]
    assert {r.step: r.removed for r in log.collect()} == {"names": 0, "exact": 1, "headers": 1, "fuzzy": 1}
    out = io.dashboard_json({"kpis": spark.createDataFrame([("a", 1.5)], "kpi_id string, value double"), "charts": spark.createDataFrame([], "x int")}, {"title": "Sales"}).first().json
    assert json.loads(out) == {"config": {"title": "Sales"}, "kpis": [{"kpi_id": "a", "value": 1.5}], "charts": []}
    failed = io.export_skipping({"flat": df, "nested": df.withColumn("a", F.array("v"))}, str(tmp_path), "csv")
    assert list(failed) == ["nested"] and (tmp_path / "table_0_flat.csv").exists()
    filled, report = missing.imputation_report(spark.createDataFrame([(1.0,), (None,), (3.0,)], "v double"), {"v": missing.Policy("mean")})
    r = report.first()
    assert (r.missing_before, r.missing_after, r.imputed, r.rows_removed, r.improvement, r.warning) == (1, 0, 1, 0, 1.0, None) and filled.where("v = 2.0").count() == 1
    kinds = spark.createDataFrame([("unit_price", 5.0), ("success_rate", 50.0), ("share", 0.5), ("size", 9.0)], "n string, m double").select(S.format_kind(F.col("n"), F.col("m")).alias("k"))
    assert [r.k for r in kinds.collect()] == ["currency", "percentage", "percentage", "number"]
    merged = spark.range(1).select(S.merged_maps(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3"))).alias("m")).first().m
    assert merged == {"a": "1", "b": "3"}


def _python_similarity(a, b):
    from difflib import SequenceMatcher

    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    edit = 1 - row[-1] / max(len(a), len(b)) if len(a) <= 50 and len(b) <= 50 else 0.0
    return max(SequenceMatcher(None, a, b).ratio(), edit)


def test_fuzzy_rows_and_values_against_all_pairs(spark):
    rng = random.Random(12)
    base = ["".join(rng.choices("abcdefg ", k=rng.randint(4, 12))).strip() + "x" for _ in range(15)]
    texts = []
    for _ in range(120):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            t[rng.randrange(len(t))] = rng.choice("abcdefghij")
        texts.append("".join(t))
    squeezed = [" ".join(t.lower().split()) for t in texts]
    taken: dict = {}
    for i in range(len(texts)):
        if i not in taken:
            for j in range(i + 1, len(texts)):
                if j not in taken and _python_similarity(squeezed[i], squeezed[j]) >= 0.8:
                    taken[j] = i
    got = dedup.fuzzy(spark.createDataFrame(list(enumerate(texts)), "row_id long, t string"), "row_id", ["t"], 0.8)
    assert {r.row_id for r in got.collect()} == set(range(len(texts))) - set(taken)
    groups = dedup.similar_values(spark.createDataFrame([("New York",), ("new york",), ("New  York ",), ("Boston",), ("Bostom",), ("Lima",)], "city string"), "city", 0.8).collect()
    assert sorted(tuple(sorted(g.spellings)) for g in groups) == [("Bostom", "Boston"), ("New  York ", "New York", "new york")]


def test_spans_entities_and_conditions(spark):
    one = lambda t: spark.createDataFrame([(1, t)], "k int, text string")
    found = {(r.kind, r.value, r.first) for r in privacy.spans(one("call 5551234567 or 555-123-4567, mail a.b@c.org, ssn 123-45-6789"), "k").collect()}
    assert found == {("phone", "5551234567", 5), ("phone", "555-123-4567", 19), ("email", "a.b@c.org", 38), ("ssn", "123-45-6789", 53)}
    question = one("show age > 30 and name = 'Ann' since 2024-01-05")
    spans = text.entities(question, "k")
    assert [(r.kind, r.text) for r in spans.orderBy("first", "kind").collect() if r.kind != "number"] == [("operator", ">"), ("operator", "="), ("quoted", "'Ann'"), ("date", "2024-01-05")]
    named = spark.createDataFrame([(1, "age", 8), (1, "name", 22)], "k int, name string, last int")
    assert {(r.name, r.operator, r.value) for r in text.filter_conditions(spans, named, "k").collect()} == {("age", ">", "30"), ("name", "=", "'Ann'")}
    columns = spark.createDataFrame([("total_price",), ("customer",)], "name string")
    close = {r.name: r.similarity for r in text.fuzzy_columns(one("totl_price of custmer"), columns, "k", "text").collect()}
    assert close.keys() == {"total_price", "customer"} and all(abs(close[n] - _python_similarity(w, n)) < 1e-9 for n, w in (("total_price", "totl_price"), ("customer", "custmer")))


def test_schema_descriptions(spark):
    df = spark.createDataFrame([(i, f"${i}.50", None if i == 3 else "2024-01-05") for i in range(10)], "id int, price string, day string")
    rows = {r.name: r for r in schema.describe(df, order="id").collect()}
    assert (rows["price"].data_type, rows["price"].samples, rows["price"].unique_values) == ("CURRENCY", [f"${i}.50" for i in range(5)], 10)
    assert (rows["day"].data_type, rows["day"].nullable, rows["day"].samples) == ("DATE", True, ["2024-01-05"] * 5)
    said = {r.name: (r.description, r.question) for r in schema.prompt_rows(schema.describe(df, order="id")).collect()}
    assert said["id"] == ("id: number, identifies rows", "What is the total of id?")
    assert said["day"] == ("day: date, may be missing", "How do records change over day?")
