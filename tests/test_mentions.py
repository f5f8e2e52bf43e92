"""Column names in texts, and events to dashboards, against loops over all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.functions.similarity import similarity
from tallyloom.operators import mentions, text
from tallyloom.streaming import streams


@pytest.fixture(scope="module")
def asked(spark):
    """A thousand names, some inside others, and texts that name them in both forms, twice, overlapping, or by words."""
    rng = random.Random(6)
    words = ["order", "total", "price", "cust", "key", "day", "é", "net", "a", "of"]
    names = sorted({"_".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(3000)})[:1000]
    texts = []
    for _ in range(120):
        parts = [rng.choice([rng.choice(names), rng.choice(names).replace("_", " "), rng.choice(words).upper(), "the"]) for _ in range(rng.randint(0, 7))]
        texts.append(rng.choice([" ", "", ", "]).join(parts))
    rows = [*enumerate(texts), (500, None), (501, ""), (502, "Order_Total order total")]
    return names, rows, spark.createDataFrame([(n,) for n in [*names, None, ""]], "name string"), spark.createDataFrame(rows, "k int, text string")


def all_places(names, low):
    out = []
    for n in names:
        for form, c in {n: 1.0, n.replace("_", " "): 0.9 if "_" in n else 1.0}.items():
            at = low.find(form)
            while at >= 0:
                out.append((n, c, at, at + len(form)))
                at = low.find(form, at + 1)
    return out


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_places_of_names(asked, most):
    names, rows, columns, questions = asked
    want = sorted((k, *p) for k, t in rows for p in all_places(names, (t or "").lower()))
    got = mentions.occurrences(questions, columns, "k", most_bytes=most)
    assert sorted(map(tuple, got.select("k", "name", "confidence", "first", "last").collect())) == want


def test_spans_do_not_overlap(asked):
    names, rows, columns, questions = asked
    want = []
    for k, t in rows:
        kept = []
        for n, c, a, b in sorted(all_places(names, (t or "").lower()), key=lambda p: (p[2] - p[3], p[2], -p[1], p[0])):
            if all(b <= x[2] or a >= x[3] for x in kept):
                kept.append((n, c, a, b))
        want += [(k, "column", t.lower()[a:b], n, a, b, c) for n, c, a, b in kept]
    got = mentions.spans(questions, columns, "k").select("k", "kind", "text", "name", "first", "last", "confidence")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert {r.kind for r in text.entities(questions, "k", columns=columns).collect()} == {"column"}


def test_mentions_by_words(asked, spark):
    names, rows, columns, questions = asked
    want = {}
    for k, t in rows:
        low = (t or "").lower()
        said = set("".join(c if c.isascii() and (c.isalnum() or c == " ") else " " for c in low).split(" "))
        for n in names:
            parts = set(n.split("_"))
            share = len(parts & said) / len(parts)
            c = 1.0 if n in low else 0.9 if n.replace("_", " ") in low else 0.7 * share if share >= 0.5 else None
            if c and t is not None:
                want[k, n] = round(c, 6)
    got = text.mentions(questions, columns, "k")
    assert {(r.k, r.name): round(r.confidence, 6) for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_alike_words(spark):
    rng = random.Random(2)
    names = ["total_price", "customer", "order_date", "x", "quantity", "Region"]
    letters = "aeorticdnu_"
    said = [" ".join(rng.choice(names).lower()[rng.randrange(2) :] + "".join(rng.choices(letters, k=rng.randrange(3))) for _ in range(4)) for _ in range(40)]
    questions = spark.createDataFrame([*enumerate(said), (99, None)], "k int, t string")
    columns = spark.createDataFrame([(n,) for n in names], "name string")
    words = questions.select("k", F.explode(F.split(F.lower("t"), "[^a-z0-9_]+")).alias("w")).where(F.length("w") > 2)
    every = words.crossJoin(columns).select("k", "name", similarity(F.col("w"), F.lower("name")).alias("s")).where("s >= 0.6").groupBy("k", "name").agg(F.max("s"))
    assert sorted(map(tuple, mentions.alike(questions, columns, "k", "t").collect())) == sorted(map(tuple, every.collect()))


def test_boards(spark, tmp_path):
    """The equi-joins equal the condition over all pairs, each pair once, and a stream of events comes to the same."""
    rng = random.Random(1)
    boards, kinds = [None, "", "a", "b", "open board"], ["x", "y", "z"]
    events = [(k, rng.choice(kinds), rng.choice(boards)) for k in range(80)] + [(80, None, "a"), (81, None, None)]
    subs = [(f"s{k}", rng.choice([[], None, ["x"], ["x", "y", "x"]]), rng.choice(boards)) for k in range(25)]
    e = spark.createDataFrame(events, "event_id int, event_type string, dashboard_id string")
    s = spark.createDataFrame(subs, "subscriber string, types array<string>, dashboard_id string")
    want = sorted((i, n) for i, k, b in events for n, ks, c in subs if (not ks or k in ks) and (not b or not c or b == c))
    got = streams.routed_boards(e, s)
    assert sorted(map(tuple, got.select("event_id", "subscriber").collect())) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    e.write.parquet(str(tmp_path / "in"))
    q = streams.routed_boards(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), s).writeStream.format("memory").queryName("boards").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("boards").select("event_id", "subscriber").collect())) == want


def test_table_functions(spark):
    """From SQL the same as from DataFrames."""
    from tallyloom.operators import layout, privacy
    from tallyloom.plans import table_functions

    table_functions.register(spark)
    said = spark.createDataFrame([(1, "mail a.b@c.org or call 555-123-4567, age > 30 and name = 'Ann' since 2024-01-05"), (2, None), (3, "")], "k int, text string")
    said.createOrReplaceTempView("said")
    hits = spark.sql("SELECT s.k, h.* FROM said s, LATERAL pii_hits(s.text) h")
    assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, privacy.spans(said, "k").collect()))
    found = spark.sql("SELECT s.k, e.* FROM said s, LATERAL entities(s.text) e")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, text.entities(said, "k").collect()))
    rng = random.Random(4)
    words = [(page, rng.randrange(0, 400, 7), rng.randrange(0, 300, 3), rng.randrange(5, 60), f"w{i}", rng.random()) for page in range(5) for i in range(60)]
    words = [tuple(w) for w in {(w[0], w[1], w[2]): w for w in words}.values()]
    frame = spark.createDataFrame(words, "page long, x int, y int, width int, text string, confidence double")
    frame.createOrReplaceTempView("page_words")
    cells = spark.sql("SELECT * FROM page_cells(TABLE(SELECT * FROM page_words) PARTITION BY page)")
    want = layout.to_cells(layout.rows_by_running_mean(frame, ["page"]), ["page"], "row_no")
    plain = lambda df: sorted((r.page, r.row_no, r.col_no, r.text, round(r.confidence, 6)) for r in df.collect())
    assert plain(cells) == plain(want)
