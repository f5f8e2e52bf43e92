"""Steps whose work must grow no faster than their input."""

import re

import pyarrow as pa

from tallyloom.operators import missing, privacy, profile, schema, text, types


def plan(df) -> str:
    return df._jdf.queryExecution().toString().lower()


def test_backward_fills_read_each_row_once(spark):
    rows = [(i, i % 3, float(i) if i % 4 == 0 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "i long, k long, v double")
    for keys in ([], ["k"]):
        out = missing.fill_backward(df, "v", ["i"], keys)
        assert "unboundedfollowing" not in plan(out)
        want = {}
        for i, k, _ in rows:
            want[i] = next((v for j, l, v in rows[i:] if v is not None and (not keys or l == k)), None)
        assert {r["i"]: r["v"] for r in out.collect()} == want
    for fill in (missing.interpolate, missing.interpolate_quadratic):
        assert "unboundedfollowing" not in plan(fill(df, "v", ["i"], ["k"]))
    nulls = spark.createDataFrame([(None, 1.0), (1, None), (2, 3.0)], "i long, v double")
    assert [r["v"] for r in missing.fill_backward(nulls, "v", ["i"], []).orderBy("i").collect()] == [1.0, 3.0, 3.0]


def test_types_of_a_profile_from_one_row_each(spark):
    rows = [("yes", "Yes", "t", "1000", None), ("no", "yes", "f", "2000", None), ("YES", "on", "true", "x", None), (None, "off", "F", "3000", None)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string")
    out = types.profile_type(df, df.columns)
    assert "expand" not in plan(out)  # a row for each column, each with a distinct count
    assert {r["name"]: r["data_type"] for r in out.collect()} == {"a": "BOOLEAN", "b": "TEXT", "c": "TEXT", "d": "TEXT", "e": "TEXT"}


def test_samples_are_not_sorted_whole(spark):
    df = spark.createDataFrame([(i // 3, str(9 - i % 3), None if i < 50 else i) for i in range(99, -1, -1)], "o long, a string, b int")
    out = schema.describe(df, ["a", "b"], 4, "o")
    assert "row_number" not in plan(out) and "takeorderedandproject" in plan(out)
    assert {r["name"]: r["samples"] for r in out.collect()} == {"a": ["7", "8", "9", "7"], "b": ["50", "51", "52", "53"]}


def test_descriptors_need_no_distinct_values(spark):
    df = spark.createDataFrame([(i, None if i % 10 == 0 else str(i), "x") for i in range(100)], "a long, b string, c string")
    out = schema.descriptor(df)
    assert "unique_values" not in plan(out)
    whole = profile.columns(df).join(types.profile_type(df, df.columns), "name")
    assert sorted(map(tuple, out.select("name", "nullable", "data_type").collect())) == sorted(map(tuple, whole.select("name", "nullable", "data_type").collect()))
    assert profile.nullability(df.limit(0), ["a"]).first()["nullable"] is False


def test_question_scores_stay_small(spark):
    asked = ["What is the total sum", "show all where x", "a VS b, b vs c", "growth over time\nchange and over", "top 5 and bottom 3", "", None, "how is it distributed", "daily", " describe it "]
    df = spark.createDataFrame(list(enumerate(asked)), "id int, text string")
    out = text.weighted_types(df, "id")
    assert len(re.findall("contains", plan(out).split("== physical plan ==")[1])) < 40  # a method for each test is too long to be compiled
    for r in out.collect():
        t = (asked[r["id"]] or "").strip(" ").lower()
        scores = []
        for kind, words, patterns in text.WEIGHTED:
            scores.append((round(min(0.6, sum(w in t for w in words) * 0.2) + min(0.4, sum(bool(re.search(p, t)) for p in patterns) * 0.3), 6), kind))
        best = max(s for s, _ in scores)
        if asked[r["id"]] is not None:
            assert (r["kind"], r["score"]) == (("DESCRIPTIVE", 0.5) if best < 0.3 else (next(k for s, k in scores if s == best), best))


def test_hits_leave_in_small_batches(spark):
    texts = ["call 555-123-4567 or mail a.b@example.com, é 10.0.0.1 " * 1500, None, "", "John Smith 123-45-6789"]
    batch = pa.RecordBatch.from_arrays([pa.array([7, None, 8, 9]), pa.array(texts)], names=["key", "text"])
    out = list(privacy._hits(iter([batch])))
    assert len(out) > 1 and max(b.num_rows for b in out) <= privacy.HITS_AT_ONCE
    df = spark.createDataFrame(list(zip([7, None, 8, 9], texts, strict=True)), "doc_id long, text string")
    got = privacy.spans(df, "doc_id")
    assert got.columns == ["doc_id", "kind", "value", "first", "last", "confidence"]
    want = [(d, k, m.group(), m.start(), m.end(), c) for d, t in zip([7, None, 8, 9], texts, strict=True) for k, p, c in privacy.PATTERNS for m in re.finditer(p, t or "")]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
