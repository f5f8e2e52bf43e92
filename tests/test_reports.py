"""Small fixtures of reports, alerts, layout edges, replacements and steps of imputation."""

import datetime as dt
import hashlib

from pyspark.sql import functions as F

from tallyloom.operators import filters, layout, logs, missing, privacy, text
from tallyloom.streaming import streams

NONE = None


def test_health_and_alerts(spark):
    rows = [(i, dt.datetime(2024, 1, 1, 0, i), s) for i, s in enumerate(["done", "failed", "pending", "failed", "failed"])]
    df = spark.createDataFrame(rows, "id int, at timestamp, status string")
    row = logs.status_health(df, "status", "at", "id", "pending", "failed", 2).first()
    assert (row["total"], row["pending"], row["failed"], row["error_rate"], row["n_recent"]) == (5, 1, 3, 60.0, 2)
    assert [e["key"] for e in row["recent_errors"]] == [4, 3]
    row = logs.status_health(df.limit(0), "status", "at", "id", "pending", "failed").first()
    assert (row["total"], row["error_rate"], row["recent_errors"]) == (0, 0.0, [])

    audit = spark.createDataFrame([(1, "u", "low", "success"), (2, NONE, "high", "success"), (3, "u", NONE, "error"), (4, "w", NONE, NONE)], "id int, who string, risk string, result string")
    assert logs.audit_summary(audit, "who", "risk", "result").first()[:] == (4, 2, 2)
    assert [r["id"] for r in logs.security_alerts(audit, "risk", "result", "id", "id", 50).collect()] == [3, 2]

    levels = spark.createDataFrame([("m", 1.0, 2.0, 8.0, 9.0)], "name string, critical_low double, warning_low double, warning_high double, critical_high double")
    values = spark.createDataFrame([("m", v) for v in (1.0, 2.0, 5.0, 8.0, 9.5, NONE)] + [("other", 0.0), (NONE, 0.0)], "metric string, v double")
    got = {(r["metric"], r["v"]): r["severity"] for r in streams.threshold_alerts(values, levels, "metric", "v").collect()}
    assert got == {("m", 1.0): "critical", ("m", 2.0): "warning", ("m", 8.0): "warning", ("m", 9.5): "critical"}


def test_guarded_links(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    links = spark.createDataFrame([("a", True, NONE, 2, sha("k")), ("b", True, NONE, 0, NONE), ("c", False, NONE, NONE, NONE)], "share string, active boolean, expires_at timestamp, max_access int, password_hash string")
    asked = [("a", "no"), ("a", "k"), ("a", NONE), ("a", "k"), ("a", "k"), ("a", "no"), ("b", NONE), ("b", "x"), ("c", NONE), ("d", NONE)]
    requests = spark.createDataFrame([(i, s, dt.datetime(2024, 1, 1, 0, i), p) for i, (s, p) in enumerate(asked)], "id int, share string, at timestamp, password string")
    got = [r["reason"] for r in logs.guarded_decisions(requests, links, "share", "at", "id").orderBy("id").collect()]
    assert got == ["wrong password", "granted", "wrong password", "granted", "limit reached", "limit reached", "granted", "granted", "inactive", "unknown"]


def test_privacy_and_sessions(spark):
    day = dt.date(2024, 6, 1)
    rows = spark.createDataFrame([(True, True, day, "short"), (True, False, NONE, "permanent"), (False, False, dt.date(2024, 1, 1), "short")], "has_pii boolean, encrypted boolean, expires_on date, retention string")
    assert privacy.compliance(rows, F.lit(day)).first()[:] == (3, 2, 1, 1, 50.0, True)
    assert privacy.compliance(rows.limit(0), F.lit(day)).first()[:] == (0, 0, 0, 0, 100.0, False)
    assert {r[0]: r[1] for r in privacy.retention_counts(rows).collect()} == {"short": 2, "medium": 0, "long": 0, "permanent": 1}

    ends = spark.createDataFrame([("u", "1", 5, True), ("u", "2", 4, True), ("w", "2", 9, False), ("w", "2", 3, True)], "who string, ip string, ends int, open boolean")
    assert logs.session_addresses(ends, "who", "ip", "ends", F.lit(4), "open").first()[:] == (4, 2, 1, 2)

    said = spark.createDataFrame([(1, t, f"q{t}", c) for t, c in ((1, 0.5), (2, NONE), (3, 1.0))] + [(2, 1, "only", NONE)], "conv int, turn int, text string, sure double")
    got = {r["conv"]: (r["interactions"], r["recent"], r["confidence"]) for r in text.conversation_summary(said, "conv", "turn", "text", "sure", 2).collect()}
    assert got == {1: (3, ["q2", "q3"], 0.75), 2: (1, ["only"], 0.0)}


def test_edges_and_blocks(spark):
    words = spark.createDataFrame([(1, x, 0, w, 5) for x, w in ((0, 40), (29, 5), (29, 5), (100, 80), (200, 5))] + [(2, 7, 0, 9, 5)], "page int, x int, y int, width int, height int")
    got = {}
    for r in layout.column_edges(words, ["page"]).orderBy("page", "col_no").collect():
        got.setdefault(r["page"], []).append(r["bound"])
    assert got == {1: [0, 19, 100, 200], 2: [7]}  # the ends at 205 and 16 are within the edge of the last bound

    blocks = spark.createDataFrame([(1, x, y, 10, 5) for x, y in ((0, 0), (50, 15), (0, 100), (60, 100), (500, 300))] + [(2, x, 0, 10, 5) for x in range(5)] + [(3, 0, y, 10, 5) for y in (0, 100, 200, 300)], "page int, x int, y int, width int, height int")
    assert [r[:] for r in layout.block_tables(blocks, ["page"]).collect()] == [(1, 0, 0, 70, 105, 2, 4)]


def test_replace_matched(spark):
    df = spark.createDataFrame([("a1b22",), ("none",), (NONE,), ("1$",)], "t string")
    out = filters.replace_matched(df, "t", r"\d+", r"$0\1")
    assert [r[:] for r in out.collect()] == [(r"a$0\1b$0\1", True), ("none", False), (NONE, False), (r"$0\1$", True)]
    assert filters.replaced_rows(out).first()[:] == (4, 2)
    assert [r["t"] for r in filters.replace_matched(df, "t", r"^a", "-", literal="1").collect()] == ["a-b22", "none", NONE, "1$"]


def test_steps_of_imputation(spark):
    df = spark.createDataFrame([(0, 1.0, NONE, 5.0), (1, NONE, "x", NONE), (2, 9.0, "x", NONE), (3, NONE, "y", 6.0), (4, 25.0, NONE, NONE)], "t int, v double, s string, w double")
    steps = {"v": missing.Policy("polynomial", order=("t",)), "s": missing.Policy("remove"), "w": missing.Policy("mean", threshold=0.9)}
    filled, report = missing.imputation_report(df, steps)
    got = {r["name"]: r[1:7] for r in report.collect()}
    assert got["v"] == ("polynomial", 2, 0, 0, 2, 1.0)
    assert got["s"] == ("remove", 2, 0, 2, 0, 1.0)
    assert got["w"] == ("mean", 2, 0, 0, 2, 1.0)
    assert [(r["t"], r["w"]) for r in filled.orderBy("t").collect()] == [(1, 6.0), (2, 6.0), (3, 6.0)]
    with_knn = missing.apply_policies(df.drop("s"), {"v": missing.Policy("knn", others=("t",), key="t", neighbours=1)})
    assert with_knn.where("v IS NULL").count() == 0
