"""Commits of several tables, schema versions, the audit log and row numbers."""

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import filters, logs
from tallyloom.sources import commits


@pytest.fixture
def store(spark, tmp_path):
    return commits.Store(spark, str(tmp_path / "store"))


def rows(spark, n, **extra):
    return spark.range(n).select("id", *[F.lit(v).alias(k) for k, v in extra.items()])


def test_commit_is_whole(spark, store):
    assert store.version() == 0 and store.manifests().count() == 0
    with pytest.raises(ValueError):
        store.read("documents")
    store.commit("one", {"documents": rows(spark, 3), "tables": rows(spark, 5)})
    broken = rows(spark, 4).select("id", F.assert_true(F.col("id") < 2).alias("x"))  # fails while its table is written
    with pytest.raises(Exception, match="is not true"):
        store.commit("two", {"documents": rows(spark, 7), "tables": broken})
    assert store.version() == 1 and store.read("documents").count() == 3 and store.read("tables").count() == 5
    assert len(store.orphans()) == 2
    # the retry leaves one copy, and so does a batch that comes again
    for _ in range(2):
        assert store.commit("two", {"documents": rows(spark, 7), "tables": rows(spark, 4)}) == 2
    assert store.read("documents").count() == 10 and store.read("tables").count() == 9
    assert store.read("documents", 1).count() == 3
    assert store.clean() == 2 and store.orphans() == [] and store.read("documents").count() == 10


def test_commit_race(spark, store):
    """Two writers that have seen the same version: one is refused, and without ``seen`` both come in."""
    seen = store.version()
    other = commits.Store(spark, store.root)
    assert other.commit("theirs", {"t": rows(spark, 1)}, seen) == 1
    with pytest.raises(commits.Clash):
        store.commit("ours", {"t": rows(spark, 2)}, seen)
    assert store.commit("ours", {"t": rows(spark, 2)}) == 2 and store.read("t").count() == 3
    assert not store._publish(2, {"batch": "late", "tables": []})  # a place that is taken stays as it is
    assert {r["batch"] for r in store.manifests().collect()} == {"theirs", "ours"}


def test_commit_widens(spark, store):
    store.commit("a", {"t": rows(spark, 2)})
    store.commit("b", {"t": rows(spark, 1, note="x")})
    assert sorted(map(str, (r["note"] for r in store.read("t").collect()))) == ["None", "None", "x"]


FIELDS = "name string, data_type string, nullable boolean, unique_values long"


def test_versions(spark, store):
    one = spark.createDataFrame([("id", "NUMBER", False, 5), ("when", "DATE", True, 3)], FIELDS)
    two = spark.createDataFrame([("id", "NUMBER", False, 5), ("when", "TEXT", True, 3), ("tag", "TEXT", True, 1)], FIELDS)
    at = F.lit("2024-05-01 10:00:00").cast("timestamp")
    first = commits.create_version(store, "orders", one, at, "b1")
    assert first.startswith("v20240501_100000_000000_") and commits.latest_version(store, "orders")["parent_version"] is None
    raced = []

    def other_writer():
        if not raced:
            raced.append(commits.create_version(commits.Store(spark, store.root), "orders", one, F.lit("2024-05-02 00:00:00").cast("timestamp"), "b2"))

    second = commits.create_version(store, "orders", two, F.lit("2024-05-02 00:00:01").cast("timestamp"), "b3", before_commit=other_writer)
    history = {r["version"]: r for r in commits.version_history(store).collect()}
    assert len(history) == 3 and [v for v, r in history.items() if r["active"]] == [second]
    assert history[second]["parent_version"] == raced[0] and history[raced[0]]["parent_version"] == first
    assert [history[v]["number"] for v in (first, raced[0], second)] == [1, 2, 3]
    changes = {(r["name"], r["change"]) for r in store.read("version_changes").where(F.col("version") == second).collect()}
    assert changes == {("tag", "ADDED"), ("when", "TYPE_CHANGED")}
    with pytest.raises(ValueError, match="duplicate"):
        commits.create_version(store, "orders", one.unionByName(one), at, "b4")
    # the same content at the same instant still gets a name of its own
    again = commits.create_version(store, "orders", two, F.lit("2024-05-02 00:00:01").cast("timestamp"), "b5")
    assert again == f"{second}_3"


def test_audit(spark, store):
    events = spark.createDataFrame([(1, "user_deleted", "u1"), (2, "login_success", None), (3, "other", "u2")], "event_id long, event_type string, user_id string")
    for _ in range(2):
        commits.log_events(store, events, "batch-0")
    commits.log_events(store, events.withColumn("event_id", F.col("event_id") + 3), "batch-1")
    kept = commits.audit(store)
    assert kept.count() == 6 and {r["risk_level"] for r in kept.where("event_id IN (1, 4)").collect()} == {"high"}
    assert tuple(logs.integrity(kept).first()) == (6, 0, 100.0)
    assert logs.integrity(kept.withColumn("user_id", F.when(F.col("event_id") != 4, F.col("user_id")))).first()["mismatches"] == 1


@pytest.mark.parametrize("rows_, factor", [(1_000_000, 1), (50_000, 97), (1, 5)])
def test_row_numbers(spark, rows_, factor):
    df = spark.range(rows_).select((F.col("id") * factor).alias("place"), F.col("id").alias("was")).repartition(13)
    got = filters.without_rows(df, "place", [0, 7 * factor, 11 * factor])
    facts = got.agg(F.count("*").alias("n"), F.countDistinct("place").alias("d"), F.min("place").alias("lo"), F.max("place").alias("hi")).first()
    left = rows_ - len([k for k in (0, 7, 11) if k < rows_])
    assert facts["n"] == facts["d"] == left and (left == 0 or (facts["lo"], facts["hi"]) == (0, left - 1))
    wrong = got.where(F.col("place") != F.col("was") - 1 - (F.col("was") > 7).cast("int") - (F.col("was") > 11).cast("int"))
    assert wrong.count() == 0


def test_row_numbers_odd(spark):
    df = spark.createDataFrame([(3, "a"), (3, "b"), (None, "c"), (-5, "d")], "place long, v string")
    got = {r["v"]: r["place"] for r in filters.without_rows(df, "place", []).collect()}
    assert got["d"] == 0 and {got["a"], got["b"]} == {1, 2} and got["c"] == 3
    assert filters.without_rows(df.limit(0), "place", [1]).count() == 0
