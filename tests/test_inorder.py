"""Streams in the order of event time: several batches, late rows, restarts and states handed over."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import kpi
from tallyloom.streaming import inorder, running, streams

START = datetime(2024, 3, 1)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, ROCKS)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    yield spark
    spark.conf.unset(key)


def batches(spark, folder, schema, parts):
    """Files of the parts, in the order of their names."""
    for k, part in enumerate(parts):
        at = folder / f"part-{k:03d}"
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(at))
        for f in at.glob("part-*.parquet"):
            f.rename(folder / f"{k:03d}.parquet")


def read(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).option("pathGlobFilter", "*.parquet").parquet(str(folder))


def run(df, folder, name, out):
    q = df.writeStream.foreachBatch(lambda d, i: d.write.mode("overwrite").parquet(f"{out}/{i}")).option("checkpointLocation", str(folder / f"check-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None


def results(spark, out, columns):
    return sorted(map(tuple, spark.read.parquet(f"{out}/*").select(columns).collect()))


REQUEST = "user_id long, event_type string, event_id long, ts timestamp"


def requests(seed, n, users=3):
    rng = random.Random(seed)
    return [(rng.randrange(users), rng.choice(["upload", "dashboard"]), k, START + timedelta(seconds=rng.choice([0.3, 40, 900]) + 30 * k)) for k in range(n)]


FLUSH = (99, "api", 10_000, START + timedelta(days=30))


def test_rate_limits(rocks, tmp_path):
    rows = requests(1, 240)
    shuffled = [sorted(rows[k : k + 60], key=lambda r: r[2] * 7 % 11) for k in range(0, 240, 60)]
    limits = {"upload": streams.Limit(3, 3600, 1), "dashboard": streams.Limit(2, 600, 0), "api": streams.Limit(5)}
    (tmp_path / "in").mkdir()
    batches(rocks, tmp_path / "in", REQUEST, [*shuffled[:2]])
    out = str(tmp_path / "out")
    live = lambda: inorder.rate_limited(read(rocks, tmp_path / "in", REQUEST), limits, "20 minutes")
    run(live(), tmp_path, "one", out)
    # a second start goes on from the checkpoint, with what was waiting
    late = (0, "upload", 9_999, START)  # the watermark has passed it
    more = tmp_path / "more"
    more.mkdir()
    batches(rocks, more, REQUEST, [shuffled[2], shuffled[3] + [late], [FLUSH], [(99, "api", 10_001, START + timedelta(days=60))]])
    for f in more.glob("*.parquet"):
        f.rename(tmp_path / "in" / f"9{f.name}")
    run(live(), tmp_path, "one", out)
    columns = ["event_id", "allowed", "reason", "remaining", "reset_at", "retry_after"]
    want = streams.limit_details(rocks.createDataFrame(rows, REQUEST), limits)
    got = [r for r in results(rocks, out, columns) if r[0] < 9_999]
    assert got == sorted(map(tuple, want.select(columns).collect()))
    assert {r[2] for r in got} == {"ok", "limit", "blocked"} or {r[2] for r in got} == {"ok", "limit"}


def test_rate_limits_started(rocks, tmp_path):
    """A stream goes on from the state that a table has left."""
    rows = requests(5, 120)
    limits = {"upload": streams.Limit(4, 7200), "dashboard": streams.Limit(2, 900), "api": streams.Limit(5)}
    before = rocks.createDataFrame(rows[:60], REQUEST)
    states = streams.limit_states(before, limits)
    (tmp_path / "in").mkdir()
    batches(rocks, tmp_path / "in", REQUEST, [rows[60:90], rows[90:], [FLUSH], [(99, "api", 10_001, START + timedelta(days=60))]])
    out = str(tmp_path / "out")
    run(inorder.rate_limited(read(rocks, tmp_path / "in", REQUEST), limits, "20 minutes", states), tmp_path, "two", out)
    whole = streams.rate_limited(rocks.createDataFrame(rows, REQUEST), limits).where("event_id >= 60").select("event_id", "allowed", "reason")
    assert [r for r in results(rocks, out, ["event_id", "allowed", "reason"]) if r[0] < 9_999] == sorted(map(tuple, whole.collect()))


def test_user_statistics(spark):
    at = (START - datetime(1970, 1, 1)).total_seconds()
    rows = [(1, "upload", k, START - timedelta(seconds=s)) for k, s in enumerate([4000, 3000, 20, 10])]
    states = streams.limit_states(spark.createDataFrame(rows, REQUEST))
    got = {r.endpoint: r for r in streams.user_statistics(states, at).collect()}
    assert set(got) == set(streams.LIMITS)
    assert (got["upload"].remaining, got["upload"].reset_at, got["upload"].retry_after) == (7, at + 600, None)
    assert (got["chat"].remaining, got["chat"].reset_at) == (100, at + 3600)
    blocked = spark.createDataFrame([(1, "chat", [at - 1], at - 1, at + 30.5)], streams.STATE)
    assert {r.endpoint: r.retry_after for r in streams.user_statistics(blocked, at).collect()}["chat"] == 30


USE = "user_id long, event_id long, ts timestamp, session_id long, address string, action string"


def test_sessions(rocks, tmp_path):
    rng = random.Random(8)
    rows = []
    for k in range(200):
        action = rng.choices([None, "revoke", "revoke_others"], [20, 2, 1])[0]
        rows.append((rng.randrange(2), k, START + timedelta(minutes=25 * k + rng.randrange(40)), rng.randrange(9), rng.choice(["a", "b"]), action))
    parts = [sorted(rows[k : k + 50], key=lambda r: -r[1]) for k in range(0, 200, 50)]
    (tmp_path / "in").mkdir()
    end = [[(7, 900, START + timedelta(days=60), 1, "a", None)], [(7, 901, START + timedelta(days=120), 1, "a", None)]]
    batches(rocks, tmp_path / "in", USE, [*parts, *end])
    out = str(tmp_path / "out")
    run(inorder.session_log(read(rocks, tmp_path / "in", USE), "2 hours"), tmp_path, "uses", out)
    columns = ["event_id", "outcome", "ip_differs", "expires", "evicted"]
    got = [r for r in results(rocks, out, columns) if r[0] < 900]
    want = sorted(map(tuple, streams.session_log(rocks.createDataFrame(rows, USE)).select(columns).collect()))
    assert got == want
    assert {"created", "used", "renewed", "expired", "revoked", "refused"} <= {r[1] for r in want} | {"renewed", "expired"}


def test_revocation():
    own = streams.Sessions()
    for k in range(3):
        own.act(None, k, float(k), "a")
    assert own.act("revoke", 1, 5.0, "a")[0] == "revoked" and own.act(None, 1, 6.0, "a")[0] == "refused"
    assert own.act("revoke", 1, 7.0, "a")[0] == "unknown"
    assert own.act("revoke_others", 2, 8.0, "a")[0] == "revoked" and list(own.held) == [2]
    assert own.act(None, 1, 90_000.0, "a")[0] == "created"  # after the end that it would have had


VALUE = "kpi_id string, event_id long, ts timestamp, value double"


def test_kpi_trends(rocks, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice(["up", "down", "wild"]), k, START + timedelta(hours=k), 0.0) for k in range(180)]
    rows = [(n, k, t, {"up": 100.0 + k, "down": 500.0 - k, "wild": rng.uniform(-100, 100)}[n]) for n, k, t, _ in rows]
    parts = [sorted(rows[k : k + 45], key=lambda r: r[1] * 5 % 7) for k in range(0, 180, 45)]
    (tmp_path / "in").mkdir()
    batches(rocks, tmp_path / "in", VALUE, [*parts[:2], *parts[2:], [("end", 900, START + timedelta(days=40), 1.0)], [("end", 901, START + timedelta(days=300), 1.0)]])
    out = str(tmp_path / "out")
    run(inorder.kpi_trends(read(rocks, tmp_path / "in", VALUE), "3 hours"), tmp_path, "trend", out)
    columns = ["event_id", "points", "change", "percent", "volatility", "strength", "direction"]
    plain = lambda rows: [tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows]
    got = plain(r for r in results(rocks, out, columns) if r[0] < 900)
    want = kpi.rolling_trend(rocks.createDataFrame(rows, VALUE), ["kpi_id"], ["ts", "event_id"], "value")
    assert got == plain(sorted(map(tuple, want.select(columns).collect())))
    assert max(r[1] for r in got) == inorder.KEPT and {"UP", "DOWN", "VOLATILE"} <= {r[6] for r in got}
    # the trend of the last ten as the whole-series operator has it
    last = [(n, *[v for m, _, _, v in rows if m == n][-10:]) for n in ("up", "down")]
    for n, *vs in last:
        series = rocks.createDataFrame([(n, i, v) for i, v in enumerate(vs)], "k string, i int, v double")
        t = kpi.trends(series, ["k"], "i", "v").first()
        mine = [r for r in want.where(F.col("kpi_id") == n).orderBy(F.desc("event_id")).limit(1).collect()][0]
        assert (round(t.change, 6), round(t.percent, 6), round(t.strength, 6), t.direction) == (round(mine.change, 6), round(mine.percent, 6), round(mine.strength, 6), mine.direction)


def _all_kpis(df, numbers, kinds, date):
    rows = [(r.kpi_id, None, r.value) for r in kpi.numeric_kpis(df, numbers).collect()]
    rows += [(r.kpi_id, r.label, r.value) for r in kpi.categorical_kpis(df, kinds).collect()]
    rows += [(r.kpi_id, None, r.value) for r in [*kpi.time_kpis(df, date).collect(), *kpi.quality_kpis(df).collect()]]
    return sorted((k, str(label), round(v, 6)) for k, label, v in rows)


def test_running_kpis(spark, tmp_path, testdata):
    """After every batch the merged KPIs equal those over all rows so far; a batch that comes again counts once."""
    orders = spark.read.parquet(f"{testdata}/sf0.001/orders.parquet").select("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", "o_orderkey")
    orders = orders.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice"))).withColumn("late", -F.col("o_orderkey") % 4)
    orders = orders.drop("o_orderkey").withColumn("o_custkey", F.col("o_custkey") % 40).cache()
    numbers, kinds = ["o_totalprice", "o_custkey", "late"], ["o_orderstatus", "o_orderpriority", "o_custkey"]
    own = running.RunningKpis(spark, str(tmp_path / "kpis"), numbers, kinds, "o_orderdate")
    parts = [orders.where(F.pmod(F.xxhash64("o_totalprice", "o_orderdate"), F.lit(3)) == k) for k in range(3)]
    so_far = orders.limit(0)
    for k, part in enumerate(parts):
        own.update(part, k)
        own.update(part, k)
        so_far = so_far.unionByName(part)
        assert sorted((r.kpi_id, str(r.label), round(r.value, 6)) for r in own.kpis().collect()) == _all_kpis(so_far, numbers, kinds, "o_orderdate")
    # repeated rows across batches count as duplicates
    own.update(parts[0], 3)
    got = {r.kpi_id: r.value for r in own.kpis().collect()}
    assert got["duplicate_rate"] > 10 and got["total_records"] == orders.count() + parts[0].count()


def test_running_kpis_of_a_stream(spark, tmp_path):
    schema = "kind string, n double, at timestamp"
    rows = [("ab"[k % 2], float(k), START + timedelta(hours=7 * k)) for k in range(90)]
    (tmp_path / "in").mkdir()
    batches(spark, tmp_path / "in", schema, [rows[:30], rows[30:60], rows[60:]])
    own = running.RunningKpis(spark, str(tmp_path / "kpis"), ["n"], ["kind"], "at")
    for _ in range(2):  # a second start finds nothing new
        q = read(spark, tmp_path / "in", schema).writeStream.foreachBatch(own.update).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(300)
    assert own.store.version() == 3
    got = sorted((r.kpi_id, str(r.label), round(r.value, 6)) for r in own.kpis().collect())
    assert got == _all_kpis(spark.createDataFrame(rows, schema), ["n"], ["kind"], "at")
