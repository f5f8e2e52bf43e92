"""Event, metric, audit, session and sharing logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks


def percentiles(df: DataFrame, keys: list[str], value: str, order: list[str], shares=(0.5, 0.95, 0.99), keep: int = 1000, rule: str = "upper") -> DataFrame:
    """count, min, max, avg and ranks ``sorted[int(n * p)]`` of the latest ``keep`` values of each key.

    rule "lower": ``sorted[int((n - 1) * p)]``.
    """
    w = Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order])
    recent = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep)
    facts = recent.groupBy(*keys).agg(F.count(value).alias("count"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("avg"), F.sort_array(F.collect_list(value)).alias("_v"))
    n = F.size("_v") - (1 if rule == "lower" else 0)
    return facts.select(*keys, "count", "min", "max", "avg", *[F.get("_v", F.least(F.floor(n * p).cast("int"), F.size("_v") - 1)).alias(f"p{round(p * 100)}") for p in shares])


def counters(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(value).alias("total"))


def gauges(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias("last"))


def metric_summary(df: DataFrame, names: DataFrame, name: str, value: str, ts: str, since: Column) -> DataFrame:
    """count, avg, min, max and latest since a time for every name asked for; zeros where there is none."""
    facts = df.where(F.col(ts) >= since).groupBy(name).agg(F.count("*").alias("count"), F.avg(value).alias("avg"), F.min(value).alias("min"), F.max(value).alias("max"), F.max_by(value, ts).alias("latest"))
    return names.join(facts, name, "left").na.fill(0)


def health(df: DataFrame, status: str, bad: str) -> DataFrame:
    """total, failed and error_rate %: one row."""
    return df.agg(F.count("*").alias("total"), F.count_if(F.col(status) == bad).alias("failed")).withColumn("error_rate", F.col("failed") * 100.0 / F.greatest("total", F.lit(1)))


def status_health(df: DataFrame, status: str, ts: str, key: str, pending: str, failed: str, n: int = 10) -> DataFrame:
    """total, pending, failed, error_rate %, and the latest ``n`` failures (key, ts), newest first: one row."""
    facts = df.agg(F.count("*").alias("total"), F.count_if(F.col(status) == pending).alias("pending"), F.count_if(F.col(status) == failed).alias("failed"))
    latest = df.where(F.col(status) == failed).orderBy(F.desc(ts), F.desc(key)).limit(n)
    errors = latest.agg(F.reverse(F.array_sort(F.collect_list(F.struct(F.col(ts).alias("ts"), F.col(key).alias("key"))))).alias("recent_errors"))  # n at most
    return facts.withColumn("error_rate", F.col("failed") * 100.0 / F.greatest("total", F.lit(1))).crossJoin(F.broadcast(errors)).withColumn("n_recent", F.size("recent_errors"))


def error_statistics(df: DataFrame, keys: list[str], n: int = 10) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("errors")).orderBy(F.desc("errors"), *keys).limit(n)


# The risk of an event by its type; low for all others.
RISKS = {
    "login_failed": "medium", "account_locked": "high", "access_denied": "medium", "data_deleted": "high", "data_exported": "medium", "permission_changed": "high",
    "config_changed": "high", "error_occurred": "medium", "api_key_created": "medium", "user_created": "medium", "user_deleted": "high",
    "login_success": "low", "data_accessed": "low", "data_created": "low", "data_modified": "medium", "session_created": "low",
}


def risk_level(kind: str = "event_type", risks: dict[str, str] = RISKS) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in risks.items() for x in kv])[F.col(kind)], F.lit("low"))


def audit_counts(df: DataFrame, kind: str, risk: str, result: str) -> DataFrame:
    """Counts by type, by risk and by result, from one pass over grouping sets."""
    sets = df.groupingSets([[F.col(kind)], [F.col(risk)], [F.col(result)]], F.col(kind), F.col(risk), F.col(result)).agg(F.grouping_id().alias("_g"), F.count("*").alias("events"))
    return sets.select(
        F.when(F.col("_g") == 3, "type").when(F.col("_g") == 5, "risk").otherwise("result").alias("dimension"),
        F.when(F.col("_g") == 3, F.col(kind)).when(F.col("_g") == 5, F.col(risk)).otherwise(F.col(result)).alias("value"), "events",
    )


def _alerting(risk: str, result: str) -> Column:
    return F.col(risk).isin("high", "critical") | F.col(result).isin("failure", "error")


def audit_summary(df: DataFrame, user: str, risk: str, result: str) -> DataFrame:
    """events, users (null is none) and security alerts, which are events of high risk or without success: one row."""
    return df.agg(F.count("*").alias("events"), F.countDistinct(user).alias("users"), F.count_if(F.coalesce(_alerting(risk, result), F.lit(False))).alias("alerts"))


def security_alerts(df: DataFrame, risk: str, result: str, ts: str, key: str, n: int = 50) -> DataFrame:
    """The latest ``n`` events of high or critical risk, or that failed."""
    return df.where(_alerting(risk, result)).orderBy(F.desc(ts), F.desc(key)).limit(n)


def user_activity(df: DataFrame, user: str, ts: str, n: int = 10) -> DataFrame:
    return df.groupBy(user).agg(F.count("*").alias("events"), F.max(ts).alias("last_activity")).orderBy(F.desc("events"), user).limit(n)


def with_checksum(df: DataFrame) -> DataFrame:
    """Events with the SHA-256 of their canonical JSON."""
    from ..functions.scalars import canonical_digest

    return df.withColumn("checksum", canonical_digest(*df.columns))


def integrity(df: DataFrame, checksum: str = "checksum") -> DataFrame:
    """events, mismatches and integrity % (100 for none): one row."""
    from ..functions.scalars import canonical_digest

    own = canonical_digest(*[c for c in df.columns if c != checksum])
    return df.agg(F.count("*").alias("events"), F.count_if(~own.eqNullSafe(F.col(checksum))).alias("mismatches")).withColumn("integrity", F.coalesce(F.try_divide((F.col("events") - F.col("mismatches")) * 100.0, F.col("events")), F.lit(100.0)))


def share_analytics(df: DataFrame, share: str, visitor: str, ts: str) -> DataFrame:
    return df.groupBy(share).agg(F.count("*").alias("accesses"), F.countDistinct(visitor).alias("visitors"), F.min(ts).alias("first"), F.max(ts).alias("last"))


def daily(df: DataFrame, ts: str, keys: list[str] = ()) -> DataFrame:
    return df.groupBy(*keys, F.to_date(ts).alias("day")).agg(F.count("*").alias("accesses"))


def sessions(df: DataFrame, user: str, ts: str, gap: str = "24 hours") -> DataFrame:
    """Sessions of a user by gaps in activity."""
    return df.groupBy(user, F.session_window(ts, gap).alias("s")).agg(F.count("*").alias("events")).select(user, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "events")


def session_statistics(rows: DataFrame, user: str, expires: str, now: Column) -> DataFrame:
    active = F.col(expires) > now
    return rows.agg(F.count("*").alias("total"), F.count_if(active).alias("active"), F.countDistinct(F.when(active, F.col(user))).alias("active_users"))


def session_addresses(rows: DataFrame, user: str, address: str, expires: str, now: Column, open_: str | None = None) -> DataFrame:
    """total, active, users and addresses of active sessions; active are open ones up to and at their end."""
    active = (F.col(expires) >= now) & (F.coalesce(F.col(open_), F.lit(False)) if open_ else F.lit(True))
    distinct = [F.countDistinct(F.when(active, F.col(c))).alias(n) for c, n in ((user, "users"), (address, "addresses"))]
    return rows.agg(F.count("*").alias("total"), F.count_if(active).alias("active"), *distinct)


def share_decisions(requests: DataFrame, links: DataFrame, share: str, ts: str, key: str) -> DataFrame:
    """granted and reason of every request, in time order; only grants use up ``max_access``.

    Every request that passes the other tests is counted, and those within the limit are granted.
    """
    joined = requests.join(links, share, "left")
    barred = F.when(F.col("active").isNull(), "unknown").when(~F.col("active"), "inactive").when(F.col(ts) > F.col("expires_at"), "expired")
    w = Window.partitionBy(share).orderBy(ts, key).rowsBetween(Window.unboundedPreceding, 0)
    rows = joined.withColumn("_b", barred).withColumn("_n", F.sum(F.col("_b").isNull().cast("int")).over(w))
    reason = F.coalesce("_b", F.when(F.col("_n") > F.col("max_access"), "limit reached").otherwise("granted"))
    return rows.select(key, share, (reason == "granted").alias("granted"), reason.alias("reason"))


def guarded_decisions(requests: DataFrame, links: DataFrame, share: str, ts: str, key: str, password: str = "password") -> DataFrame:
    """As ``share_decisions``, for links with a ``password_hash`` (SHA-256 in hexadecimal; null needs none).

    Only grants use up ``max_access`` (null or 0 is no limit), and a link that is used up refuses before it looks at the password.
    """
    joined = requests.join(links, share, "left")
    barred = F.when(F.col("active").isNull(), "unknown").when(~F.col("active"), "inactive").when(F.col(ts) > F.col("expires_at"), "expired")
    fits = F.col("password_hash").isNull() | F.coalesce(F.sha2(F.col(password), 256) == F.col("password_hash"), F.lit(False))
    before = Window.partitionBy(share).orderBy(ts, key).rowsBetween(Window.unboundedPreceding, -1)
    rows = joined.withColumn("_b", barred).withColumn("_fits", fits).withColumn("_n", F.coalesce(F.sum((F.col("_b").isNull() & F.col("_fits")).cast("int")).over(before), F.lit(0)))
    reason = F.coalesce("_b", F.when((F.col("max_access") > 0) & (F.col("_n") >= F.col("max_access")), "limit reached").when(~F.col("_fits"), "wrong password").otherwise("granted"))
    return rows.select(key, share, (reason == "granted").alias("granted"), reason.alias("reason"))


def lockouts(df: DataFrame, who: str, ts: str, seconds: int = 900, most: int = 10) -> DataFrame:
    """Failures with how many lie in the ``seconds`` up to each, and whether that locks out."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(who).orderBy(at).rangeBetween(-seconds * 1_000_000, 0)
    return df.select(who, ts, F.count("*").over(w).alias("failures")).withColumn("locked", F.col("failures") >= most)


def assemble(parents: DataFrame, children: dict[str, tuple[DataFrame, list[str]]], key: str) -> DataFrame:
    """Parents with an ordered array of structs from each child table (frame, order columns)."""
    out = parents
    for name, (child, order) in children.items():
        rest = [c for c in child.columns if c != key and c not in order]
        packed = child.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias(name))
        out = out.join(packed, key, "left").withColumn(name, F.coalesce(name, F.array().cast(packed.schema[name].dataType)))
    return out


def execution_statistics(df: DataFrame, millis: str, rows: str) -> DataFrame:
    return df.agg(*[f(c).alias(f"{n}_{c}") for c in (millis, rows) for n, f in (("avg", F.avg), ("max", F.max), ("min", F.min))], F.sum(rows).alias(f"total_{rows}"))


def result_summary(df: DataFrame, column: str) -> DataFrame:
    """total, mean, upper median, population deviation and distinct values of a result column."""
    n = ranks.counts(df, [column])[column]
    middle = ranks.at_ranks(df, {column: [n // 2]})[column][n // 2] if n else None
    facts = df.agg(F.count(column).alias("n"), F.sum(column).alias("total"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"), F.countDistinct(column).alias("distinct"))
    return facts.withColumn("upper_median", F.lit(middle).cast("double"))


def answer_quality(df: DataFrame) -> DataFrame:
    """1 - 0.5 * share of missing or empty cells of a result, 0 without rows: one row.

    A column of a DataFrame has one type, so that nothing is taken off for mixed ones.
    """
    missing = sum((F.count_if(F.col(c).isNull() | (F.col(c).cast("string") == "")) for c in df.columns), F.lit(0))
    row = df.agg(F.count("*").alias("n"), missing.alias("missing"))
    return row.select(F.when(F.col("n") == 0, 0.0).otherwise(1 - 0.5 * F.try_divide(F.col("missing").cast("double"), F.col("n") * len(df.columns))).alias("quality"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``old`` with the non-null values of ``new`` over them; ids unknown to ``old`` are passed over."""
    fresh = new.select(key, *[F.col(c).alias(f"_{c}") for c in new.columns if c != key])
    return old.join(fresh, key, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in new.columns and c != key else c for c in old.columns])
