"""KPIs that are refreshed from what is new: partial aggregates of each micro-batch, merged when they are read.

A batch leaves a few rows a column: counts, sums and ends of its numbers, counts of the values of columns with few of
them, times near its end, and the distinct rows it has as hashes. All of them merge in any order, so that a refresh
reads these rows and none of the data before. They are committed under the number of the batch, so that a batch that
comes again after a restart counts once.

Merged KPIs equal those of ``kpi`` over all rows so far. Distinct values are exact up to ``MOST``, beyond which a
column has no KPI of that kind and its values are no longer kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.commits import Store

#: Distinct values up to which a column is categorical, and those over which a number's maximum is of interest.
MOST, FEW = 20, 5
RECENT_DAYS = 7
PARTIAL = "part string, name string, value string, n long, total double, low double, high double"


class RunningKpis:
    """KPIs of the columns of a table that arrives in batches; ``update`` is a handler for foreachBatch."""

    def __init__(self, spark: SparkSession, root: str, numbers: list[str], kinds: list[str], date: str | None = None):
        self.store, self.numbers, self.kinds, self.date = Store(spark, root), numbers, kinds, date

    def update(self, batch: DataFrame, batch_id: int) -> None:
        self.store.commit(f"batch-{batch_id}", {"partials": self._partials(batch), "kinds_of_rows": self._kinds_of_rows(batch)})

    def _kinds_of_rows(self, df: DataFrame) -> DataFrame:
        columns = [F.col(f"`{c}`") for c in df.columns]
        return df.select(F.xxhash64(*columns).alias("a"), F.hash(*columns, F.lit(7)).alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))

    def _partials(self, df: DataFrame) -> DataFrame:
        def row(part: str, name: str | None, n, total=None, low=None, high=None, value=None):
            parts = [F.lit(part), F.lit(name), value if value is not None else F.lit(None), n, total, low, high]
            kinds = [x.split() for x in PARTIAL.split(", ")]
            return F.struct(*[(p if p is not None else F.lit(None)).cast(k).alias(c) for p, (c, k) in zip(parts, kinds, strict=True)])

        filled = sum((F.count(f"`{c}`") for c in df.columns), F.lit(0))
        whole = [row("rows", None, F.count("*"), filled, F.lit(len(df.columns)))]
        whole += [row("number", c, F.count(c), F.sum(c), F.min(c), F.max(c)) for c in self.numbers]
        if self.date:
            at = F.unix_micros(F.col(self.date).cast("timestamp"))
            whole.append(row("dates", self.date, F.count(self.date), None, F.min(at), F.max(at)))
        out = df.agg(*[w.alias(f"w{i}") for i, w in enumerate(whole)]).select(F.inline(F.array(*[F.col(f"w{i}") for i in range(len(whole))])))
        named = [F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in dict.fromkeys(self.numbers + self.kinds)]
        counts = df.select(F.inline(F.array(*named))).where("value IS NOT NULL").groupBy("name", "value").agg(F.count("*").alias("n"))
        many = counts.groupBy("name").agg(F.count("*").alias("kinds")).where(F.col("kinds") > MOST)  # a row for each column at most
        kept = counts.join(F.broadcast(many), "name", "left_anti").select(row("value", None, F.col("n"), value=F.col("value")).alias("r"), "name")
        out = out.unionByName(kept.select(F.lit("value").alias("part"), "name", "r.value", "r.n", "r.total", "r.low", "r.high"))
        out = out.unionByName(many.select(F.lit("many").alias("part"), "name", F.lit(None).cast("string").alias("value"), F.col("kinds").alias("n"), *[F.lit(None).cast("double").alias(c) for c in ("total", "low", "high")]))
        if self.date:
            end = df.agg((F.max(at) - RECENT_DAYS * 86_400_000_000).alias("since"))  # one row
            near = df.select(at.alias("at")).crossJoin(F.broadcast(end)).where(F.col("at") >= F.col("since")).groupBy("at").agg(F.count("*").alias("n"))
            out = out.unionByName(near.select(F.lit("recent").alias("part"), F.lit(self.date).alias("name"), F.lit(None).cast("string").alias("value"), "n", F.lit(None).cast("double").alias("total"), F.col("at").cast("double").alias("low"), F.lit(None).cast("double").alias("high")))
        return out

    def kpis(self) -> DataFrame:
        """kpi_id, label and value of all rows so far."""
        parts = self.store.read("partials")
        merged = parts.where("part IN ('rows', 'number', 'dates')").groupBy("part", "name").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))
        whole = merged.where("part = 'rows'").select(F.col("n").alias("rows"), F.col("total").alias("filled"), F.col("low").alias("columns"))  # one row
        values = parts.where("part = 'value'").groupBy("name", "value").agg(F.sum("n").alias("n"))
        found = values.groupBy("name").agg(F.count("*").alias("kinds"), F.min(F.struct((-F.col("n")).alias("less"), "value")).alias("top"))
        closed = parts.where("part = 'many'").groupBy("name").agg(F.max("n").alias("over"))
        kinds = found.join(closed, "name", "full").select("name", F.when(F.col("over").isNotNull(), F.lit(MOST + 1)).otherwise(F.col("kinds")).alias("kinds"), "top")

        numbers = merged.where("part = 'number'").crossJoin(F.broadcast(whole)).where("n * 2 >= rows AND n > 0").join(kinds, "name", "left")
        made = F.array(
            F.when(F.col("low") >= 0, _kpi(F.concat(F.lit("total_"), "name"), F.col("total"))), _kpi(F.concat(F.lit("avg_"), "name"), F.col("total") / F.col("n")),
            F.when(F.col("kinds") > FEW, _kpi(F.concat(F.lit("max_"), "name"), F.col("high"))),
        )
        out = numbers.select(F.inline(F.array_compact(made)))
        some = kinds.where(F.col("name").isin(self.kinds) & (F.col("kinds") <= MOST))
        both = F.array(_kpi(F.concat(F.lit("top_"), "name"), -F.col("top.less"), F.col("top.value")), _kpi(F.concat(F.lit("unique_"), "name"), F.col("kinds")))
        out = out.unionByName(some.select(F.inline(both)))
        of_rows = self.store.read("kinds_of_rows").select("a", "b").distinct().agg(F.count("*").alias("distinct_rows"))
        share = lambda a, b: F.coalesce(F.try_divide(a * 100.0, b), F.lit(0.0))
        quality = F.array(
            _kpi(F.lit("completeness"), share(F.col("filled"), F.col("rows") * F.col("columns"))), _kpi(F.lit("total_records"), F.col("rows")),
            _kpi(F.lit("duplicate_rate"), share(F.col("rows") - F.col("distinct_rows"), F.col("rows"))),
        )
        out = out.unionByName(whole.crossJoin(of_rows).select(F.inline(quality)))  # one row each
        if self.date:
            ends = merged.where("part = 'dates'").select("low", "high", F.col("n").alias("dated")).crossJoin(F.broadcast(whole))
            near = parts.where("part = 'recent'").crossJoin(F.broadcast(ends.select("high").withColumnRenamed("high", "end")))
            recent = near.where(F.col("low") >= F.col("end") - RECENT_DAYS * 86_400_000_000).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("recent"))
            days = F.greatest(F.lit(1), F.floor((F.col("high") - F.col("low")) / 86_400_000_000))
            timed = F.array(_kpi(F.lit("records_per_day"), F.col("rows") / days), _kpi(F.lit("recent_records"), F.col("recent")))
            out = out.unionByName(ends.crossJoin(recent).select(F.inline(timed)))
        return out


def _kpi(kpi_id, value, label=None):
    return F.struct(kpi_id.alias("kpi_id"), (label if label is not None else F.lit(None).cast("string")).alias("label"), value.cast("double").alias("value"))
