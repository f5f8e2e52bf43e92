"""Sources and sinks: files with metadata, admission, JSON lines, ragged tables, exports, versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
# Extensions that are admitted and that are barred.
ALLOWED = ("pdf", "png", "jpg", "jpeg", "tiff", "bmp")
BARRED = ("exe", "bat", "cmd", "com", "scr", "js", "vbs", "sh")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """name, extension, size, SHA-256, first bytes and time of every file."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", "[^/]+$", 0)
    return raw.select(
        "path", name.alias("filename"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("extension"), F.col("length").alias("file_size"),
        F.sha2("content", 256).alias("file_hash"), F.substring("content", 1, 5).alias("magic"), F.col("modificationTime").alias("modified_at"),
    )


def admission(rows: DataFrame, most: int = 50 << 20) -> DataFrame:
    """errors (an array) and is_valid for rows of (filename, extension, file_size, magic)."""
    errors = F.array_compact(F.array(
        F.when(F.col("file_size") > most, F.lit("too large")), F.when(F.col("file_size") == 0, F.lit("empty")), F.when(F.col("extension").isin(*BARRED), F.lit("executable")),
        F.when(~F.col("extension").isin(*ALLOWED), F.lit("extension not allowed")), F.when(F.col("filename").rlike(r'[<>:"|?*]|\.\.'), F.lit("suspicious name")),
        F.when((F.col("extension") == "pdf") & (F.col("magic") != F.lit("%PDF-").cast("binary")), F.lit("not a PDF")),
    ))
    return rows.withColumn("errors", errors).withColumn("is_valid", F.size("errors") == 0)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines without the corrupt ones."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def to_csv(df: DataFrame, path: str) -> None:
    exportable(df, "csv")
    df.write.mode("overwrite").option("header", True).csv(path)


def to_json(df: DataFrame, path: str, **about: str) -> None:
    """Rows, and beside them one manifest row."""
    df.write.mode("overwrite").json(f"{path}/rows")
    df.sparkSession.range(1).select(F.array(*[F.lit(c) for c in df.columns]).alias("headers"), *[F.lit(v).alias(k) for k, v in about.items()]).write.mode("overwrite").json(f"{path}/manifest")


def export_tables(cells: DataFrame, path: str, key: str = "table_id") -> None:
    """Many tables in one job, a folder each."""
    cells.write.mode("overwrite").partitionBy(key).json(path)


def exportable(df: DataFrame, kind: str) -> None:
    nested = [c for c, t in df.dtypes if t.startswith(("array", "map", "struct"))]
    if kind == "csv" and nested:
        raise ValueError(f"CSV cannot hold {nested}")
    if not df.columns:
        raise ValueError("no columns")


def append_batch(batch_id: int, tables: dict[str, DataFrame], root: str) -> None:
    """Append several tables under one batch; running it again replaces that batch alone."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}/batch_id={batch_id}")


def save_version(df: DataFrame, root: str) -> None:
    df.write.mode("append").json(f"{root}/schema_versions")


def load_versions(spark: SparkSession, root: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(f"{root}/schema_versions")


def records(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows as JSON texts in order."""
    return df.orderBy(*order).select(F.to_json(F.struct(*df.columns)).alias("json"))


def dashboard_json(parts: dict[str, DataFrame], about: dict[str, str]) -> DataFrame:
    """One JSON text of a dashboard: what it is about, and the rows of each part (KPIs, charts, filters) as arrays.

    Parts are results of reports: each is packed into one array, so give them limits of their own.
    """
    spark = next(iter(parts.values())).sparkSession
    out = spark.range(1).select(F.struct(*[F.lit(v).alias(k) for k, v in about.items()]).alias("config"))
    for name, df in parts.items():
        rows = df.agg(F.array_sort(F.collect_list(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}))).alias(name))
        out = out.crossJoin(rows)  # one row each
    named = F.map_from_arrays(F.array(*[F.lit(n) for n in parts]), F.array(*[F.concat(F.lit("["), F.array_join(n, ","), F.lit("]")) for n in parts]))
    body = F.array_join(F.transform(F.map_entries(named), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"])), ",")
    return out.select(F.concat(F.lit('{"config":'), F.to_json("config"), F.lit(","), body, F.lit("}")).alias("json"))


def export_skipping(tables: dict[str, DataFrame], path: str, kind: str = "json") -> dict[str, str]:
    """Each table to a file set ``table_{i}_{name}``; those that cannot be exported are passed over and named with the reason."""
    failed = {}
    for i, (name, df) in enumerate(tables.items()):
        try:
            exportable(df, kind)
            writer = df.write.mode("overwrite")
            (writer.option("header", True).csv if kind == "csv" else writer.json)(f"{path}/table_{i}_{name}.{kind}")
        except ValueError as reason:
            failed[name] = str(reason)
    return failed
