"""Several tables appended as one: staged files, made visible together by one manifest.

Rows of a batch are first written to folders of their own, which no reader looks at. One small file then names all of
them; it is written beside its place and renamed into it, which the file system does as a whole, and only if no other
writer has taken the place. Readers only follow manifests, so that they see all of a batch or nothing of it. A
batch has a name, and one that is committed already adds nothing when it comes again.

On this rest a store of schema versions, where a writer that has not seen the latest version is refused, and an audit
log that only grows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalars import canonical_digest
from ..operators import logs, schema

MANIFEST = "version long, batch string, tables array<struct<name: string, path: string, fields: string>>"


class Clash(RuntimeError):
    """Another writer has committed in the meantime."""


class Store:
    """The tables of one folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self._log = spark, root.rstrip("/"), f"{root.rstrip('/')}/_commits"
        hadoop = spark._jvm.org.apache.hadoop.fs
        conf = spark._jsc.hadoopConfiguration()
        self._path = hadoop.Path
        self._fs = hadoop.Path(self.root).getFileSystem(conf)
        self._context = hadoop.FileContext.getFileContext(self._fs.getUri(), conf)
        rename = getattr(hadoop, "Options$Rename")
        self._keep_old = spark.sparkContext._gateway.new_array(rename, 1)
        self._keep_old[0] = rename.valueOf("NONE")
        self._fs.mkdirs(self._path(self._log))

    def version(self) -> int:
        """The number of the latest commit, 0 if there is none."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self._log))]
        return max((int(n.removesuffix(".json")) for n in names if n[0].isdigit()), default=0)

    def manifests(self) -> DataFrame:
        """version, batch and the staged tables of every commit."""
        if not self.version():
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).json(f"{self._log}/[0-9]*.json")

    def _committed(self, batch: str) -> int | None:
        found = self.manifests().where(F.col("batch") == batch).select("version").first()
        return found["version"] if found else None

    def _publish(self, version: int, body: dict) -> bool:
        """Whether the manifest took the place of ``version``."""
        draft, place = self._path(f"{self._log}/_{uuid.uuid4().hex}.draft"), self._path(f"{self._log}/{version:020d}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps({"version": version} | body).encode()))
        out.close()
        try:
            self._context.rename(draft, place, self._keep_old)
        except Exception:
            self._fs.delete(draft, False)
            if not self._fs.exists(place):
                raise
            return False
        return True

    def commit(self, batch: str, tables: dict[str, DataFrame], seen: int | None = None) -> int:
        """Append the rows of all tables under one version, which is returned; a batch that is there already adds nothing.

        With ``seen``, the commit is refused by a Clash unless that is still the latest version.
        """
        done = self._committed(batch)
        if done is not None:
            return done
        staged = []
        for name, df in tables.items():
            path = f"{self.root}/{name}/{uuid.uuid4().hex}"
            df.write.parquet(path)
            staged.append({"name": name, "path": path, "fields": df.schema.json()})
        while True:
            latest = self.version()
            if seen is not None and latest != seen:
                raise Clash(f"version {latest} came after {seen}")
            if self._publish(latest + 1, {"batch": batch, "tables": staged}):
                return latest + 1
            done = self._committed(batch)  # the same batch may have come from two writers
            if done is not None:
                return done

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """The rows of a table up to a version, the latest if none is named; columns that came later are null before."""
        log = self.manifests().where(F.lit(True) if version is None else F.col("version") <= version)
        parts = log.select("version", F.inline("tables")).where(F.col("name") == name).orderBy("version").collect()  # one row a commit
        if not parts:
            raise ValueError(f"nothing is committed to {name}")
        by_fields: dict[str, list[str]] = {}
        for p in parts:
            by_fields.setdefault(p["fields"], []).append(p["path"])
        out = None
        for fields, paths in by_fields.items():
            rows = self.spark.read.schema(StructType.fromJson(json.loads(fields))).parquet(*paths)
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out

    def orphans(self) -> list[str]:
        """Staged folders that no commit names: of writers that failed, or that have not committed yet."""
        named = {r["path"] for r in self.manifests().select(F.inline("tables")).select("path").collect()}
        found = []
        for t in self._fs.listStatus(self._path(self.root)):
            if t.isDirectory() and t.getPath().getName() != "_commits":
                found += [f"{self.root}/{t.getPath().getName()}/{s.getPath().getName()}" for s in self._fs.listStatus(t.getPath())]
        return sorted(set(found) - named)

    def clean(self) -> int:
        """Delete orphans; only for times without writers."""
        lost = self.orphans()
        for path in lost:
            self._fs.delete(self._path(path), True)
        return len(lost)


# --- schema versions ----------------------------------------------------------------------------

#: How often a writer of a version looks again after another one came first.
TRIES = 5


def create_version(store: Store, table: str, profile_rows: DataFrame, at: Column, batch: str, about: str = "", before_commit: Callable[[], None] | None = None) -> str:
    """Add a version of a table's schema after the latest one; its name is v<time>_<first 8 digits of the hash>.

    ``profile_rows`` (name, data_type, nullable, unique_values) is checked first, and errors are refused. The parent is
    the version that was latest when the writer looked; where another writer came first, the new version is made
    anew on top of that one. The changes against the parent are kept with it. ``before_commit`` is for tests.
    """
    wrong = [r["problem"] for r in schema.validate(profile_rows, 1 << 62).where("severity = 'error'").collect()]  # a few a column
    if wrong:
        raise ValueError(f"invalid schema: {', '.join(sorted(wrong))}")
    fields = profile_rows.select("name", "data_type", "nullable")
    for _ in range(TRIES):
        seen = store.version()
        parent = latest_version(store, table) if _has(store, "versions") else None
        name = fields.transform(schema.digest).select(
            F.concat(F.lit("v"), F.date_format(at, "yyyyMMdd_HHmmss_SSSSSS"), F.lit("_"), F.substring("hash", 1, 8)).alias("version"), "hash", at.cast("timestamp").alias("created_at")
        ).first()
        version = name["version"]
        if parent is not None and parent["version"].startswith(version):
            version = f"{version}_{parent['number']}"
        number = parent["number"] + 1 if parent else 1
        row = store.spark.createDataFrame(
            [(table, number, version, parent["version"] if parent else None, name["hash"], name["created_at"], about)],
            "table_name string, number int, version string, parent_version string, hash string, created_at timestamp, about string",
        )
        described = fields.withColumn("version", F.lit(version)).withColumn("table_name", F.lit(table))
        old = store.read("version_fields").where((F.col("table_name") == table) & (F.col("version") == parent["version"])) if parent else fields.limit(0)
        changes = schema.diff(old.select("name", "data_type", "nullable"), fields) if parent else schema.diff(fields, fields)
        tables = {"versions": row, "version_fields": described, "version_changes": changes.withColumn("version", F.lit(version)).withColumn("table_name", F.lit(table))}
        if before_commit:
            before_commit()
        try:
            store.commit(batch, tables, seen)
            return version
        except Clash:
            continue
    raise Clash(f"{TRIES} tries for {table}")


def _has(store: Store, name: str) -> bool:
    return store.manifests().where(F.exists("tables", lambda t: t["name"] == name)).limit(1).count() > 0


def latest_version(store: Store, table: str):
    return store.read("versions").where(F.col("table_name") == table).orderBy(F.desc("number")).first()


def version_history(store: Store) -> DataFrame:
    """Every version, with the one after it; the last of a table alone is active."""
    return schema.versions(store.read("versions"), "table_name", "number").withColumnRenamed("next_version", "next_number")


# --- audit log ----------------------------------------------------------------------------------


def log_events(store: Store, events: DataFrame, batch: str) -> int:
    """Append audit events with risk_level (by event_type) and checksum; a batch that comes again adds nothing."""
    risky = events.withColumn("risk_level", logs.risk_level("event_type"))
    return store.commit(batch, {"audit": risky.withColumn("checksum", canonical_digest(*risky.columns))})


def audit(store: Store) -> DataFrame:
    return store.read("audit")
