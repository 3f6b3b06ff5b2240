"""Commits of several tables at once, and write-once puts, over folders of Parquet files.

A commit first writes the rows of all its tables below folders that nobody reads, and is published
by one file that names them. Files of the log are numbered; each is created only if it does not exist
yet, which the file system decides, so of two writers one gets the number and the other looks again.
Readers see the published folders only: a job that dies between two tables leaves nothing behind but
unread files, and a batch that is retried under its id is not published twice.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.ingest import first_wins

ENTRY = "version long, batch_id string, tables map<string, struct<path: string, schema: string>>"


class Lost(Exception):
    """Another writer published this version first."""


class CommitLog:
    """Tables below ``root``: ``data/<table>/batch=<id>`` holds rows, ``log`` says which of them count."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _system(self, path):
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def entries(self) -> list:
        """Published commits in order; one short row a commit."""
        folder = self._path("log")
        if not self._system(folder).exists(folder):
            return []
        return self.spark.read.schema(ENTRY).json(f"{self.root}/log/*.json").orderBy("version").collect()

    def _create(self, version: int, text: str) -> None:
        """Publish a file under its number, whole, or raise ``Lost`` if the number is taken."""
        jvm, target = self.spark.sparkContext._jvm, self._path("log", f"{version:020d}.json")
        system = self._system(target)
        system.mkdirs(target.getParent())

        def put(path) -> None:
            stream = system.create(path, False)
            try:
                stream.write(bytearray(text.encode()))
            finally:
                stream.close()

        if system.getUri().getScheme() == "s3a":  # an object appears whole on close; the store refuses a second one under its key
            steps: Callable[[], None] = lambda: put(target)
        else:
            draft = self._path("log", f".{version:020d}-{uuid.uuid4().hex}")
            put(draft)
            if system.getUri().getScheme() == "file":  # a link to an existing name fails, a rename would replace it
                nio = jvm.java.nio.file
                local = lambda p: nio.Path.of(p.toUri().getPath(), self.spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
                steps = lambda: nio.Files.createLink(local(target), local(draft))
            else:
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
                options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
                options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
                steps = lambda: context.rename(draft, target, options)
        try:
            steps()
        except Exception as failed:
            if system.exists(target):
                raise Lost(version) from failed
            raise
        finally:
            if system.getUri().getScheme() == "file":
                system.delete(draft, False)

    def stage(self, table: str, rows: DataFrame, partition_by: tuple[str, ...] = ()) -> tuple[str, str, str]:
        """Write rows where nobody reads them yet; what ``publish`` takes."""
        path = f"{self.root}/data/{table}/batch=b{uuid.uuid4().hex}"
        writer = rows.write.partitionBy(*partition_by) if partition_by else rows.write
        writer.parquet(path)
        return table, path, rows._jdf.schema().toDDL()

    def publish(self, batch_id: str, staged: list[tuple[str, str, str]], version: int) -> None:
        told = {table: {"path": path, "schema": schema} for table, path, schema in staged}
        self._create(version, json.dumps({"version": version, "batch_id": batch_id, "tables": told}))

    def commit(self, batch_id: str, tables: dict[str, DataFrame]) -> bool:
        """Publish all tables or none; False if this batch was published before."""
        staged = None
        while True:
            known = self.entries()
            if any(e.batch_id == batch_id for e in known):
                return False
            staged = staged or [self.stage(name, rows) for name, rows in tables.items()]
            try:
                self.publish(batch_id, staged, known[-1].version + 1 if known else 0)
                return True
            except Lost:
                continue

    def read(self, table: str, entries: list | None = None) -> DataFrame | None:
        """Rows of all published commits, with their batch; None before the first one."""
        parts = [e.tables[table] for e in (self.entries() if entries is None else entries) if table in e.tables]
        if not parts:
            return None
        schema = f"{parts[-1].schema}, batch STRING"
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/data/{table}").parquet(*[p.path for p in parts])

    def unpublished(self) -> list[str]:
        """Folders of commits that were never published or are still being written."""
        base = self._path("data")
        system = self._system(base)
        if not system.exists(base):
            return []
        published = {p.path.rsplit("/", 1)[-1] for e in self.entries() for p in e.tables.values()}
        found = [b.getPath() for t in system.listStatus(base) for b in system.listStatus(t.getPath())]
        return sorted(p.toString() for p in found if p.getName() not in published)


def record_run(log: CommitLog, batch_id: str, runs: DataFrame, observations: DataFrame, quarantined: DataFrame) -> bool:
    """Runs, what they observed and which of them are held back, as one commit."""
    return log.commit(batch_id, {"runs": runs, "observations": observations, "quarantined": quarantined})


def record_stream(stream: DataFrame, log: CommitLog, plan: Callable[[DataFrame], dict[str, DataFrame]], checkpoint: str, name: str = "stream"):
    """Commit the tables that ``plan`` makes of every micro-batch; a batch that is run again is not published twice."""

    def write(batch: DataFrame, number: int) -> None:
        log.commit(f"{name}/{number}", plan(batch))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def put_artifacts(log: CommitLog, artifacts: DataFrame, batch_id: str | None = None) -> DataFrame:
    """Store artifacts (artifact_id, sha256, content) whose ids are not stored yet; returns conflicts.

    Of several writers of an id the first to publish wins, whenever they began: who loses looks at
    what is stored now and leaves those ids out. Conflicts (artifact_id, sha256, kept) are ids that are
    stored with another digest or came with several; the same digest again is a retry and no conflict.
    Rows are in folders by the first bytes of their digest.
    """
    batch_id = batch_id or uuid.uuid4().hex
    first = first_wins(artifacts, "artifact_id", "sha256")
    while True:
        known = log.entries()
        stored = log.read("artifacts", known)
        held = stored.select("artifact_id", F.col("sha256").alias("kept")) if stored is not None else None
        if not any(e.batch_id == batch_id for e in known):
            fresh = first if held is None else first.join(held.select("artifact_id"), "artifact_id", "left_anti")
            placed = fresh.withColumn("d1", F.substring("sha256", 1, 2)).withColumn("d2", F.substring("sha256", 3, 2))
            staged = log.stage("artifacts", placed, ("d1", "d2"))
            try:
                log.publish(batch_id, [staged], known[-1].version + 1 if known else 0)
            except Lost:
                continue
        now = log.read("artifacts").select("artifact_id", F.col("sha256").alias("kept"))
        return artifacts.select("artifact_id", "sha256").distinct().join(now, "artifact_id").filter("sha256 != kept")
