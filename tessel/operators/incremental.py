"""Operator: process only new or changed records, by persisted key and content-hash state.

State lives in numbered versions under a shared folder; a pointer file names the version in
force.  A version is written in full before the pointer is swapped by an atomic rename, so a run
that fails leaves the former version in force and the next run sees the same changes again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.session import shared_folder


class HashState:
    """Versioned ``(keys..., content_hash)`` tables in a folder all executors share, with what a run made beside them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.folder))

    def version(self) -> str | None:
        """The version in force; None before the first successful run."""
        pointer = self._path(f"{self.folder}/CURRENT")
        if not self._fs.exists(pointer):
            return None
        stream = self._fs.open(pointer)
        try:
            return bytes(stream.readAllBytes()).decode().strip()
        finally:
            stream.close()

    def read(self, name: str = "state") -> DataFrame | None:
        version = self.version()
        return None if version is None else self.spark.read.parquet(f"{self.folder}/{version}/{name}")

    def commit(self, state: DataFrame, **made: DataFrame) -> str:
        """Write a version in full, the state and the tables a run made, then put all in force at once by the pointer.

        The version before stays for those that read it; older ones go.
        """
        before = self.version()
        version = f"v-{uuid.uuid4().hex}"
        for name, rows in (("state", state), *made.items()):
            rows.write.parquet(f"{self.folder}/{version}/{name}")
        fresh = self._path(f"{self.folder}/CURRENT.{version}")
        stream = self._fs.create(fresh, True)
        try:
            stream.write(bytearray(version.encode()))
        finally:
            stream.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.folder).toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        array = self.spark.sparkContext._gateway.new_array(options, 1)
        array[0] = options.OVERWRITE
        context.rename(fresh, self._path(f"{self.folder}/CURRENT"), array)
        for status in self._fs.listStatus(self._path(self.folder)):
            name = status.getPath().getName()
            if name.startswith("v-") and name not in (version, before):
                self._fs.delete(status.getPath(), True)
        return version


def process_changed(current: DataFrame, state: HashState, keys: list[str], work: Callable[[DataFrame], DataFrame], content_hash: str = "content_hash") -> DataFrame:
    """Run ``work`` over the new and changed rows, and put its result and the new state in force together.

    Rows are neither skipped nor repeated: a run that fails anywhere before the swap leaves no
    trace, and the next one sees the same changes; after the swap they are known.  Gives the
    result of this run.
    """
    state.commit(current.select(*keys, content_hash), result=work(changed(current, state.read(), keys, content_hash)))
    return state.read("result")


def changed(current: DataFrame, state: DataFrame | None, keys: list[str], content_hash: str = "content_hash") -> DataFrame:
    """Rows of ``current`` whose key is new or whose hash differs, nulls compared as values."""
    if state is None:
        return current
    known = state.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col(content_hash).alias("__hash"), F.lit(True).alias("__known"))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return current.join(known, on, "left").where(F.col("__known").isNull() | ~F.col(content_hash).eqNullSafe(F.col("__hash"))).select(*current.columns)


def deleted(current: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of the state that the current rows no longer have."""
    return state.select(*keys).join(current.select(*keys).distinct(), keys, "left_anti")


def normal_path(path: Column) -> Column:
    """A path without ``.``, ``..``, repeated and trailing slashes."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    plain = F.array_join(parts, "/")
    up = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when((p == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(p == "..", acc).otherwise(F.concat(acc, F.array(p))),
    )
    return F.concat(F.when(F.startswith(path, F.lit("/")), "/").otherwise(""), F.when(F.exists(parts, lambda p: p == ".."), F.array_join(up, "/")).otherwise(plain))


def watermarks(results: DataFrame, projects: DataFrame) -> DataFrame:
    """``(project_name, watermark)``: the latest cut-off among a project's successful runs of its present roots."""
    good = results.where(F.col("finished_at").isNotNull() & F.lower(F.trim("status")).isin("ok", "done"))
    now = projects.select(F.col("name").alias("project_name"), "addons_hash").distinct()
    return good.join(now, ["project_name", "addons_hash"]).groupBy("project_name").agg(F.max("cutoff_at").alias("watermark"))


def scan_changes(scans: DataFrame, results: DataFrame, projects: DataFrame, folder: str | None = None) -> DataFrame:
    """Scans that the next run of each project must handle: ``(project_name, path, content_hash, scan_id)``.

    The state holds the hashes known as of each project's last successful run.  With a ``folder``
    it lasts from call to call: only projects with a later successful run read their history again,
    and the new version is put in force before the present hashes are joined with it.  Rows without
    project or path are left out; a project without successful run has every path new; of a
    re-delivered scan the smallest id stands; an empty table gives an empty result.
    """
    spark = scans.sparkSession
    rows = scans.where("project_name is not null and path is not null").select("project_name", normal_path(F.col("path")).alias("path"), F.col("module_hash").alias("content_hash"), "scanned_at", "arrived_at", "scan_id")
    pick = F.max(F.struct(F.col("scanned_at"), (-F.col("scan_id")).alias("neg"), "content_hash"))
    marks = watermarks(results, projects)
    state = HashState(spark, folder or f"{shared_folder(spark)}/tessel-state-{uuid.uuid4().hex}")
    before = state.read()
    kept, later = None, marks
    if before is not None:
        kept = before.join(marks, ["project_name", "watermark"], "left_semi")
        later = marks.join(before.select("project_name", "watermark").distinct(), ["project_name", "watermark"], "left_anti")
    known = (
        rows.join(later, "project_name")
        .where("arrived_at <= watermark")
        .groupBy("project_name", "path", "watermark")
        .agg(pick.alias("s"))
        .select("project_name", "path", "watermark", F.col("s.content_hash").alias("content_hash"))
    )
    if before is None or not later.isEmpty():
        state.commit(known if kept is None else kept.select(known.columns).unionByName(known))
    current = rows.groupBy("project_name", "path").agg(pick.alias("s")).select("project_name", "path", F.col("s.content_hash").alias("content_hash"), (-F.col("s.neg")).alias("scan_id"))
    # a project that lost its successful runs (other roots now) knows nothing
    return changed(current, state.read().join(marks, ["project_name", "watermark"], "left_semi"), ["project_name", "path"])
