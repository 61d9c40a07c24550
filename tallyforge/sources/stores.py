"""Stored rows by key, appended in versions: saved recipes, and a data set that is imported once per content."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class KeyStore:
    """Parquet versions below a folder of any store Spark reads: ``generation=G/version=V``. A key's newest version holds all its rows.

    A version counts once its writer has finished it; one writer at a time is meant. Compaction writes the newest rows into the next
    generation, whose first version hides the generations before; ``vacuum`` removes these when nobody reads them any more.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str]):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def _system(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self, path: str, name: str) -> list[int]:
        target, system = self._system(path)
        if not system.exists(target):
            return []
        found = [re.fullmatch(rf"{name}=(\d+)", s.getPath().getName()) for s in system.listStatus(target)]
        return sorted(int(m[1]) for m in found if m)

    def _finished(self, generation: int) -> list[int]:
        folder = f"{self.path}/generation={generation}"
        done = []
        for v in self._numbers(folder, "version"):
            target, system = self._system(f"{folder}/version={v}/_SUCCESS")
            if system.exists(target):
                done.append(v)
        return done

    def _current(self) -> tuple[int, list[int]]:
        """The newest generation whose first version is finished, and its finished versions."""
        for g in reversed(self._numbers(self.path, "generation")):
            if done := self._finished(g):
                return g, done
        return 0, []

    def append(self, rows: DataFrame) -> None:
        """A new version; keys it has replace all their earlier rows."""
        generation, done = self._current()
        rows.write.mode("overwrite").parquet(f"{self.path}/generation={generation}/version={(done[-1] if done else 0) + 1}")

    def latest(self) -> DataFrame | None:
        """The newest rows of each key; None while nothing is stored."""
        generation, done = self._current()
        if not done:
            return None
        folders = [f"{self.path}/generation={generation}/version={v}" for v in done]
        rows = self.spark.read.option("basePath", f"{self.path}/generation={generation}").option("mergeSchema", "true").parquet(*folders)
        if len(done) == 1:
            return rows.drop("version")
        newest = rows.groupBy(*self.key).agg(F.max("version").alias("_newest"))
        match = F.col("a.version") == F.col("b._newest")
        for k in self.key:
            match &= F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        return rows.alias("a").join(newest.alias("b"), match, "left_semi").drop("version")

    def compact(self) -> None:
        rows = self.latest()
        if rows is not None:
            rows.write.mode("overwrite").parquet(f"{self.path}/generation={self._current()[0] + 1}/version=1")

    def vacuum(self) -> None:
        """Removes the generations before the current one."""
        now, _ = self._current()
        for g in self._numbers(self.path, "generation"):
            if g < now:
                target, system = self._system(f"{self.path}/generation={g}")
                system.delete(target, True)


def imported(store: KeyStore, manifest: DataFrame, read: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of all clients of a manifest (client_id, sha256, ...), of which only those are read whose content is not stored yet.

    ``read`` makes rows (client_id, ...) of the manifest's rows it is given. What it makes of a client is stored with the content's hash and
    replaces what an earlier content gave; clients that have left the manifest are stored still, but not returned. A client whose content gives no rows is kept as one marker, so it is not read again.
    """
    own = manifest.groupBy("client_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("sha256")), ","), 256).alias("content"))
    kept = store.latest()
    todo = own if kept is None else own.join(kept.select("client_id", "content").distinct(), ["client_id", "content"], "left_anti")
    if not todo.isEmpty():
        fresh = read(manifest.join(todo.select("client_id"), "client_id", "left_semi"))
        store.append(todo.join(fresh.withColumn("present", F.lit(True)), "client_id", "left"))
    rows = store.latest()
    if rows is None:
        return read(manifest).limit(0)  # an empty manifest: the columns alone
    return rows.where("present").join(own, ["client_id", "content"], "left_semi").drop("content", "present")
