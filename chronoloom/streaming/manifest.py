"""Results in committed attempts, so that neither a crash nor a second run leaves doubles or gaps.

What is worked out is written as an attempt, a folder of its own. It counts once a manifest names it:
manifests are numbered files, each the whole list of attempts that count, and a number is taken by a
rename that fails if somebody else has taken it. Who loses that race sees what the winner committed,
drops the keys that are done by now from its own attempt and tries the next number. Readers take the
last manifest's attempts; folders that no manifest names are left over from crashes and are never
read (``sweep`` deletes them).
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.operators.dedup import unprocessed


class Lost(Exception):
    """Another run took the number."""


class Results:
    """The results below ``path``, whose rows have the columns of ``like``; rows with an ``error`` are failures, not results."""

    def __init__(self, spark: SparkSession, path: str, like: DataFrame):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), like.schema

    def _at(self, *parts: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return target, target.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The last manifest's number; 0 if there is none."""
        folder, files = self._at("_manifest")
        if not files.exists(folder):
            return 0
        names = [s.getPath().getName() for s in files.listStatus(folder)]
        return max([int(n) for n in names if re.fullmatch(r"\d+", n)], default=0)

    def attempts(self, version: int | None = None) -> list[str]:
        """The names of the attempts that count."""
        version = self.version() if version is None else version
        if not version:
            return []
        target, files = self._at("_manifest", str(version))
        stream = files.open(target)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _all(self, attempts: list[str]) -> DataFrame:
        if not attempts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{a}" for a in attempts])

    def done(self, version: int | None = None) -> DataFrame:
        rows = self._all(self.attempts(version))
        return rows.where("error IS NULL") if "error" in rows.columns else rows

    def failed(self) -> DataFrame:
        """Failures of any attempt; their keys may have a result by now."""
        rows = self._all(self.attempts())
        return rows.where("error IS NOT NULL") if "error" in rows.columns else rows.limit(0)

    def write(self, rows: DataFrame, name: str | None = None) -> str:
        """Writes an attempt, which does not count yet; returns its name."""
        name = name or f"attempt-{uuid.uuid4().hex}"
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return name

    def publish(self, version: int, attempts: list[str]) -> None:
        """Makes manifest ``version``; Lost if there is one."""
        draft, files = self._at("_manifest", f".{uuid.uuid4().hex}")
        stream = files.create(draft, False)
        stream.write(json.dumps(attempts).encode())
        stream.close()
        target, _ = self._at("_manifest", str(version))
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration()) if draft.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, target, none)
        except Exception as failure:
            files.delete(draft, False)
            if "FileAlreadyExists" in str(failure) or files.exists(target):
                raise Lost(version) from failure
            raise

    def commit(self, name: str, key: str, version: int, tries: int = 100) -> None:
        """Makes attempt ``name`` count, worked out when ``version`` was the last; keys that others finished meanwhile go from it."""
        for _ in range(tries):
            known = self.attempts(version)
            if name in known:
                return
            try:
                self.publish(version + 1, [*known, name])
                return
            except Lost:
                version = self.version()
                name = self.write(unprocessed(self._all([name]), self.done(version), key))
        raise RuntimeError(f"no manifest could be made in {tries} tries")

    def add(self, rows: DataFrame, key: str, work: Callable[[DataFrame], DataFrame]) -> int:
        """Works on the rows whose key has no result, and commits theirs; returns how many were left."""
        version = self.version()
        left = unprocessed(rows, self.done(version), key)
        n = left.count()
        if n:
            self.commit(self.write(work(left)), key, version)
        return n

    def sweep(self) -> int:
        """Deletes attempts that do not count, to be used while nobody works below the path; returns how many."""
        known, (folder, files) = set(self.attempts()), self._at()
        if not files.exists(folder):
            return 0
        loose = [s.getPath() for s in files.listStatus(folder) if s.getPath().getName() not in known and not s.getPath().getName().startswith("_")]
        for path in loose:
            files.delete(path, True)
        return len(loose)


def latest_failures(results: Results, key: str) -> DataFrame:
    """(key, error) of the keys that have failures alone."""
    return unprocessed(results.failed(), results.done(), key).groupBy(key).agg(F.max("error").alias("error"))
