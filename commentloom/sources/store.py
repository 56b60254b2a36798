"""Keyed result store: only requests without a stored result are computed."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DataType, StringType, StructField, StructType

from commentloom.runtime import cut

OK = "ok"
FAILED = "failed"
# Tries of a commit while other runs commit too.
COMMIT_TRIES = 20


def missing(requests: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Requests with no successful stored result."""
    if "status" in stored.columns:
        stored = stored.where(F.col("status") == OK)
    return requests.join(stored.select(*keys), keys, "left_anti")


class ResultStore:
    """Table `request_key, provider, status, value` in a directory for each provider below `path`.

    The key is a digest of the request's content, so changed text is a new
    request; the provider id keeps results of different models apart. Failed
    requests are stored with their status and tried again by the next run.

    Rows lie in buckets by the first hex digit of the key's digest, in one directory for each commit. A snapshot is a numbered
    file that names the commits that count. It is put in place by one rename, so a reader sees all of a commit or nothing, and
    goes on reading the snapshot it began with while others append or compact; only `vacuum` deletes.
    """

    def __init__(self, spark: SparkSession, path: str, provider: str, value_type: DataType):
        self.spark = spark
        self.provider = provider
        self.root = f"{path.rstrip('/')}/provider={hashlib.sha256(provider.encode()).hexdigest()[:16]}"
        fields = [("request_key", StringType()), ("provider", StringType()), ("status", StringType()), ("value", value_type)]
        self.schema = StructType([StructField(c, kind) for c, kind in fields])

    # ---- snapshots

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def snapshots(self) -> list[int]:
        """Numbers of the snapshots, oldest first."""
        files, log = self._files(), self._path("_log")
        if not files.exists(log):
            return []
        names = [f.getPath().getName() for f in files.listStatus(log)]
        return sorted(int(n) for n in names if n.isdigit())

    def commits(self, snapshot: int | None = None) -> list[str]:
        """The commits of a snapshot, the latest one by default; a name for each run that stored something since the last compaction."""
        if snapshot is None:
            snapshot = max(self.snapshots(), default=None)
        if snapshot is None:
            return []
        stream = self._files().open(self._path("_log", f"{snapshot:020d}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _commit(self, added: list[str], removed: list[str]) -> None:
        """A new snapshot. If another run's came first, it is the base of the next try."""
        files = self._files()
        for _ in range(COMMIT_TRIES):
            latest = max(self.snapshots(), default=0)
            now = [c for c in (self.commits(latest) if latest else []) if c not in removed] + added
            draft, final = self._path("_log", f"draft-{uuid.uuid4().hex}"), self._path("_log", f"{latest + 1:020d}")
            out = files.create(draft, False)
            out.write(bytearray(json.dumps(now).encode()))
            out.close()
            # A rename does not replace a file that is there.
            if not files.exists(final) and files.rename(draft, final):
                return
            files.delete(draft, False)
        raise RuntimeError(f"no snapshot could be added to {self.root}")

    def _write(self, rows: DataFrame) -> str:
        commit = uuid.uuid4().hex
        # A file for each bucket and not for each task and bucket.
        bucketed = rows.select(*self.schema.names).withColumn("bucket", _bucket()).repartition("bucket")
        bucketed.write.partitionBy("bucket").parquet(f"{self.root}/commit={commit}")
        return commit

    # ---- reading and writing

    def load(self, requests: DataFrame | None = None) -> DataFrame:
        """Rows of the latest snapshot; only buckets that hold keys of `requests`, if these are given."""
        held = self.commits()
        if not held:
            return self.spark.createDataFrame([], self.schema)
        schema = StructType([*self.schema.fields, StructField("commit", StringType()), StructField("bucket", StringType())])
        reader = self.spark.read.schema(schema).option("basePath", self.root)
        table = reader.parquet(*[f"{self.root}/commit={c}" for c in held])
        if requests is not None:
            # Sixteen at most.
            asked = [r[0] for r in requests.select(_bucket().alias("b")).distinct().collect()]
            table = table.where(F.col("bucket").isin(asked))
        return table.select(*self.schema.names)

    def results(self, requests: DataFrame) -> DataFrame:
        """One row per stored key among `requests`: a success if any run had one.

        Concurrent runs may append the same key twice; the smallest value wins,
        so that every reader sees the same one. The rest of the store is left out before
        anything is aggregated.
        """
        return _one_per_key(self.load(requests).join(requests.select("request_key"), "request_key", "left_semi"))

    def compact(self) -> None:
        """Rewrite the rows as one per key, in one commit. Runs that append meanwhile lose nothing."""
        old = self.commits()
        if old:
            new = self._write(_one_per_key(self.load()).withColumn("provider", F.lit(self.provider)))
            self._commit([new], old)

    def vacuum(self, keep: int = 1) -> None:
        """Delete what the last `keep` snapshots do not name. No reader of an older snapshot and no run that stores may be active."""
        files, numbers = self._files(), self.snapshots()
        if not numbers:
            return
        kept = numbers[-keep:]
        named = {c for n in kept for c in self.commits(n)}
        for n in numbers[:-keep]:
            files.delete(self._path("_log", f"{n:020d}"), False)
        for f in files.listStatus(self._path()):
            commit = f.getPath().getName().removeprefix("commit=")
            if commit != f.getPath().getName() and commit not in named:
                files.delete(f.getPath(), True)

    def ensure(self, requests: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Results for `requests` (distinct on `request_key`), computing the missing ones.

        `compute` maps requests to `request_key, status, value`.
        """
        # The requests are the small side as a rule: as a table they can be broadcast to the store,
        # which then is read once and not shuffled.
        requests = cut(requests)
        held = self.load(requests).join(requests.select("request_key"), "request_key", "left_semi")
        todo = cut(missing(requests, held.select("request_key", "status"), ["request_key"]))
        if not todo.isEmpty():
            fresh = compute(todo).select("request_key", F.lit(self.provider).alias("provider"), "status", "value")
            self._commit([self._write(fresh)], [])
        return self.results(requests)


def _bucket() -> Column:
    return F.substring(F.md5("request_key"), 1, 1)


def _one_per_key(rows: DataFrame) -> DataFrame:
    ok = F.col("status") == OK
    return rows.groupBy("request_key").agg(
        F.when(F.max(ok), F.lit(OK)).otherwise(F.lit(FAILED)).alias("status"),
        F.min(F.when(ok, F.col("value"))).alias("value"),
    )
