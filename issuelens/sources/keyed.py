"""A keyed table of Parquet files that a batch changes in place of a full rewrite.

Rows lie in buckets by a hash of their key. A batch reads and rewrites only the buckets
that its keys fall into; the files of all others stay as they are. One small manifest a
batch says which batch wrote each bucket last. It is written last and in one step, so
readers see a batch whole or not at all, and a batch whose manifest exists is done: a
replay changes nothing. Files that neither the newest manifest nor the one before it
names are deleted, so readers of the previous state can finish.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "__bucket"


@dataclass(frozen=True)
class KeyedTable:
    """Where the table lies, its key and its number of buckets, fixed when it is first written.

    A bucket should hold what one task merges well; 100 million rows a bucket is a
    lot, a few rows too little.
    """

    path: str
    keys: tuple[str, ...]
    buckets: int = 64

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    # ------------------------------------------------------------ manifests

    def _fs(self, spark: SparkSession, path: str):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p

    def batches(self, spark: SparkSession) -> list[int]:
        """Batches that are done, in order."""
        fs, folder = self._fs(spark, f"{self.path}/manifest")
        if not fs.exists(folder):
            return []
        names = [status.getPath().getName() for status in fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def manifest(self, spark: SparkSession, batch: int) -> dict:
        """{schema, buckets: {bucket: batch that wrote it}}; at most ``buckets`` entries."""
        text = spark.read.text(f"{self.path}/manifest/{batch:012d}.json", wholetext=True).first().value
        return json.loads(text)

    def _commit(self, spark: SparkSession, batch: int, content: dict) -> None:
        name = f"{self.path}/manifest/{batch:012d}"
        fs, draft = self._fs(spark, f"{name}.draft")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        fs.rename(draft, spark._jvm.org.apache.hadoop.fs.Path(f"{name}.json"))

    # ------------------------------------------------------------ reading

    def read(self, spark: SparkSession, batch: int | None = None) -> DataFrame | None:
        """The newest state, or that after ``batch``; None before the first batch."""
        done = [b for b in self.batches(spark) if batch is None or b <= batch]
        return self._state(spark, self.manifest(spark, done[-1])) if done else None

    def _state(self, spark: SparkSession, manifest: dict, only: set[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        paths = [f"{self.path}/data/{wrote:012d}/{BUCKET}={b}" for b, wrote in manifest["buckets"].items() if only is None or int(b) in only]
        if not paths:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(*paths)

    # ------------------------------------------------------------ writing

    def merge(self, fresh: DataFrame, batch: int, merged: Callable[[DataFrame | None, DataFrame], DataFrame]) -> set[int]:
        """Applies one batch and returns the buckets that it rewrote.

        ``merged(old, fresh)`` gives the new rows of the touched buckets; ``old`` holds all
        their rows, or is None while the table is empty. It may change rows of the keys
        of ``fresh`` only. ``fresh`` is read twice: persist it if it is costly. Rows go to
        their bucket by one shuffle; the touched buckets, ``buckets`` at most, are all
        that reaches the driver.
        """
        spark = fresh.sparkSession
        done = self.batches(spark)
        if done and batch <= done[-1]:
            return set()
        before = self.manifest(spark, done[-1]) if done else None
        touched = {r[0] for r in fresh.select(self.bucket()).distinct().collect()}
        old = self._state(spark, before, touched) if before else None
        out = merged(old, fresh)
        target = f"{self.path}/data/{batch:012d}"
        placed = out.withColumn(BUCKET, self.bucket())
        parts = max(1, min(len(touched), self.buckets))
        placed.repartition(parts, BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(target)
        buckets = {**(before["buckets"] if before else {}), **{str(b): batch for b in self._written(spark, target)}}
        for gone in touched - self._written(spark, target):
            buckets.pop(str(gone), None)
        self._commit(spark, batch, {"schema": out.schema.jsonValue(), "buckets": buckets})
        self._clear(spark)
        return touched

    def _written(self, spark: SparkSession, target: str) -> set[int]:
        fs, folder = self._fs(spark, target)
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return {int(n.split("=")[1]) for n in names if n.startswith(f"{BUCKET}=")}

    def _clear(self, spark: SparkSession, keep: int = 2) -> None:
        """Deletes what only manifests older than the last ``keep`` name."""
        done = self.batches(spark)
        live = {(int(b), w) for m in done[-keep:] for b, w in self.manifest(spark, m)["buckets"].items()}
        for m in done[:-keep]:
            for b, wrote in self.manifest(spark, m)["buckets"].items():
                if (int(b), wrote) not in live:
                    fs, path = self._fs(spark, f"{self.path}/data/{wrote:012d}/{BUCKET}={b}")
                    fs.delete(path, True)
            fs, path = self._fs(spark, f"{self.path}/manifest/{m:012d}.json")
            fs.delete(path, False)


def newest(order: Sequence[Column], keys: Sequence[str]) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """Merge that keeps the first row by ``order`` of each key, old or fresh."""
    from ..operators.merge import latest

    def merged(old: DataFrame | None, fresh: DataFrame) -> DataFrame:
        best = latest(fresh, keys, order)
        return best if old is None else latest(best.unionByName(old), keys, order)

    return merged
