"""Micro-batch forms of the two refresh jobs: live signals and the rule ledger.

Both feed a keyed table. A batch rewrites only the buckets that its keys fall into and
is recorded under its id, so a replayed or retried batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.merge import latest, ledger_merge
from ..sources.keyed import KeyedTable, newest


BUCKETS = 64


def read_version(spark: SparkSession, table: str, before: int | None = None) -> DataFrame | None:
    """Newest state of a table, or the newest one below a batch id; None if there is none."""
    return KeyedTable(table, ()).read(spark, None if before is None else before - 1)


def signal_upsert(stream: DataFrame, table: str, checkpoint: str, keys: Sequence[str],
                  order: Sequence[Column], once: bool = True, buckets: int = BUCKETS) -> StreamingQuery:
    """Newest signal per key: each batch is reduced to its newest rows, then upserted.

    ``order`` sorts newest first. A late, older signal never replaces a newer one.
    """
    stored = KeyedTable(table, tuple(keys), buckets)

    def write(batch: DataFrame, batch_id: int) -> None:
        stored.merge(batch, batch_id, newest(order, keys))

    return _start(stream, write, checkpoint, once)


def ledger_stream(stream: DataFrame, table: str, checkpoint: str, key: str, call_cols: Sequence[str],
                  outcome_cols: Sequence[str], order: Sequence[Column], once: bool = True, buckets: int = BUCKETS) -> StreamingQuery:
    """Write-once ledger fed by a stream of calls; outcomes fill later.

    Inside a batch the first call of a key (by ``order``, oldest first) counts;
    ``batch_id`` says which batch recorded it.
    """
    stored = KeyedTable(table, (key,), buckets)

    def write(batch: DataFrame, batch_id: int) -> None:
        def merged(old: DataFrame | None, fresh: DataFrame) -> DataFrame:
            filled = fresh.groupBy(key).agg(*[F.max(c).alias(c) for c in outcome_cols])
            calls = latest(fresh.select(key, *call_cols), [key], order).join(filled, key)
            new = calls.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
            return new if old is None else ledger_merge(old, new, key, [*call_cols, "batch_id"], outcome_cols)

        stored.merge(batch, batch_id, merged)

    return _start(stream, write, checkpoint, once)


def _start(stream: DataFrame, write, checkpoint: str, once: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")
    return writer.start()
