"""Reading the corpus tables and cutting lineage through written tables."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from issuelens.session import shared_dir


#: Deletes the shuffle files of a query when it ends, instead of when the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame) -> DataFrame:
    """The rows of ``df`` written to the shared folder and read again.

    Every later step reads files that all executors see, so a lost executor
    costs only the tasks it was running. Parquet keeps the copies narrow. The shuffles
    of the write are read by nothing else and go when it ends: left to the driver's
    garbage collector, those of many steps pile up on the executors' disks.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def dropped(*superseded: DataFrame) -> None:
    """Deletes the folders of ``staged`` tables that no later step reads.

    Only for tables whose every use has been written since: a lost executor then
    never needs them again.
    """
    for df in superseded:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def bounded_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Lets Python workers of this session read texts in batches of about ``size`` bytes.

    Spark's default counts 10,000 rows first, which is much memory where texts are long.
    A bound that the session sets below ``size`` stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jsparkSession.sessionState().conf().getConfString(name, "64m")
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) > size:
        spark.conf.set(name, size)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over the batches of a task, then what it freed goes back to the system.

    Spark uses Python workers again, and a worker's allocators keep freed memory, so
    tables and long texts of one stage would count against the executor in all later ones.
    """

    @wraps(run)
    def through(batches: Iterator) -> Iterator:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only where the C library has it
        if trim:
            trim(0)

    return through


def thinned(key: Column, share: Column) -> Column:
    """True for about ``share`` of the rows, chosen by a hash of the key."""
    luck = F.shiftrightunsigned(F.xxhash64(F.lit("thin"), key), 11) / F.lit(float(1 << 53))
    return luck < share


def apart(df: DataFrame, added: tuple[str, ...]) -> list[str]:
    """Columns of ``df`` whose names don't clash with the columns an operator adds."""
    taken = {x.lower() for x in added}
    return [c for c in df.columns if c.lower() not in taken]
