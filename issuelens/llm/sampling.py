"""Bounded samples of labelled documents, drawn without shuffling the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from issuelens.llm.langid import held_out
from issuelens.llm.staging import thinned


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, sample: int) -> tuple[DataFrame, dict[int, int]]:
    """((id, y, rank, text) of at most ``sample`` documents a class, labelled rows of each class).

    Only rows outside the held-out fifth are drawn, by a hash of the key; of
    contradicting labels the larger counts. The drawn keys, 2 x ``sample`` at most, are
    broadcast. Rows that repeat a key give one text, the least.
    """
    known = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("id")).agg(F.max(label).alias("y")).where(~held_out("id"))
    sizes = {r.y: r["count"] for r in known.groupBy("y").count().collect()}  # two rows at most
    share = F.lit(1.0)
    for y, n in sizes.items():
        share = F.when(F.col("y") == y, 2 * sample / n).otherwise(share)
    rank = F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("id"), "id"))
    drawn = known.where(thinned(F.col("id"), share)).withColumn("rank", rank).where(F.col("rank") <= sample).select("id", "y", "rank")
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).where("text is not null")
    return texts.join(F.broadcast(drawn), "id").groupBy("id", "y", "rank").agg(F.min("text").alias("text")), sizes
