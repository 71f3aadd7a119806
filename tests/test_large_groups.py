"""Quantiles of few large groups: no task holds a group's rows."""

from pyspark.sql import functions as F

from issuelens.operators import ordering


def test_rows_of_a_large_group_are_dealt_over_many_tasks(spark):
    rows = spark.range(0, 20_000, 1, 8).select(F.when(F.col("id") % 2 == 0, "a").alias("k"), F.lit(7.0).alias("__v"))
    few = spark.range(9).select(F.lit("b").alias("k"), F.col("id").cast("double").alias("__v"))
    both = rows.unionByName(few)
    stats = both.groupBy("k").agg(F.count("*").alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    before = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        marked = ordering._marked(both, stats, ["k"], 5_000)
        seen = marked.groupBy("k", F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.max("__n").alias("of")).collect()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    for k, n in (("a", 10_000), (None, 10_000), ("b", 9)):
        parts = [r for r in seen if r.k == k]
        assert sum(r.n for r in parts) == n and all(r.of == n for r in parts)
        assert k == "b" or max(r.n for r in parts) < n / 2
    got = {r.k: r.m for r in ordering.exact_quantile(both, ["k"], "__v", 0.5, "m").collect()}
    assert got == {"a": 7.0, None: 7.0, "b": 4.0}
