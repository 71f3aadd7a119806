"""Report folders are made by many tasks and listed in few."""

from pathlib import Path

from issuelens.catalog import QUERIES
from issuelens.session import shared_dir


def test_report_folders_are_written_by_many_tasks(spark, tmp_path):
    spark.range(40).selectExpr("id AS s_suppkey", "concat('S', id) AS s_name", "int(id % 5) AS s_nationkey", "double(id) AS s_acctbal") \
        .coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    listing = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    seen = set(Path(shared_dir(spark)).glob("reports-*"))
    got = QUERIES["report_scan"](spark, str(tmp_path)).collect()
    assert {(r.cg_ipo_id, r.company, r.overall) for r in got} == {(str(i), f"S{i}", float(i)) for i in range(40) if i % 9 != 4}
    folder, = set(Path(shared_dir(spark)).glob("reports-*")) - seen
    parts = [f.name.split("-")[1] for f in folder.glob("id=*/part-*")]
    assert len(parts) == 40 and len(set(parts)) > 1
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == listing
