"""What a task sorts does not follow the input: windows over events are dealt in parts of a bounded size."""

from pyspark.sql import functions as F

from codevitals import session
from codevitals.parsing.symbols import symbols


def test_more_events_make_more_tasks(spark, make_files, monkeypatch):
    monkeypatch.setattr(session, "PART_BYTES", 1 << 16)
    code = "".join(f"fn f{k}(a: u8) {{\n  g{k}(a);\n}}\n" for k in range(20))
    files = make_files({"a.rs": code}).crossJoin(spark.range(3000))
    files = files.withColumn("file", F.concat(F.sha2(F.col("id").cast("string"), 256), F.lit(".rs"))).drop("id")
    settings = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum")
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        rows = symbols(files, ["rust"])
        tasks = rows.groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sum(r["count"] for r in tasks) % 3000 == 0
    assert len(tasks) > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_smaller_settings_stay(spark):
    own = spark.newSession()
    size, count = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    own.conf.set(size, "512k")
    own.conf.set(count, "5000")
    session.small_parts(own)
    assert (session._bytes(own.conf.get(size)), own.conf.get(count)) == (512 << 10, "5000")
    own.conf.set(size, "64MB")
    own.conf.unset(count)
    session.small_parts(own)
    assert (int(own.conf.get(size)), int(own.conf.get(count))) == (session.PART_BYTES, session.PARTS)
