"""Session helpers: tuned defaults for tests and the cluster-shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the command line on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName("codevitals")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def command_session() -> SparkSession:
    """The session that the environment gives (spark-submit, a notebook, spark.master in its settings), else a local one."""
    if SparkSession.getActiveSession() or SparkConf().get("spark.master", None) or os.environ.get("SPARK_REMOTE"):
        return SparkSession.builder.appName("codevitals").getOrCreate()
    return local_session()


#: What a task that sorts is dealt at most, as shuffled bytes, and the parts that a shuffle is cut in before small ones are put together.
PART_BYTES, PARTS = 4 << 20, 2000


def small_parts(spark: SparkSession) -> None:
    """Shuffles of the session are dealt in parts of ``PART_BYTES``, as many as the rows need.

    Sorts hold a task's rows, which are many times larger than their shuffled bytes. Smaller settings of the session stay.
    """
    conf = spark.conf
    size, count = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    conf.set(size, str(min(PART_BYTES, _bytes(conf.get(size, None)))))
    conf.set(count, str(max(PARTS, int(conf.get("spark.sql.shuffle.partitions")), int(conf.get(count, None) or 0))))


def _bytes(text: str | None) -> int:
    """A size as Spark writes it (``64MB``, ``8m``, ``8388608b``); none is as large as can be."""
    found = re.fullmatch(r"(\d+)([kmgtp]?)(i?b)?", (text or "").strip().lower())
    return int(found[1]) << 10 * " kmgtp".index(found[2] or " ") if found else 1 << 62


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: ``spark.checkpoint.dir`` of the session.

    Only where the cluster names none (local tests) a temporary folder is used.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="codevitals-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
