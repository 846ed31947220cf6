"""File versions arriving as a stream: parsed once per micro-batch, detected on the merged table.

Cross-file detectors need the whole symbol table, so each batch parses only the
arriving files, merges them into the stored table and runs detection on the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.scan import parse
from ..schema import FILES, SYMBOLS
from ..session import stored


def read_file_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of files tables dropped as Parquet into ``folder``."""
    return spark.readStream.schema(FILES).parquet(folder)


def latest(batch: DataFrame) -> DataFrame:
    """One version per file: the newest of the batch."""
    newest = Window.partitionBy("repo_id", "file").orderBy(F.desc("mtime"))
    return batch.withColumn("nth", F.row_number().over(newest)).filter("nth = 1").drop("nth")


#: Hash partitions of the stored tables; a batch rewrites those that its files fall into.
PARTS = 256


def with_part(rows: DataFrame, parts: int = PARTS) -> DataFrame:
    return rows.withColumn("part", F.pmod(F.xxhash64("repo_id", "file"), F.lit(parts)).cast("int"))


def merge_batch(store: str, langs: list[str] | None = None,
                on_update: Callable[[DataFrame, DataFrame, int], None] | None = None, parts: int = PARTS):
    """A ``foreachBatch`` function that keeps ``store/files`` and ``store/symbols``, both partitioned by a hash of the file.

    A batch reads and overwrites only the partitions of its files, so what it writes follows its size, and no older
    version is left. A replay finds the same files and writes the same rows.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession

        def table(label: str, schema) -> DataFrame:
            path = f"{store}/{label}"
            exists = spark._jvm.org.apache.hadoop.fs.Path(path)
            if not exists.getFileSystem(spark._jsc.hadoopConfiguration()).exists(exists):
                return spark.createDataFrame([], schema).withColumn("part", F.lit(0))
            return spark.read.schema(with_part(spark.createDataFrame([], schema)).schema).parquet(path).filter("file IS NOT NULL")

        arrived = stored(with_part(latest(batch), parts), "arrived")
        touched = [r.part for r in arrived.select("part").distinct().collect()]  # ``parts`` at most
        known = table("files", FILES).filter(F.col("part").isin(touched))
        # a version that comes late doesn't replace a newer one
        newer = known.select("repo_id", "file", F.col("mtime").alias("stored")).join(
            arrived.select("repo_id", "file", "mtime"), ["repo_id", "file"]).filter("stored > mtime")
        files = stored(arrived.join(newer.select("repo_id", "file"), ["repo_id", "file"], "left_anti"), "new-files")
        keys = files.select("repo_id", "file")
        # Symbols first: should the batch end between the two, its replay still finds these files new.
        for label, schema, new in (("symbols", SYMBOLS, with_part(parse(files.drop("part"), langs), parts)), ("files", FILES, files)):
            old = table(label, schema).filter(F.col("part").isin(touched))
            # A row without a file keeps each partition from being empty: what has no rows isn't overwritten.
            marks = arrived.select("part").distinct()
            merged = old.join(keys, ["repo_id", "file"], "left_anti").unionByName(new).unionByName(marks, allowMissingColumns=True)
            (merged.repartition("part").write.mode("overwrite").partitionBy("part")
             .option("partitionOverwriteMode", "dynamic").parquet(f"{store}/{label}"))
        if on_update:
            on_update(table("files", FILES).drop("part"), table("symbols", SYMBOLS).drop("part"), batch_id)

    return run
