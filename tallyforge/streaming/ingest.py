"""Incremental ingestion: new files of a folder, once per content."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tallyforge.sources.files import described, detected

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def ingest(spark: SparkSession, folder: str, target: str, checkpoint: str, stage: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Reads files as they arrive, describes them and appends those whose content the target does not hold yet.

    The anti-join on the content's hash makes a replayed batch append nothing twice.
    """
    stream = spark.readStream.schema(SCHEMA).format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "content")

    def append(batch: DataFrame, _: int) -> None:
        files = detected(described(batch)).dropDuplicates(["sha256"])
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(target)
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            files = files.join(spark.read.parquet(target).select("sha256"), "sha256", "left_anti")
        (stage(files) if stage else files.drop("content")).write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
