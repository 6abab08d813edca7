"""Detection over streams: a document's spans need no state, so the batch functions run on a stream as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detect
from ..plans import catalogue


def documents(spark: SparkSession, path: str, schema, files_per_batch: int = 64) -> DataFrame:
    """A stream of the Parquet documents that land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", str(files_per_batch)).parquet(path)


def mentions(stream: DataFrame, table=catalogue.RUNTIME, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return detect.raw_spans(stream, table, id_col, text_col)


def windowed_counts(found: DataFrame, time_col: str, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by type in tumbling windows; events later than the watermark are left out."""
    return found.withWatermark(time_col, late).groupBy(F.window(time_col, length), "type").agg(F.count("*").alias("n"))


def counts_now(spark: SparkSession, path: str, schema, table, checkpoint: str, out: str) -> DataFrame:
    """Counts by type of all that the folder holds now, by a stream that ends when it has read it. out, checkpoint: shared folders."""
    found = detect.raw_spans(documents(spark, path, schema), table)

    def keep(batch: DataFrame, number: int) -> None:
        batch.groupBy("type").agg(F.count("*").alias("n")).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    found.writeStream.option("checkpointLocation", checkpoint).foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("type string, n long").parquet(out).groupBy("type").agg(F.sum("n").alias("n"))
