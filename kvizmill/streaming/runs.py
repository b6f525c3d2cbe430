"""Running a stream to its end and reading what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from kvizmill.session import shared_folder


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files. The path is a pattern, so that it may be one file or a folder."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/[{name[0]}]{name[1:]}.parquet")


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All rows a stream gives for the input that is there now, from a table in the shared folder.

    Each micro-batch is written as a folder of its own, so a batch that is
    done again after a failure replaces itself.
    """
    spark = stream.sparkSession
    at = f"{shared_folder(spark)}/kvizmill-stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/rows/batch={number}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
    writer.foreachBatch(write).start().awaitTermination()
    try:
        return spark.read.schema(stream.schema).parquet(f"{at}/rows/*")
    except Exception as e:  # no batch had rows
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], stream.schema)
        raise
