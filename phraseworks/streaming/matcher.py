"""Policies over streams of documents: the batch projection, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from phraseworks.operators.matching import test_policy


def document_stream(spark: SparkSession, path: str, schema: str = "doc_id bigint, text string", files_per_trigger: int = 16) -> DataFrame:
    """Documents of the Parquet files below ``path`` (a folder, or one file of a folder) as they arrive."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(at).isFile():
        return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    return reader.parquet(path)


def match_stream(docs: DataFrame, policy_text: str) -> DataFrame:
    return test_policy(docs, policy_text)


def write_matches(docs: DataFrame, policy_text: str, out: str, checkpoint: str) -> StreamingQuery:
    """Appends the results as Parquet, each document exactly once; ends when the available files are done."""
    return match_stream(docs, policy_text).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
