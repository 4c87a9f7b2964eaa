"""Records as they come: the same row-wise operators over a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinfold.operators.tokens import record_tokens
from kinfold.sources.records import RECORD


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New tab-separated record files of a folder, with the fixed schema of records."""
    schema = ", ".join(f"{c} string" for c in RECORD)
    return spark.readStream.schema(schema).option("sep", "\t").option("header", True).option("quote", "").csv(folder)


def tokens_to_table(stream: DataFrame, path: str, checkpoint: str, learnt=None):
    """Normalise and tokenise each record once and append it to a Parquet table; exactly once by the checkpoint."""
    return record_tokens(stream, learnt).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
