"""New chunk files into a table as they arrive, each chunk embedded once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from turnmill.operators.providers import Provider, embedded, not_yet


def ingest_chunks(spark: SparkSession, source: str, schema: T.StructType, target: str, checkpoint: str, provider: Provider, key: str = "chunk_id", text: str = "text") -> StreamingQuery:
    """Starts a stream that takes all files there are (and stops): JSON lines under ``source``,
    appended to the parquet folder ``target``.

    A chunk whose key is in the target already, or comes twice in a batch, is not embedded or
    written again, so that a repeated batch after a failure adds nothing.
    """

    def write(batch: DataFrame, _: int) -> None:
        new = batch.where(F.col(key).isNotNull()).dropDuplicates([key])
        try:
            done = batch.sparkSession.read.parquet(target)
        except Exception as e:  # the folder is not there before the first batch
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        else:
            new = not_yet(new, done, key)
        embedded(new, text, provider).write.mode("append").parquet(target)

    stream = spark.readStream.schema(schema).json(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
