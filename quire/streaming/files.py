"""Documents that arrive as files over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.pipeline import Options, normalize_texts


def normalize_stream(spark: SparkSession, source: str, target: str, checkpoint: str, options: Options = Options(), once: bool = True) -> StreamingQuery:
    """Normalise each new text file under source and append (path, text) Parquet to target.

    Documents are independent, so a micro-batch is an ordinary DataFrame to the batch plan, whose
    windows a streaming DataFrame could not hold. With once, the query ends when the files are done."""

    def batch(rows: DataFrame, _: int) -> None:
        keyed = rows.withColumn("doc_id", F.xxhash64("path"))
        done = normalize_texts(keyed.select("doc_id", "text"), options)
        keyed.select("doc_id", "path").join(done, "doc_id").select("path", "text").write.mode("append").parquet(target)

    texts = spark.readStream.format("text").option("wholetext", True).load(source)
    rows = texts.select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))
    writer = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
