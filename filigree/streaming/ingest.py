"""Incremental ingest of dictionary records: file source, keyed upsert per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from filigree.operators import parse
from filigree.sources.tables import keep_last


def stream_words(spark: SparkSession, folder: str, table: str, checkpoint: str) -> StreamingQuery:
    """Parse new JSON-line files of a folder and append a version of each word.

    A batch keeps the last entry of a key; :func:`current` gives the last version.
    A batch that runs again writes its own folder anew, so nothing is doubled.
    """
    lines = spark.readStream.format("text").load(folder)

    def put(batch: DataFrame, number: int) -> None:
        raw = batch.select(F.monotonically_increasing_id().alias("line"), F.from_json("value", parse.RECORD).alias("r")).where("r IS NOT NULL").select("line", "r.*")
        keep_last(parse.words(raw), ["word", "pos"], [F.col("line")]).drop("line").write.mode("overwrite").parquet(f"{table}/batch={number}")

    return lines.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, table: str) -> DataFrame:
    """The last version of each word."""
    return keep_last(spark.read.parquet(table), ["word", "pos"], [F.col("batch")]).drop("batch")
