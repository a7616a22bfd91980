"""Structured Streaming around the batch operators. These are additions; the batch operators define the results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.sources.sinks import stored


def new_vintages(store: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of a batch (series_id, obs_date, value, known_at) known after the last stored vintage whose value differs from it, and in turn from each other."""
    from tidemark.operators.market import append_if_changed

    last = store.groupBy("series_id", "obs_date").agg(F.max_by("value", "known_at").alias("value"), F.max("known_at").alias("known_at"))
    stored_at = last.select("series_id", "obs_date", F.col("known_at").alias("stored_at"))
    later = batch.join(stored_at, ["series_id", "obs_date"], "left").where("stored_at is null or known_at > stored_at")
    both = last.withColumn("new", F.lit(False)).unionByName(later.select("series_id", "obs_date", "value", "known_at").withColumn("new", F.lit(True)))
    return append_if_changed(both).where("new").drop("new")


def vintages_into(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what is new in each micro-batch; a batch that is run again adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        new_vintages(stored(batch.sparkSession, path, batch), batch).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_closes(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """Average price per series and day from a stream of prints (series_id, ts, price), days closed by a watermark."""
    day = F.window("ts", "1 day")
    return stream.withWatermark("ts", late).groupBy("series_id", day.alias("w")).agg(F.avg("price").alias("close"), F.count("*").alias("n")).select("series_id", F.to_date("w.start").alias("obs_date"), "close", "n")


def read_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
