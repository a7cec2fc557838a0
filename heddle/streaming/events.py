"""Incremental versions of the event operators on Structured Streaming.

``drain`` runs a query over all input that is there (trigger availableNow) and
returns the published table: the same code runs continuously with another
trigger. State lives in the checkpoint of the shared folder, so a query goes on
after the loss of an executor or of the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from heddle.operators.feedback import routed
from heddle.operators.references import clean_key
from heddle.sources.files import scratch


def stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's files as a stream of their schema."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")


def drain(df: DataFrame, mode: str, key: list[str] | None = None, order: str | None = None) -> DataFrame:
    """Run to the end of the input. ``append`` output is written as it comes; ``complete`` replaces the table each batch;
    ``update`` keeps, per key, the row of the latest batch."""
    spark = df.sparkSession
    out = scratch(spark, "stream")

    def publish(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/data/b={number if mode == 'update' else 0}")

    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True)
    query = writer.format("parquet").option("path", f"{out}/data").start() if mode == "append" else writer.foreachBatch(publish).start()
    query.awaitTermination()
    if mode == "append":
        return spark.read.schema(df.schema).parquet(f"{out}/data")
    rows = spark.read.parquet(f"{out}/data").drop("b")
    if mode == "update":
        rest = [c for c in df.columns if c not in key]
        rows = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("__batch", *([order] if order else []))).alias("r")).select(*[F.col(c) if c in key else F.col("r")[c].alias(c) for c in df.columns])
    return rows.select(*df.columns)


def once(events: DataFrame, delay: str = "400 days") -> DataFrame:
    """Events without repeated deliveries that come within ``delay`` of event time; the watermark bounds the state."""
    return events.withWatermark("event_ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def clean_parties(events: DataFrame) -> DataFrame:
    return events.withColumn("from_user", clean_key("from_user")).withColumn("about_user", clean_key("about_user"))


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Noisy-OR of severities: what is kept of a (user, id) is the product of 1 - severity and a count."""
    rest, n = state.get if state.exists else (1.0, 0)
    for b in batches:
        rest *= float((1.0 - b["severity"]).prod())
        n += len(b)
    state.update((rest, n))
    yield pd.DataFrame({"user_id": [key[0]], "id": [key[1]], "weight": [round(1.0 - rest, 6)], "n": [n]})


def preferences(items: DataFrame) -> DataFrame:
    """Running preference weights per (user, id), from a stream of routed items."""
    known = items.filter("from_user is not null").withColumnRenamed("from_user", "user_id")
    return known.groupBy("user_id", "id").applyInPandasWithState(_fold, "user_id string, id string, weight double, n long", "rest double, n long", "update", GroupStateTimeout.NoTimeout)


def preference_stream(spark: SparkSession, folder: str) -> DataFrame:
    return preferences(routed(clean_parties(once(stream(spark, folder, "match_events")))))
