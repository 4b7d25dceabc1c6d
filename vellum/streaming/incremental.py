"""An index that grows with a stream of documents.

Each micro-batch adds its entities and recounts only those it touches; a batch that is run again replaces itself, as its
rows are kept under its number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import retrieve


def entity_stream(documents: DataFrame, key: str, table: str, checkpoint: str, trigger: dict | None = None):
    """Starts a query that writes (key, entity, batch) of a stream of (key, text) to a folder partitioned by batch."""

    def one(batch: DataFrame, number: int) -> None:
        e = retrieve.entities(batch, key).withColumn("batch", F.lit(number))
        e.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(table)

    return documents.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})
    ).start()


def event_counts(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events by type in tumbling windows; rows later than the watermark are dropped from a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"),
    ).select(F.col("w.start").alias("start"), "event_type", "n", "total")


# --- a registry in keyed state ---------------------------------------------------------------------------------------

#: One row for each entity that a micro-batch touches: its documents so far, and whether it became a bridge or ceased to be one.
EVENTS = "entity string, df long, event string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _counter(config: retrieve.Config):
    """A processor that counts an entity's documents; its state is one number, however many documents there are."""
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Counter(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.df = handle.getValueState("df", "df long")

        def handleInputRows(self, key, rows, timers):
            before = self.df.get()[0] if self.df.exists() else 0
            now = before + sum(len(x) for x in rows)
            self.df.update((now,))
            inside = [config.least_df <= n <= config.most_df for n in (before, now)]
            event = {(False, True): "bridge", (True, False): "retracted"}.get(tuple(inside))
            yield pd.DataFrame({"entity": [key[0]], "df": [now], "event": [event]})

        def close(self) -> None:
            pass

    return Counter()


def registry_events(documents: DataFrame, key: str, config: retrieve.Config = retrieve.Config()) -> DataFrame:
    """EVENTS of a stream of (key, text).

    Each (entity, key) counts once, however often its document comes: repeats are dropped by a state that is dealt by entity
    and key, so the documents of a frequent entity are spread; only then rows of one entity meet, as one count.
    Needs the RocksDB state store (registry_stream() sets it).
    """
    once = retrieve.entities(documents, key).dropDuplicates(["entity", key])
    return once.groupBy("entity").transformWithStateInPandas(
        statefulProcessor=_counter(config), outputStructType=EVENTS, outputMode="Append", timeMode="None",
    )


def registry_stream(documents: DataFrame, key: str, table: str, checkpoint: str, config: retrieve.Config = retrieve.Config(), trigger: dict | None = None):
    """Starts a query that writes registry_events() to a folder partitioned by batch; a batch that is run again replaces itself."""
    spark = documents.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)

    def one(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(table)

    return registry_events(documents, key, config).writeStream.foreachBatch(one).outputMode("append").option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})
    ).start()


def registry_now(events: DataFrame) -> DataFrame:
    """(entity, df) of a folder of events: the last count of each entity."""
    return events.groupBy("entity").agg(F.max("df").alias("df"))


def bridges_now(events: DataFrame) -> DataFrame:
    """Entities whose last event made them a bridge."""
    told = events.where("event IS NOT NULL").groupBy("entity").agg(F.max_by("event", "batch").alias("event"))
    return told.where("event = 'bridge'").join(registry_now(events), "entity").select("entity", "df")
