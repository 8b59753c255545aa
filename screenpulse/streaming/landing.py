"""Day files as a stream: each new folder of rating rows is landed and folded into the history, exactly once a day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import history
from ..sources.tables import Store


def land(spark: SparkSession, incoming: str, root: Store, checkpoint: str) -> StreamingQuery:
    """Follow a folder of Parquet files with history.SCHEMA; a batch's days are landed unless held, then folded.

    A batch that runs again finds its days held and changes nothing.
    """

    def take(batch: DataFrame, _: int) -> None:
        rows = batch.persist()
        have = history.known_days(root)
        for r in rows.select("date").distinct().collect():
            if r["date"] not in have:
                history.write_day(root, rows.where(F.col("date") == F.lit(r["date"])), r["date"])
        history.compact(root)
        rows.unpersist()

    stream = spark.readStream.schema(history.SCHEMA).parquet(incoming)
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
