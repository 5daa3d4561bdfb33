"""Running streams: sources on files, drains, periodic and manual triggers."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType


def shared_dir(spark: SparkSession) -> str:
    """Where sink and checkpoint files go: the session's shared folder; where that is unset, on one machine, a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return found or "/tmp/checkpoints/sightline"


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """``events`` as a stream with ``ts`` as TIMESTAMP (watermarks reject TIMESTAMP_NTZ) and ``seconds``."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path.replace("events.parquet", "event[s].parquet"))
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("seconds", F.unix_micros("ts") / 1e6)


def drained(stream: DataFrame, mode: str = "append", key: str | None = None) -> DataFrame:
    """Run a stream over all that is there now and read what it wrote; of a stream that updates, the last row of each ``key``.

    Each micro-batch is written to a folder of its own by number, so a batch that is run again after a failure replaces itself.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    if key is None:
        return spark.read.schema(stream.schema).parquet(f"{base}/out/*")
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(f"{base}/out")
    others = [c for c in stream.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), "batch").alias("__r")).select(key, "__r.*")


def periodic(stream: DataFrame, each: Callable[[DataFrame, int], None], seconds: float = 15, checkpoint: str | None = None) -> StreamingQuery:
    """Start ``each`` on the micro-batches of every ``seconds``; runs never overlap, a late one starts as soon as it can."""
    base = checkpoint or f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    return stream.writeStream.option("checkpointLocation", base).trigger(processingTime=f"{seconds} seconds").foreachBatch(each).start()


def once(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """A manual trigger: what has come since the last call, then stop."""
    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start().awaitTermination()


def stop(query: StreamingQuery, seconds: float = 20) -> bool:
    """Stop a query, waiting at most so long; whether it ended."""
    query.stop()
    return query.awaitTermination(int(seconds)) is not False
