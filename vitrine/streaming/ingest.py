"""Ingest as a file stream: each micro-batch has a place of its own under its catalogues, so a batch that runs again changes
nothing and a catalogue whose files come in several batches keeps them all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: The column that says which micro-batch a row came with.
BATCH = "batch"


class CatalogError(Exception):
    """A fault of the catalogues themselves: they are FAILED, and trying again would not help."""


def replace_partitions(rows: DataFrame, path: str, *keys: str) -> None:
    """Overwrite the partitions of the keys in `rows`, and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def ingest(stream: DataFrame, key: str, sink: str, checkpoint: str, process: Callable[[DataFrame], DataFrame], status: str | None = None) -> StreamingQuery:
    """Run `process` on every micro-batch and put its rows into the sink by key and batch; start with what is there.

    status: a folder, beside the sink if it is not given, that gets a row for each key and batch: state PROCESSING, then
    READY, or FAILED with the error where `process` raises CatalogError. Any other exception stops the stream; the batch
    is not committed, its keys stay PROCESSING, and the next run takes it again.
    """
    states = status or f"{sink.rstrip('/')}-status"

    def batch(df: DataFrame, number: int) -> None:
        df = df.persist()
        try:
            keys = df.select(key).distinct()

            def say(state: str, error: str | None = None) -> None:
                row = keys.select(key, F.lit(state).alias("state"), F.lit(error).cast("string").alias("error"), F.lit(number).cast("long").alias(BATCH))
                row.write.mode("overwrite").parquet(f"{states}/batch={number}")

            say("PROCESSING")
            try:
                replace_partitions(process(df).withColumn(BATCH, F.lit(number).cast("long")), sink, key, BATCH)
            except CatalogError as e:
                say("FAILED", str(e)[:500])
            else:
                say("READY")
        finally:
            df.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def forget(spark: SparkSession, sink: str, key: str, values: list) -> None:
    """Delete what the sink holds of these keys: a catalogue that is processed anew begins empty."""
    jvm = spark._jvm
    for value in values:
        path = jvm.org.apache.hadoop.fs.Path(f"{sink.rstrip('/')}/{key}={value}")
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def latest_state(spark: SparkSession, status: str, key: str) -> DataFrame:
    """The last state of each key."""
    rows = spark.read.schema(f"`{key}` long, state string, error string, {BATCH} long").option("recursiveFileLookup", True).parquet(status)
    return rows.groupBy(key).agg(F.max_by("state", BATCH).alias("state"), F.max_by("error", BATCH).alias("error"), F.max(BATCH).alias(BATCH))


def progress(query: StreamingQuery) -> dict[str, int]:
    """Rows and batches so far: what a page that polls would show."""
    seen = query.recentProgress
    return {"batches": len(seen), "rows": sum(int(p["numInputRows"]) for p in seen)}
