"""Structured Streaming forms of the event-log operators, and their replay over a folder or file of Parquet."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A stream over Parquet; event times become TIMESTAMP, as watermarks need."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") and not _is_folder(spark, path) else spark.readStream.schema(schema).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    store, at = _path(spark, path)
    return store.getFileStatus(at).isDirectory()


def dedup(events: DataFrame, key: str = "event_id", wait: str = "10 minutes") -> DataFrame:
    """The first event of each key, with state kept only as long as late ones are waited for."""
    return events.withWatermark("ts", wait).dropDuplicatesWithinWatermark([key])


def by_minute(events: DataFrame, wait: str = "10 minutes") -> DataFrame:
    """Counts by minute and type."""
    return events.withWatermark("ts", wait).groupBy(F.window("ts", "1 minute").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("minute"), "event_type", "n")


def replay(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what there is and returns its result: as Parquet files, or the final table in complete mode."""
    spark = stream.sparkSession
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = root or "file://" + tempfile.mkdtemp(prefix="shelfmark-stream-")
    out = f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"
    remove = lambda path: _path(spark, path)[0].delete(_path(spark, path)[1], True)

    def write(batch: DataFrame, number: int) -> None:
        """A folder for each micro-batch: one that runs again replaces its own rows. In complete mode the last has all."""
        batch.write.mode("overwrite").parquet(f"{out}/data/batch={number if mode == 'append' else 0}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(write).start()
    try:
        q.awaitTermination()
    finally:
        remove(f"{out}/state")
    atexit.register(_quietly, remove, out)
    return spark.read.schema(stream.schema).option("basePath", f"{out}/data").parquet(f"{out}/data").select(*stream.columns)


def _quietly(f, *of) -> None:
    try:
        f(*of)
    except Exception:  # noqa: BLE001  the session has ended
        return


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def first_events(spark: SparkSession, path: str) -> DataFrame:
    done = replay(dedup(read_events(spark, path)), "append")
    return done.select("event_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"))


def minute_counts(spark: SparkSession, path: str) -> DataFrame:
    return replay(by_minute(read_events(spark, path)), "complete").withColumn("minute", F.col("minute").cast("timestamp_ntz"))
