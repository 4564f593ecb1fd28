"""Shared helpers: the cluster's shared folder, tables that cut lineage, global prefix sums, checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import reduce
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a lookup table that may be broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Bytes of text in such a table.
BROADCAST_BYTES = 64 << 20

#: Code points that separate words, as a regex class: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"

_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a folder of our own where
    none is set and all runs on one machine (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        now = spark.sparkContext._jsc.sc().getCheckpointDir()
        if now.isDefined():
            return now.get()
        if not spark.sparkContext.master.startswith("local["):  # one machine; local-cluster has executors of its own
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shelfmark-")
        spark.sparkContext.setCheckpointDir(found)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody else uses; what is put there goes when the driver ends."""
    path = f"{shared_folder(spark).rstrip('/')}/shelfmark-{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path, through Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _tidy() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session has ended; a folder of this machine can go all the same
            if path.startswith("file:"):
                shutil.rmtree(urlsplit(path).path, ignore_errors=True)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again.

    This cuts the lineage and survives lost executors, as every part is on shared storage; unlike checkpoint() it
    computes df once and keeps column pruning.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def digest_of(text: Column) -> Column:
    """128 bits that stand for a text (null: empty): no two texts of a corpus have the same, as good as surely."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for a broadcast if it has at most so many rows, and bytes in texts (counted here), else df as it is.

    df is cheap to read; columns other than texts have a fixed width.
    """
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)).cast("long") for f in df.schema.fields if f.dataType.simpleString() in ("string", "binary")]
    width = reduce(lambda a, b: a + b, texts, F.lit(0).cast("long"))
    n, held = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and held <= size else df


def by_file(files: DataFrame, most: int = 20_000) -> DataFrame:
    """A table of files, dealt out so that each is a task's own, or so many tasks share them.

    A stated number of partitions, as adaptive execution would put the few short rows into one.
    """
    return files.repartition(max(1, min(most, files.count())))


def prefix_sums(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """Adds, for each value column in sums, the sum over all rows before a row in the given order, under the given name.

    The rows are range partitioned and written, so that the parts' order is fixed; sums within a part come from a
    window on the part, and the parts' offsets from one row for each part. No task sees more than one part. `order`
    must be a total order for the result to be defined.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = written(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    parts = laid.groupBy("_part").agg(*(F.sum(v).alias(f"_{k}") for v, k in sums.items()))
    # one row for each partition: as many as there are tasks, whatever the input
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_part", *(F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in sums.values()))
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = laid.join(F.broadcast(offsets), "_part")
    return placed.withColumns({k: (F.coalesce(F.sum(v).over(within), F.lit(0)) + F.col(f"_{k}")).cast("long") for v, k in sums.items()}).drop("_part", *(f"_{k}" for k in sums.values()))
