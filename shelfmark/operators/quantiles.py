"""Exact ranks of values without a window over a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Parts into which a round cuts the range that holds a rank; rounds. What is left is a 32768th of a group.
PARTS, ROUNDS = 32, 3


def nearest_ranks(df: DataFrame, group: str, value: str, ps: list[float]) -> DataFrame:
    """(group, p, value): sorted[min(n - 1, floor(n * p))] of each group's values, nulls left out.

    Each round cuts the range that holds a rank at approximate quantiles, counts what lies in the parts, and goes on
    with one of them: rows are scanned and counted, never shuffled or sorted, and the result is exact whatever the cuts
    are. The last range's distinct values are counted and summed up in order.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"))
    n = rows.groupBy("g").agg(F.count("*").alias("n"), F.max("v").alias("high"))
    at = F.least(F.col("n") - 1, F.floor(F.col("n") * F.col("p")))
    seek = n.select("g", F.explode(F.array(*map(F.lit, ps))).alias("p"), "n", "high").select("g", "p", at.alias("rank"), F.lit(float("-inf")).alias("low"), "high")
    inside = lambda s: rows.join(s, rows.g.eqNullSafe(s.sg) & (rows.v > s.low) & (rows.v <= s.high))
    keyed = lambda s: s.withColumnRenamed("g", "sg")
    cuts = F.array(*(F.lit(k / PARTS) for k in range(1, PARTS)))
    for _ in range(ROUNDS):
        held = inside(keyed(seek))
        bounds = held.groupBy("sg", "p").agg(F.percentile_approx("v", cuts, 1000).alias("b"))
        part = held.join(bounds.select(F.col("sg").alias("bg"), F.col("p").alias("bp"), "b"), F.col("sg").eqNullSafe(F.col("bg")) & (F.col("p") == F.col("bp")))
        place = F.size(F.filter("b", lambda x: x < F.col("v")))
        found = part.groupBy("sg", "p", place.alias("i")).agg(F.count("*").alias("c"), F.max("v").alias("top"), F.min("v").alias("bottom"), F.first("rank").alias("rank"), F.first("low").alias("low"))
        order = Window.partitionBy("sg", "p").orderBy("i")
        run = found.withColumn("before", F.coalesce(F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("under", F.coalesce(F.lag("top").over(order), F.col("low")))
        seek = run.where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("c"))).select(F.col("sg").alias("g"), "p", (F.col("rank") - F.col("before")).alias("rank"), F.col("under").alias("low"), F.col("top").alias("high"))
    left = inside(keyed(seek)).groupBy("sg", "p", "v").agg(F.count("*").alias("c"), F.first("rank").alias("rank"))
    order = Window.partitionBy("sg", "p").orderBy("v")
    run = left.withColumn("upto", F.sum("c").over(order))
    return run.where("upto > rank and upto - c <= rank").select(F.col("sg").alias(group), "p", F.col("v").alias(value))
