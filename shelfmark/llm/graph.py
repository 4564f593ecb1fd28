"""Connected components of a graph that is held in DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import small, written


def components(edges: DataFrame) -> DataFrame:
    """(u long, v long) links to (node, component): component is the smallest node that can be reached.

    Contraction: in each round every node joins its neighbour (or itself) of the lowest hash, links are redrawn
    between what nodes have joined, and links within one are dropped. As the hash differs from round to round, an
    expected constant share of the nodes goes in each, whatever the shape of the graph, so that chains take
    O(log n) rounds too. Nodes without links aren't returned. Repeated links, both directions and loops may occur;
    nulls are ignored. A node with many links only meets partial aggregates and joins that Spark can split.
    """
    links = edges.where("u is not null and v is not null")
    nodes = written(links.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "nodes")
    now = written(links.where("u <> v").select("u", "v").distinct(), "edges")
    joined = nodes.withColumn("at", F.col("node"))
    turn = 0
    while not now.isEmpty():
        turn += 1
        order = lambda c, turn=turn: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), c.alias("x"))
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        best = both.groupBy("u").agg(F.min(order(F.col("v"))).alias("m")).select("u", F.least("m", order(F.col("u")))["x"].alias("to"))
        best = small(written(best.where("u <> to"), "best"))
        by_u, by_v = best.toDF("u", "to_u"), best.toDF("v", "to_v")
        now = written(
            now.join(by_u, "u", "left").join(by_v, "v", "left")
            .select(F.coalesce("to_u", "u").alias("u"), F.coalesce("to_v", "v").alias("v"))
            .where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(),
            "edges",
        )
        joined = written(joined.join(best.toDF("at", "to"), "at", "left").select("node", F.coalesce("to", "at").alias("at")), "joined")
    least = joined.groupBy("at").agg(F.min("node").alias("component"))
    return joined.join(least, "at").select("node", "component")
