"""Mixing sources to target weights: Sainte-Lague quotas of equal blocks for each shard, then seeded selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import WORD, prefix_sums, small, written

#: Words of a block; words of a shard, about (a row counts as ROW more, so that empty texts fill shards too).
BLOCK, SHARD, ROW = 32, 1 << 18, 16


def targets(sources: DataFrame, cycle: tuple[int, ...], most: int, share: float = 1.0) -> DataFrame:
    """Adds pos, weight and target to (source, source_size): a share of all sizes, dealt by weight, none over `most`
    times its source.

    Sources weigh cycle[0], cycle[1], ... repeating, by code point, null last. What a capped source can't take is
    dealt to the others by weight until none is over: the level at which that ends is found in the order of
    cap / weight, from sums of what comes before.
    """
    one = sources.withColumn("one", F.lit(1)).withColumn("last", F.col("source").isNull())
    ranked = prefix_sums(one, ["last", "source"], {"one": "pos"}).drop("one", "last")
    weight = F.element_at(F.array(*map(F.lit, cycle)), (F.col("pos") % len(cycle) + 1).cast("int"))
    capped = ranked.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("weight"))
    poured = written(prefix_sums(capped, ["ratio", "pos"], {"cap": "caps", "weight": "weights"}), "poured")
    total = poured.agg((F.sum("source_size") * F.lit(float(share))).alias("all"), F.sum("weight").alias("every"))
    at = (F.col("all") - F.col("caps")) / (F.col("every") - F.col("weights"))
    levels = poured.crossJoin(F.broadcast(total)).select("ratio", "pos", at.alias("at")).where("at <= ratio")
    level = levels.agg(F.min_by("at", F.struct("ratio", "pos")).alias("level"))  # one row
    return poured.crossJoin(F.broadcast(level)).withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce("level", F.lit(float(most))) * F.col("weight"))).select("source", "pos", "weight", "source_size", "target")


def apportion(cells: DataFrame, goal: str, seats: int) -> DataFrame:
    """Adds quota: `seats` dealt to the cells by the highest of goal / 1, goal / 3, goal / 5, ... (Sainte-Lague).

    All seats of a slightly too large divisor are surely won and those under a slightly too small one surely lost;
    only the few quotients of each cell between the two are ranked, by their value, then sid and shard.
    """
    n, total = cells.agg(F.count(F.when(F.col(goal) > 0, 1)), F.sum(goal)).first()
    if not n or not total or seats <= 0:
        return cells.withColumn("quota", F.lit(0).cast("long"))
    sure = max(0.0, seats - n / 2 - 1) / total
    may = (seats + n / 2 + 1) / total
    base = F.floor(F.col(goal) * sure + 0.5) if sure else F.lit(0)
    bounds = cells.withColumn("base", base.cast("long")).withColumn("top", F.floor(F.col(goal) * may + 0.5).cast("long"))
    left = seats - bounds.agg(F.sum("base")).first()[0]
    open_ = bounds.where(f"top > base and {goal} > 0").select("sid", "shard", F.explode(F.sequence(F.col("base"), F.col("top") - 1)).alias("k"), goal)
    quotients = open_.select("sid", "shard", "k", (-F.col(goal) / (2 * F.col("k") + 1)).alias("minus"), F.lit(1).alias("one"))
    won = prefix_sums(quotients, ["minus", "sid", "shard", "k"], {"one": "place"}).where(F.col("place") < left)
    more = won.groupBy("sid", "shard").agg(F.count("*").alias("more"))
    return bounds.join(more, ["sid", "shard"], "left").withColumn("quota", F.col("base") + F.coalesce("more", F.lit(0))).drop("base", "top", "more")


def mix(docs: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), most: int = 3, share: float = 1.0, seed: int = 1, block: int = BLOCK, shard: int = SHARD, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies of every row.

    size: words of the text (null: 0). A source's rows are dealt into shards by a seeded hash of doc_id and text, so
    that rows without an id or with one id are dealt out too, and laid in a ring in the order of that hash. The mix takes a shard's quota of blocks from a seeded block on, round and round, so
    every block is taken equally often, give or take one, and never over `most` times. taken: the words of the row so
    taken; copies: how often its middle word is, for those who mix whole rows. Rows with equal doc_id, source and text
    are alike; null ids and sources are values of their own. Nothing depends on partitions, so reruns agree.
    Columns in `carry` go along.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    order = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")))))
    sized = written(docs.select("doc_id", *carry, "source", size.alias("size"), order.alias("h")), "sized")
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    shards = F.greatest(F.lit(1), F.ceil((F.col("source_size") + F.col("rows") * ROW) / shard)).alias("shards")
    placed = targets(sums.select("source", "source_size"), cycle, most, share)
    sources = written(placed.join(sums.select(F.col("source").alias("s"), shards), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumnRenamed("pos", "sid"), "sources")
    known = small(sources.withColumnRenamed("source", "s"))
    cut = (F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % F.col("shards")).alias("shard")
    rows = sized.join(known, sized.source.eqNullSafe(known.s)).select("doc_id", *carry, "source", "size", "h", "sid", cut, "source_size", "target")
    laid = written(rows, "laid")
    lengths = laid.groupBy("sid", "shard").agg(F.sum("size").alias("length"), F.first("target").alias("target"), F.first("source_size").alias("source_size"))
    cells = written(lengths.select("sid", "shard", "length", F.when(F.col("source_size") > 0, F.col("target") * F.col("length") / F.col("source_size")).otherwise(0.0).alias("goal")), "cells")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    quotas = apportion(cells, "goal", round(total * share / block))
    tokens = F.least(F.col("quota") * block, F.col("length") * most)
    start = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "sid", "shard")), 1, 8), 16, 10).cast("long") % F.ceil(F.col("length") / block) * block
    arcs = quotas.where("length > 0").select("sid", "shard", "length", F.floor(tokens / F.col("length")).cast("long").alias("full"), (tokens % F.col("length")).alias("rest"), start.alias("start"))
    ring = Window.partitionBy("sid", "shard").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, -1)
    at = laid.withColumn("low", F.coalesce(F.sum("size").over(ring), F.lit(0)))
    on = at.join(small(written(arcs, "arcs")), ["sid", "shard"], "left")
    part = lambda a, b: F.greatest(F.lit(0), F.least(F.col("low") + F.col("size"), b) - F.greatest(F.col("low"), a))
    begin, end = F.col("start"), F.col("start") + F.col("rest")
    over = part(begin, end) + part(begin - F.col("length"), end - F.col("length"))
    middle = F.col("low") + F.floor(F.col("size") / 2)
    inside = ((middle >= begin) & (middle < end)) | (middle < end - F.col("length"))
    taken = F.coalesce(F.col("full") * F.col("size") + over, F.lit(0)).cast("long")
    copies = F.when(F.col("size") > 0, F.coalesce(F.col("full") + F.when(inside, 1).otherwise(0), F.lit(0))).otherwise(0).cast("int")
    return on.select("doc_id", *carry, "source", "size", "source_size", "target", taken.alias("taken"), copies.alias("copies"))
