"""Ordered sequences with gaps: manifests, missing keys, frontiers, intervals that cover keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gaps(keys: DataFrame, group: str, key: str) -> DataFrame:
    """(group, kind, start, end): MISSING_START if a group's first key is over 1, INTERNAL between whole numbers that skip some.

    Keys may repeat; one window over distinct keys finds both kinds, in one pass.
    """
    w = Window.partitionBy(group).orderBy(key)
    k = keys.select(group, key).where(F.col(key).isNotNull()).distinct().withColumn("_next", F.lead(key).over(w)).withColumn("_prev", F.lag(key).over(w))
    row = lambda kind, start, end: F.struct(F.lit(kind).alias("kind"), start.cast("long").alias("start"), end.cast("long").alias("end"))
    first = F.when(F.col("_prev").isNull() & (F.col(key) > 1), row("MISSING_START", F.lit(1), F.ceil(key) - 1))
    inner = F.when(F.floor("_next") - F.floor(key) > 1, row("INTERNAL", F.floor(key) + 1, F.floor("_next") - 1))
    return k.select(group, F.inline(F.filter(F.array(first, inner), lambda x: x.isNotNull())))


def covered(points: DataFrame, intervals: DataFrame, group: str, key: str, inside: bool = True) -> DataFrame:
    """Points that an interval (group, start, end) of their group covers, or those that none does.

    Points and intervals are swept together in the order of their places: a point is covered if the furthest end of all
    intervals begun so far reaches it. No point meets an interval in a join, so a hot group costs its sort.
    """
    at = F.col(key).cast("double")
    rows = points.select(F.struct(*points.columns).alias("_row"), F.col(group).alias("_g"), at.alias("_at"), F.lit(None).cast("double").alias("_end"))
    begun = intervals.select(F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), F.col(group).alias("_g"), F.col("start").cast("double").alias("_at"), F.col("end").cast("double").alias("_end"))
    sweep = Window.partitionBy("_g").orderBy("_at", F.col("_end").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = rows.unionByName(begun).withColumn("_far", F.max("_end").over(sweep)).where("_end is null")
    reached = F.coalesce((F.col("_far") >= F.col("_at")) & F.col("_g").isNotNull(), F.lit(False))
    return swept.where(reached if inside else ~reached).select("_row.*")


def increasing(rows: DataFrame, group: str, order: str, time: str, step_ms: int = 1) -> DataFrame:
    """rows with `time` moved on where it must be, to be `step_ms` after the row before it in its group at least.

    One pass: the greatest of the times so far, each moved on by a step for every row since.
    """
    w = Window.partitionBy(group).orderBy(order)
    back = F.unix_micros(F.col(time).cast("timestamp")) - F.row_number().over(w) * F.lit(1000 * step_ms)
    place = rows.withColumn("_back", back).withColumn("_n", F.row_number().over(w))
    first = F.max("_back").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    moved = F.timestamp_micros(first + F.col("_n") * F.lit(1000 * step_ms)).cast(rows.schema[time].dataType)
    return place.withColumn(time, F.when(F.col(time).isNotNull(), moved)).drop("_back", "_n")


def barrier(chapters: DataFrame, confirmed: DataFrame, group: str, key: str, first: float = 1.5, step: float = 1.05) -> DataFrame:
    """(group, key, reason, blocking) of every chapter that isn't published: whether it may be, and how many keep it back.

    chapters: group, key, published, completed, gap (rows of several sources); confirmed: group, start, end. Without a
    published chapter all may start, but for later ones while a first one is pending that no gap explains. At or below
    the newest published key is backfill; a step on is clear. Beyond it, keys between that are pending keep a chapter
    back, and so does nothing between, unless a gap is known there. Null keys are ignored. Windows by group only.
    """
    none = F.lit(False)
    any_of = lambda c: F.bool_or(F.coalesce(c, none))
    keys = chapters.where(F.col(key).isNotNull()).groupBy(group, key).agg(any_of(F.col("published")).alias("published"), any_of(F.col("completed")).alias("completed"), any_of(F.col("gap")).alias("gap"), any_of(~F.coalesce("gap", none)).alias("real"), any_of(~F.coalesce("gap", none) & ~F.coalesce("completed", none)).alias("open"))
    of = Window.partitionBy(group)
    keys = keys.withColumn("newest", F.max(F.when(F.col("published"), F.col(key))).over(of))
    early = F.col(key) <= first
    keys = keys.withColumn("pending_first", F.max(early & F.col("open")).over(of)).withColumn("gap_first", F.max(early & F.col("gap")).over(of))
    # confirmed gaps by their reach: over a key, from the first chapters on, and from the newest published on
    marked = covered(keys.select(group, key), confirmed, group, key).withColumn("inside", F.lit(True))
    keys = keys.join(marked, [group, key], "left")
    newest = keys.groupBy(group).agg(F.first("newest").alias("_newest"))
    reach = confirmed.join(newest, group).groupBy(group).agg(F.max(F.when(F.col("start") <= first, F.col("end"))).alias("from_first"), F.max(F.when(F.col("start") <= F.col("_newest") + 1, F.col("end"))).alias("from_newest"))
    keys = keys.join(reach, group, "left")
    before = Window.partitionBy(group).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    beyond = F.col(key) > F.col("newest")
    pending = beyond & F.col("real") & ~F.coalesce("inside", none) & ~F.col("completed")
    keys = keys.withColumn("waits", F.count(F.when(pending, 1)).over(before)).withColumn("known", F.coalesce(F.max(beyond & F.col("gap")).over(before), none))
    on = F.col(key) - F.col("newest")
    waiting = (F.col(key) > first) & F.col("pending_first") & ~F.col("gap_first") & ~F.coalesce(F.col("from_first") >= F.col(key) - 1, none)
    unresolved = ~F.col("known") & ~F.coalesce(F.col("from_newest") >= F.col(key) - 1, none)
    cases = (
        (F.col("newest").isNull() & waiting, "WAITING_FOR_INITIAL_CHAPTERS", F.lit(1)), (F.col("newest").isNull(), "INITIAL_CHAPTER_CLEAR", F.lit(0)), (on <= 0, "BACKFILL_CLEAR", F.lit(0)), (on <= step, "BARRIER_CLEAR", F.lit(0)),
        (F.col("waits") > 0, "UNPUBLISHED_PRECEDING_CHAPTERS", F.col("waits")), (unresolved, "UNRESOLVED_GAP", F.greatest(F.lit(1), F.floor(on) - 1)),
    )
    found = F.struct(F.lit("BARRIER_CLEAR").alias("reason"), F.lit(0).cast("long").alias("blocking"))
    for rule, reason, n in reversed(cases):
        found = F.when(rule, F.struct(F.lit(reason).alias("reason"), n.cast("long").alias("blocking"))).otherwise(found)
    return keys.where(~F.col("published")).select(group, key, found.alias("f")).select(group, key, "f.*")


def without_earlier(rows: DataFrame, group: str, key: str, pending: Column) -> DataFrame:
    """Pending rows with no earlier pending row in their group: the anti join with `<` as one window."""
    w = Window.partitionBy(group)
    return rows.where(pending).withColumn("_first", F.min(key).over(w)).where(F.col(key) == F.col("_first")).drop("_first")
