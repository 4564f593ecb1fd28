"""Leases of tasks as functions of (tasks, actions, now): claim, renew, release, recover; a lease has one owner.

tasks: id, type, status (QUEUED, RETRY, IMPORTING, ...), priority, attempts, max_attempts, owner, lease_until, next_run, error.
Each function returns all tasks with the same columns; what an online system locks is here decided by one rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _set(tasks: DataFrame, where: Column, **to: Column) -> DataFrame:
    """The tasks, with new values in the rows that the condition names."""
    hit = F.coalesce(where, F.lit(False))
    return tasks.withColumns({k: F.when(hit, v.cast(tasks.schema[k].dataType)).otherwise(F.col(k)) for k, v in to.items()})


def _after(now: Column, seconds) -> Column:
    return F.timestamp_add("SECOND", seconds if isinstance(seconds, Column) else F.lit(seconds), now)


def claim(tasks: DataFrame, now: Column, worker: str, most: int = 1, lease_s: int = 300) -> DataFrame:
    """The worker gets the `most` first of what is due or was left by a dead owner: by priority, then by time, then id."""
    due = (F.col("status").isin("QUEUED", "RETRY") & (F.col("next_run") <= now)) | ((F.col("status") == "IMPORTING") & (F.col("lease_until") < now))
    first = tasks.where(due).orderBy(F.desc("priority"), "next_run", "id").limit(most).select(F.col("id").alias("_id"))
    joined = tasks.join(F.broadcast(first), tasks.id == F.col("_id"), "left")  # as many rows as a worker takes
    got = _set(joined, F.col("_id").isNotNull(), status=F.lit("IMPORTING"), owner=F.lit(worker), lease_until=_after(now, lease_s), attempts=F.col("attempts") + 1)
    return got.drop("_id")


def renew(tasks: DataFrame, beats: DataFrame, now: Column, lease_s: int = 300) -> DataFrame:
    """Beats (id, worker) lengthen leases that the worker still owns; others change nothing."""
    b = beats.select(F.col("id").alias("_id"), F.col("worker").alias("_w")).distinct()
    on = (tasks.id == F.col("_id")) & (tasks.owner == F.col("_w")) & (tasks.status == "IMPORTING")
    return _set(tasks.join(b, on, "left"), F.col("_id").isNotNull(), lease_until=_after(now, lease_s)).drop("_id", "_w")


def release(tasks: DataFrame, ends: DataFrame, now: Column) -> DataFrame:
    """Ends (id, worker, status, error, delay_s), one for an id: the owner's result counts, also for tasks of nobody; a
    RETRY waits for its delay, a minute if it has none."""
    e = ends.select(F.col("id").alias("_id"), F.col("worker").alias("_w"), F.col("status").alias("_s"), F.col("error").alias("_e"), F.col("delay_s").alias("_d"))
    on = (tasks.id == F.col("_id")) & (tasks.owner.isNull() | (tasks.owner == F.col("_w")))
    next_run = F.when(F.col("_s") == "RETRY", _after(now, F.coalesce("_d", F.lit(60)))).otherwise(now)
    none = F.lit(None)
    done = _set(tasks.join(e, on, "left"), F.col("_id").isNotNull(), status=F.col("_s"), owner=none, lease_until=none, error=F.col("_e"), next_run=next_run)
    return done.drop("_id", "_w", "_s", "_e", "_d")


def recover(tasks: DataFrame, now: Column, recurring: Column, wait_s: int = 30) -> DataFrame:
    """Leases that are over: RETRY after a wait, or BLOCKED when the attempts are used up; recurring tasks never are."""
    over = (F.col("status") == "IMPORTING") & (F.col("lease_until") < now)
    spent = (F.col("attempts") >= F.col("max_attempts")) & ~F.coalesce(recurring, F.lit(False))
    none = F.lit(None)
    return _set(tasks, over, status=F.when(spent, "BLOCKED").otherwise("RETRY"), owner=none, lease_until=none, next_run=F.when(spent, F.col("next_run")).otherwise(_after(now, wait_s)), error=F.when(spent, "LEASE_EXPIRED_MAX_ATTEMPTS").otherwise("LEASE_EXPIRED"))
