"""Rates, latencies and quality figures over the event log; as-of times come from the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.operators import quantiles
from shelfmark.plans.registry import Tables, query, sql


_VISIBLE = ", ".join(f"count(CASE WHEN ts >= z - INTERVAL {m} MINUTE THEN 1 END) AS visible_{m}" for m in (1, 5, 10, 30))
_FRESH = ", ".join(f"count(CASE WHEN event_type = 'purchase' AND ts >= z - INTERVAL {m} MINUTE THEN 1 END) AS fresh_{m}" for m in (5, 30))
# publications of the last 1, 5, 10 and 30 minutes at the end of every hour with events, fresh ones apart
sql("multi_window_rates", f"""
SELECT z, visible_1, visible_5, visible_10, visible_30, visible_1 AS rate_1, round(visible_5 / 5e0, 1) AS rate_5, round(visible_10 / 10e0, 1) AS rate_10, round(visible_30 / 30e0, 1) AS rate_30, fresh_5, fresh_30,
  round(fresh_5 / 5e0, 1) AS fresh_rate_5, round(fresh_30 / 30e0, 1) AS fresh_rate_30, greatest(0, visible_5 - fresh_5) AS backfill_5, greatest(0, visible_30 - fresh_30) AS backfill_30
FROM (SELECT z, {_VISIBLE}, {_FRESH} FROM (SELECT *, max(ts) OVER (PARTITION BY CAST(extract(EPOCH FROM ts) / 3600 AS BIGINT)) AS z FROM events) e GROUP BY z) x""".replace("CAST(extract(EPOCH FROM ts) / 3600 AS BIGINT)", "date_trunc('hour', ts)"))


@query("SELECT event_type, round(s[least(n - 1, floor(n * 0.5))::INT + 1], 1) AS p50, round(s[least(n - 1, floor(n * 0.95))::INT + 1], 1) AS p95 FROM (SELECT event_type, list_sort(list(value)) AS s, count(value) AS n FROM events GROUP BY event_type)")
def latency_nearest_rank(t: Tables) -> DataFrame:
    """The row of the wanted rank, found by narrowing its range: no task sorts or collects a group."""
    found = quantiles.nearest_ranks(t.events, "event_type", "value", [0.5, 0.95])
    return found.groupBy("event_type").agg(*(F.round(F.max(F.when(F.col("p") == p, F.col("value"))), 1).alias(name) for p, name in ((0.5, "p50"), (0.95, "p95"))))


@query("SELECT user_id AS source, count(*) AS n, coalesce(round(avg(value), 1), 0) AS mean, round(sum(value), 3) AS total, count(CASE WHEN event_type = 'error' THEN 1 END) AS errors FROM events GROUP BY user_id")
def source_stats(t: Tables) -> DataFrame:
    """Sums are of decimals with 18 places, so that a mean like 54.35 rounds up in whatever order its rows come; sources with
    values or sums from 1e20 on, or not finite, are summed as doubles."""
    rows = t.events.withColumn("exact", F.col("value").try_cast("decimal(38,18)"))
    total, n = F.when(F.count("exact") == F.count("value"), F.try_sum("exact")), F.count("value")
    mean = F.round(F.try_divide(total, n), 1).cast("double")
    return rows.groupBy(F.col("user_id").alias("source")).agg(
        F.count("*").alias("n"),
        F.coalesce(mean, F.round(F.avg("value"), 1), F.lit(0.0)).alias("mean"),
        F.coalesce(F.round(total, 3).cast("double"), F.round(F.sum("value"), 3)).alias("total"),
        F.count(F.when(F.col("event_type") == "error", 1)).alias("errors"),
    )


sql("slot_utilization", """
WITH s AS (SELECT CASE WHEN event_type IN ('click', 'purchase') THEN 'busy' WHEN event_type = 'error' THEN 'blocked' ELSE 'idle' END AS state, value FROM events)
SELECT state, count(*) AS samples, round(1e2 * count(*) / (SELECT count(*) FROM events), 2) AS share, round(avg(value), 4) AS occupancy, round(count(*) * 60 / (avg(value) * count(*)), 4) AS capacity FROM s GROUP BY state""")


@query("SELECT user_id, min(ts) FILTER (WHERE prev = 0 AND c > 0) AS first_at FROM (SELECT user_id, ts, (event_type = 'purchase')::INT AS c, coalesce(lag((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS prev FROM events) GROUP BY user_id")
def first_activation(t: Tables) -> DataFrame:
    """The first change from none to some; later ones don't move it."""
    on = (F.col("event_type") == "purchase").cast("int")
    prev = F.coalesce(F.lag(on).over(Window.partitionBy("user_id").orderBy("ts", "event_id")), F.lit(0))
    rows = t.events.select("user_id", "ts", on.alias("c"), prev.alias("prev"))
    return rows.groupBy("user_id").agg(F.min(F.when((F.col("prev") == 0) & (F.col("c") > 0), F.col("ts"))).alias("first_at"))


sql("retention_prune", "SELECT event_id FROM events CROSS JOIN (SELECT max(ts) AS z FROM events) x WHERE ts >= CASE WHEN event_type = 'error' THEN z - INTERVAL 24 HOUR WHEN event_type = 'purchase' THEN z - INTERVAL 7 DAY ELSE z - INTERVAL 48 HOUR END")
