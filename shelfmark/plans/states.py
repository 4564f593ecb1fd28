"""State transitions as batch functions of (tables, as-of time): leases, queues, cooldowns, schedules, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.operators import folds, leases
from shelfmark.plans.registry import Tables, query, sql

# tasks are orders: state from the status, attempts and leases from the keys, as-of the newest date
_TASKS = """SELECT o_orderkey AS id, o_custkey AS work, CASE o_orderstatus WHEN 'O' THEN 'READY' WHEN 'F' THEN 'RUNNING' ELSE 'DONE' END AS state, CAST(o_orderkey % 6 AS INT) AS attempts,
 o_orderdate AS updated_at, o_orderdate + INTERVAL 30 DAY AS lease_until, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 0 WHEN '2' THEN 1 WHEN '3' THEN 2 ELSE 3 END AS priority FROM orders"""
_NOW = "(SELECT max(o_orderdate) FROM orders)"

# the same as leased tasks: every 7th recurs, workers are w0, w1, w2
_LEASED = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'DISCOVER' ELSE 'CHAPTER' END AS type, CASE o_orderstatus WHEN 'O' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'QUEUED' ELSE 'RETRY' END WHEN 'F' THEN 'IMPORTING' ELSE 'COMPLETED' END AS status,
  CAST(o_orderkey % 100 AS INT) AS priority, CAST(o_orderkey % 6 AS INT) AS attempts, 5 AS max_attempts, CASE WHEN o_orderstatus = 'F' THEN 'w' || CAST(o_orderkey % 3 AS {text}) END AS owner,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 900 DAY END AS lease_until, o_orderdate AS next_run, CAST(NULL AS {text}) AS error FROM orders"""


def _leased(t: Tables) -> tuple[DataFrame, Column]:
    o = t.orders
    key, state = F.col("o_orderkey"), F.col("o_orderstatus")
    status = F.when(state == "O", F.when(key % 2 == 0, "QUEUED").otherwise("RETRY")).when(state == "F", "IMPORTING").otherwise("COMPLETED")
    running = state == "F"
    tasks = o.select(
        key.alias("id"), F.when(key % 7 == 0, "DISCOVER").otherwise("CHAPTER").alias("type"), status.alias("status"), (key % 100).cast("int").alias("priority"), (key % 6).cast("int").alias("attempts"), F.lit(5).alias("max_attempts"),
        F.when(running, F.concat(F.lit("w"), (key % 3).cast("string"))).alias("owner"), F.when(running, F.col("o_orderdate") + F.expr("INTERVAL 900 DAY")).alias("lease_until"), F.col("o_orderdate").alias("next_run"), F.lit(None).cast("string").alias("error"),
    )
    return tasks, F.lit(o.agg(F.max("o_orderdate")).first()[0])


@query(f"""
WITH t AS ({_LEASED.format(text='VARCHAR')}), n AS (SELECT max(o_orderdate) AS now FROM orders), x AS (SELECT t.*, now, status = 'IMPORTING' AND lease_until < now AS over, attempts >= max_attempts AND type <> 'DISCOVER' AS spent FROM t, n)
SELECT id, CASE WHEN NOT coalesce(over, false) THEN status WHEN spent THEN 'BLOCKED' ELSE 'RETRY' END AS status, CASE WHEN over THEN NULL ELSE owner END AS owner, CASE WHEN over AND NOT spent THEN now + INTERVAL 30 SECOND ELSE next_run END AS next_run,
  CASE WHEN over THEN CASE WHEN spent THEN 'LEASE_EXPIRED_MAX_ATTEMPTS' ELSE 'LEASE_EXPIRED' END END AS error FROM x""")
def lease_recovery(t: Tables) -> DataFrame:
    """Leases that are over go back to the queue, or are blocked; recurring types are exempt from the limit of attempts."""
    tasks, now = _leased(t)
    return leases.recover(tasks, now, F.col("type") == "DISCOVER").select("id", "status", "owner", "next_run", "error")


@query(f"""
WITH t AS ({_LEASED.format(text='VARCHAR')}), n AS (SELECT max(o_orderdate) AS now FROM orders),
beat AS (SELECT t.* REPLACE (CASE WHEN status = 'IMPORTING' AND id % 4 = 0 AND owner = 'w' || (id % 2) THEN now + INTERVAL 300 SECOND ELSE lease_until END AS lease_until), now FROM t, n),
rel AS (SELECT *, id % 10 = 3 AND (owner IS NULL OR owner = 'w0') AS ends FROM beat),
fin AS (SELECT id, CASE WHEN ends THEN CASE WHEN id % 20 = 3 THEN 'RETRY' ELSE 'COMPLETED' END ELSE status END AS status, priority, attempts, CASE WHEN ends THEN NULL ELSE owner END AS owner, CASE WHEN ends THEN NULL ELSE lease_until END AS lease_until,
  CASE WHEN ends THEN CASE WHEN id % 20 = 3 THEN now + to_seconds(coalesce(CASE WHEN id % 3 = 0 THEN 5 END, 60)::BIGINT) ELSE now END ELSE next_run END AS next_run, now FROM rel),
got AS (SELECT id AS g FROM fin WHERE (status IN ('QUEUED', 'RETRY') AND next_run <= now) OR (status = 'IMPORTING' AND lease_until < now) ORDER BY priority DESC, next_run, id LIMIT 25)
SELECT id, CASE WHEN g IS NULL THEN status ELSE 'IMPORTING' END AS status, attempts + CASE WHEN g IS NULL THEN 0 ELSE 1 END AS attempts, CASE WHEN g IS NULL THEN owner ELSE 'w9' END AS owner, CASE WHEN g IS NULL THEN lease_until ELSE now + INTERVAL 300 SECOND END AS lease_until, next_run
FROM fin LEFT JOIN got ON g = id""")
def lease_lifecycle(t: Tables) -> DataFrame:
    """A round of beats, ends and claims: beats and ends of workers that don't own the task change nothing."""
    tasks, now = _leased(t)
    key = F.col("o_orderkey")
    beats = t.orders.where("o_orderkey % 4 = 0").select(key.alias("id"), F.concat(F.lit("w"), (key % 2).cast("string")).alias("worker"))
    ends = t.orders.where("o_orderkey % 10 = 3").select(key.alias("id"), F.lit("w0").alias("worker"), F.when(key % 20 == 3, "RETRY").otherwise("COMPLETED").alias("status"), F.lit(None).cast("string").alias("error"), F.when(key % 3 == 0, 5).alias("delay_s"))
    after = leases.release(leases.renew(tasks, beats, now), ends, now)
    return leases.claim(after, now, "w9", 25).select("id", "status", "attempts", "owner", "lease_until", "next_run")


sql("enqueue_revive", f"""
WITH q AS ({_TASKS}), i AS (SELECT id, min(p) AS p FROM (SELECT o_orderkey + 5 AS id, CAST(o_orderkey % 3 AS INT) AS p FROM orders WHERE o_totalprice > 200000) x GROUP BY id)
SELECT coalesce(q.id, i.id) AS id, CASE WHEN q.id IS NULL THEN 'READY' WHEN i.id IS NOT NULL AND q.state = 'DONE' THEN 'READY' ELSE q.state END AS state, least(coalesce(q.priority, 3), coalesce(i.p, 3)) AS priority FROM q FULL JOIN i ON q.id = i.id""")
sql("priority_overlay", f"SELECT id, CASE WHEN EXISTS (SELECT 1 FROM customer WHERE c_custkey = work AND c_acctbal > 9000) THEN 0 ELSE priority END AS priority FROM ({_TASKS}) t")
sql("latest_per_work", "SELECT c_custkey AS work, max(CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END) AS latest FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
_READY = f"""
WITH t AS ({_TASKS}), h AS (SELECT *, row_number() OVER (PARTITION BY work ORDER BY updated_at, id) AS n FROM t WHERE state <> 'DONE'),
f AS (SELECT work, min(CASE WHEN state = 'READY' THEN n END) AS n FROM h WHERE n <= 12 GROUP BY work),
r AS (SELECT o_custkey AS work, bool_or(o_totalprice > 100000) AS usable, min(greatest(o_orderdate, TIMESTAMP_NTZ '1996-01-01 00:00:00')) AS cool FROM orders GROUP BY o_custkey),
fallback AS (SELECT work, min(id) AS id FROM t WHERE state = 'RUNNING' GROUP BY work)
SELECT coalesce(a.work, b.work) AS work, coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'FALLBACK' ELSE 'FRONTIER' END AS kind, CASE WHEN coalesce(r.usable, false) THEN NULL ELSE r.cool END AS available_at
FROM (SELECT h.work, h.id FROM h JOIN f ON h.work = f.work AND h.n = f.n) a FULL JOIN fallback b ON a.work = b.work LEFT JOIN r ON r.work = coalesce(a.work, b.work)"""
sql("ready_projection", _READY, _READY.replace("TIMESTAMP_NTZ '", "TIMESTAMP '"))
sql("cooldown_recovery", """
WITH r AS (SELECT l_partkey AS work, l_suppkey AS source, bool_or(l_returnflag = 'A' AND l_linestatus = 'F') AS ready, min(l_shipdate) AS next_at FROM lineitem GROUP BY l_partkey, l_suppkey),
w AS (SELECT work FROM r GROUP BY work HAVING NOT bool_or(ready) AND min(next_at) < (SELECT max(l_shipdate) FROM lineitem)),
a AS (SELECT r.*, row_number() OVER (PARTITION BY r.work ORDER BY next_at, source) AS n FROM r JOIN w ON r.work = w.work),
b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY next_at, work) AS lane FROM a WHERE n = 1)
SELECT work, source, next_at FROM b WHERE lane <= 4""")
sql("due_sources", """
WITH l AS (SELECT l_suppkey AS source, max(l_shipdate) AS last_at, count(CASE WHEN l_linestatus = 'O' AND l_quantity > 49 THEN 1 END) AS live FROM lineitem GROUP BY l_suppkey)
SELECT s_suppkey AS source FROM supplier LEFT JOIN l ON source = s_suppkey WHERE coalesce(last_at + CASE WHEN s_acctbal > 5000 THEN INTERVAL 1 DAY ELSE INTERVAL 20 DAY END <= (SELECT max(l_shipdate) FROM lineitem), true) AND coalesce(live, 0) < 20""")
sql("capped_by_outstanding", f"""
WITH o AS (SELECT work % 50 AS lane, count(*) AS n FROM ({_TASKS}) t WHERE state = 'RUNNING' GROUP BY work % 50),
r AS (SELECT id, work % 50 AS lane, row_number() OVER (PARTITION BY work % 50 ORDER BY priority, updated_at, id) AS k FROM ({_TASKS}) t WHERE state = 'READY')
SELECT id, r.lane FROM r LEFT JOIN o ON o.lane = r.lane WHERE k <= greatest(0, 200 - coalesce(o.n, 0))""")
sql("bounded_due_excluding", f"""
WITH d AS (SELECT * FROM ({_TASKS}) t WHERE state = 'READY' ORDER BY updated_at, id LIMIT 64), b AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
SELECT id, work FROM d WHERE NOT EXISTS (SELECT 1 FROM b WHERE c_custkey = work) ORDER BY updated_at, id LIMIT 20""")
sql("receipt_recovery", """
WITH u AS (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN 'UNKNOWN' WHEN doc_id % 3 = 1 THEN 'INTENT' ELSE 'PERSISTED' END AS state, doc_id % 40 AS age, doc_id % 20 AS task FROM documents),
p AS (SELECT DISTINCT text FROM u WHERE state = 'PERSISTED'),
n AS (SELECT u.doc_id, task, CASE WHEN u.state = 'UNKNOWN' AND p.text IS NOT NULL THEN 'PERSISTED' WHEN u.state = 'INTENT' AND age > 15 THEN 'BLOCKED' ELSE u.state END AS state FROM u LEFT JOIN p ON p.text = u.text)
SELECT doc_id, state, task, NOT EXISTS (SELECT 1 FROM n x WHERE x.task = n.task AND x.state IN ('UNKNOWN', 'INTENT')) AS reopened FROM n""")
sql("missing_successor", "SELECT o_orderkey AS id FROM orders a WHERE o_orderstatus = 'F' AND NOT EXISTS (SELECT 1 FROM (SELECT 'next:' || CAST(o_orderkey AS STRING) AS k FROM orders WHERE o_totalprice > 50000) b WHERE b.k = 'next:' || CAST(a.o_orderkey + 1 AS STRING))")
sql("demote_behind_predecessor", f"""
WITH t AS (SELECT *, min(CASE WHEN state = 'READY' THEN id END) OVER (PARTITION BY work) AS first_pending FROM ({_TASKS}) x)
SELECT id, CASE WHEN priority <= 1 AND state = 'READY' AND first_pending < id AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = work AND c_acctbal > 9000) THEN 3 ELSE priority END AS priority FROM t""")
sql("enrichment_candidates", """
WITH a AS (SELECT c_custkey, c_acctbal, 1 AS linked FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey LIMIT 60),
b AS (SELECT c_custkey, c_acctbal, 0 AS linked FROM customer WHERE c_acctbal > 0 ORDER BY c_custkey LIMIT 60), u AS (SELECT c_custkey, max(c_acctbal) AS views, max(linked) AS linked FROM (SELECT * FROM a UNION ALL SELECT * FROM b) x GROUP BY c_custkey)
SELECT c_custkey, CAST(row_number() OVER (ORDER BY linked DESC, views DESC, c_custkey) AS INT) AS place FROM u""")
sql("page_merge_dedup", """
WITH front AS (SELECT id, row_number() OVER (ORDER BY day DESC, id) AS n FROM (SELECT o_orderkey AS id, o_orderdate AS day FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50) a),
cur AS (SELECT id, 1000 + row_number() OVER (ORDER BY id) AS n FROM (SELECT o_orderkey AS id FROM orders WHERE o_orderkey > 200 ORDER BY o_orderkey LIMIT 100) b)
SELECT id, CAST(min(n) AS INT) AS place FROM (SELECT * FROM front UNION ALL SELECT * FROM cur) x GROUP BY id""")


@query("""
WITH c AS (SELECT DISTINCT o_custkey, l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT c_custkey AS work, count(*) AS uncovered, min(s_suppkey) AS next_source FROM customer CROSS JOIN supplier WHERE NOT EXISTS (SELECT 1 FROM c WHERE o_custkey = c_custkey AND l_suppkey = s_suppkey) GROUP BY c_custkey""")
def uncovered_sources(t: Tables) -> DataFrame:
    """For every work, how many sources don't cover it, and the first of these: from the covered ones alone, as the
    first place at which they leave a gap in the order of all sources."""
    places = t.supplier.select(F.col("s_suppkey").alias("source"), F.row_number().over(Window.orderBy("s_suppkey")).alias("i"))  # a source list, a row for each site
    every = places.agg(F.count("*").alias("every"))
    mapped = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("work"), F.col("l_suppkey").alias("source")).distinct().join(places, "source")
    k = F.row_number().over(Window.partitionBy("work").orderBy("i"))
    gap = mapped.withColumn("k", k).groupBy("work").agg(F.count("*").alias("n"), F.coalesce(F.min(F.when(F.col("i") > F.col("k"), F.col("k"))), F.count("*") + 1).alias("i"))
    rows = t.customer.select(F.col("c_custkey").alias("work")).join(gap, "work", "left").select("work", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("i", F.lit(1)).alias("i"))
    return rows.crossJoin(F.broadcast(every)).where("n < every").join(places, "i").select("work", (F.col("every") - F.col("n")).alias("uncovered"), F.col("source").alias("next_source"))


sql("backoff_schedule", f"SELECT id, attempts, CAST(least(21600, 60 * power(2, least(attempts, 8))) AS INT) AS wait_s FROM ({_TASKS}) t")
sql("backlog_reason", f"""
SELECT coalesce((SELECT min('STAFF') FROM ({_TASKS}) a WHERE priority < 0), (SELECT min('EXPIRED_LEASE') FROM ({_TASKS}) b WHERE state = 'RUNNING' AND attempts > 99), (SELECT min('READY_WORK') FROM ({_TASKS}) c WHERE state = 'READY'), 'IDLE') AS reason""")
sql("work_cost_class", "SELECT l_orderkey, CASE WHEN pages <= 25 THEN 'SMALL' WHEN pages <= 60 THEN 'MEDIUM' ELSE 'LARGE' END AS class FROM (SELECT l_orderkey, sum(l_quantity) AS pages FROM lineitem GROUP BY l_orderkey) x")
_STATES = "CASE WHEN failed THEN 'FAILED' WHEN m.at < (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 700 DAY THEN 'STALE' ELSE 'MAPPED' END"
_MAPPED = "SELECT l_suppkey, l_partkey, max(l_shipdate) AS at, bool_or(l_returnflag = 'R') AS failed FROM lineitem GROUP BY l_suppkey, l_partkey"


def _mapping_states(t: Tables) -> DataFrame:
    m = t.lineitem.groupBy(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("work")).agg(F.max("l_shipdate").alias("at"), F.bool_or(F.col("l_returnflag") == "R").alias("failed"))
    stale = F.col("at") < F.col("now") - F.expr("INTERVAL 700 DAY")
    now = F.broadcast(t.lineitem.agg(F.max("l_shipdate").alias("now")))  # one row
    return m.crossJoin(now).select("source", "work", F.when(F.col("failed"), "FAILED").when(stale, "STALE").otherwise("MAPPED").alias("state"))


@query(f"SELECT l_suppkey AS source, l_partkey AS work, {_STATES} AS state FROM ({_MAPPED}) m")
def mapping_states(t: Tables) -> DataFrame:
    """State of every stored mapping (source, work)."""
    return _mapping_states(t)


@query(f"""
WITH m AS ({_MAPPED}), p AS (SELECT s_suppkey, p_partkey, p_size FROM supplier CROSS JOIN part)
SELECT p_partkey AS work, CASE WHEN m.at IS NULL AND p_size % 5 = 0 THEN 'DEFERRED' WHEN m.at IS NULL AND p_size % 2 = 0 THEN 'NOT_FOUND' WHEN m.at IS NULL THEN 'PENDING' ELSE {_STATES} END AS state, count(*) AS sources
FROM p LEFT JOIN m ON l_suppkey = s_suppkey AND l_partkey = p_partkey GROUP BY ALL""")
def coverage_matrix(t: Tables) -> DataFrame:
    """For every work, how many of all sources are in each state of the cycle; those without a mapping follow from their
    number, so that no pair of a work and a source is made."""
    states = _mapping_states(t).join(t.part.select(F.col("p_partkey").alias("work")), "work").join(t.supplier.select(F.col("s_suppkey").alias("source")), "source")
    counts = states.groupBy("work", "state").agg(F.count("*").alias("sources"))
    every = F.broadcast(t.supplier.agg(F.count("*").alias("every")))  # one row
    held = counts.groupBy("work").agg(F.sum("sources").alias("held"))
    open_ = F.when(F.col("p_size") % 5 == 0, "DEFERRED").when(F.col("p_size") % 2 == 0, "NOT_FOUND").otherwise("PENDING")
    rest = t.part.select(F.col("p_partkey").alias("work"), "p_size").join(held, "work", "left").crossJoin(every)
    rest = rest.select("work", open_.alias("state"), (F.col("every") - F.coalesce("held", F.lit(0))).alias("sources")).where("sources > 0")
    return counts.unionByName(rest)


@query("SELECT doc_id, ok AS matched FROM (SELECT conv_id AS doc_id, count(*) FILTER (WHERE n_chars > 100) = len(list(turn)) AS ok FROM conversations LEFT JOIN documents ON doc_id = turn + conv_id GROUP BY conv_id)")
def array_count_match(t: Tables) -> DataFrame:
    """Whether as many valid partners are found as the array has elements."""
    lists = t.conversations.groupBy("conv_id").agg(F.collect_list("turn").alias("a"))
    each = lists.select("conv_id", F.size("a").alias("n"), F.explode("a").alias("turn"))
    d = t.documents.where("n_chars > 100").select(F.col("doc_id").alias("d"))
    found = each.join(d, F.col("d") == F.col("turn") + F.col("conv_id"), "left").groupBy("conv_id").agg(F.count("d").alias("found"), F.first("n").alias("n"))
    return found.select(F.col("conv_id").alias("doc_id"), (F.col("found") == F.col("n")).alias("matched"))


@query("""
SELECT o_orderkey, '{' || array_to_string(list_filter([CASE WHEN o_totalprice > 100000 THEN '"price":{"from":"100000","to":"' || floor(o_totalprice)::BIGINT || '"}' END, CASE WHEN o_orderstatus <> 'F' THEN '"status":{"from":"F","to":"' || o_orderstatus || '"}' END], lambda x: x IS NOT NULL), ',') || '}' AS provenance
FROM orders WHERE o_totalprice > 100000 OR o_orderstatus <> 'F'""")
def field_changes(t: Tables) -> DataFrame:
    """Fields that an edit changed, with their old and new values, as JSON; from the old and the new row as maps."""
    price = F.floor("o_totalprice").cast("long")
    old = F.create_map(F.lit("price"), F.least(price, F.lit(100000)).cast("string"), F.lit("status"), F.lit("F"))
    new = F.create_map(F.lit("price"), F.when(F.col("o_totalprice") > 100000, price).otherwise(F.least(price, F.lit(100000))).cast("string"), F.lit("status"), F.col("o_orderstatus"))
    rows = t.orders.where("o_totalprice > 100000 or o_orderstatus <> 'F'").withColumn("old", old).withColumn("new", new)
    changed = F.map_filter("new", lambda k, v: ~v.eqNullSafe(F.col("old")[k]) | ((k == "price") & (F.col("o_totalprice") > 100000)))
    both = F.transform_values(changed, lambda k, v: F.struct(F.col("old")[k].alias("from"), v.alias("to")))
    return rows.select("o_orderkey", F.to_json(both).alias("provenance"))


def _events(t: Tables) -> DataFrame:
    return t.events.select("user_id", "ts", "event_id", (F.col("event_type") != "error").alias("ok"))


@query()
def ewma_tier(t: Tables) -> DataFrame:
    """Tiers of sources (users) from their pages, chapters and failures."""
    kind = F.when(F.col("event_type") == "purchase", "chapter").when(F.col("event_type") == "error", "failure").otherwise("page")
    e = t.events.select("user_id", "ts", "event_id", kind.alias("kind"), (F.col("value") * F.when(kind == "page", 60).otherwise(900)).alias("ms"), (F.col("event_id") % 60).cast("int").alias("n"))
    return folds.source_tiers(e, "user_id", ["ts", "event_id"], "kind", "ms", "n")


@query()
def breaker_sim(t: Tables) -> DataFrame:
    return folds.breakers(_events(t), "user_id", ["ts", "event_id"], "ts", "ok")


@query()
def aimd_sim(t: Tables) -> DataFrame:
    return folds.rate_limits(_events(t), "user_id", ["ts", "event_id"], "ts", "ok")


@query()
def fair_allocation(t: Tables) -> DataFrame:
    """Slots for all suppliers with open lines, by their demand, limit and tier."""
    demand = t.lineitem.where("l_linestatus = 'O'").groupBy(F.col("l_suppkey").alias("source")).agg(F.count("*").alias("demand"))
    tier = F.when(F.col("s_acctbal") > 5000, "FAST").when(F.col("s_acctbal") < 0, "SLOW").otherwise("NORMAL")
    rows = demand.join(t.supplier.select(F.col("s_suppkey").alias("source"), (F.col("s_nationkey") % 5 + 2).cast("int").alias("most"), tier.alias("tier")), "source")
    return folds.fair_allocation(rows, 400)


@query("SELECT event_id, arg_min(event_type, ts) AS event_type, min(ts) AS ts FROM events GROUP BY event_id")
def stream_dedup(t: Tables) -> DataFrame:
    from shelfmark.streaming.replay import first_events

    return first_events(t.spark, f"{t._dir}/events.parquet")


@query("SELECT date_trunc('minute', ts) AS minute, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_minute_bucket(t: Tables) -> DataFrame:
    from shelfmark.streaming.replay import minute_counts

    return minute_counts(t.spark, f"{t._dir}/events.parquet")
