"""Window, sort and sequence queries: releases, fairness, frontiers, gaps, barriers, routes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators import ranking, sequences
from shelfmark.plans.registry import Tables, query, sql

_RELEASES = """
WITH w AS (SELECT o_custkey, max(o_orderdate) AS latest FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey ORDER BY latest DESC, o_custkey LIMIT 15)
SELECT work, chapter, published_at, rank FROM (
  SELECT o_custkey AS work, o_orderkey AS chapter, o_orderdate AS published_at, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS INT) AS rank
  FROM orders WHERE o_orderstatus <> 'P' AND o_custkey IN (SELECT o_custkey FROM w)) x WHERE rank <= 50
"""


@query(_RELEASES)
def recent_releases(t: Tables) -> DataFrame:
    """The newest 50 chapters of each of the 15 works that published last."""
    published = t.orders.where("o_orderstatus <> 'P'")
    works = published.groupBy("o_custkey").agg(F.max("o_orderdate").alias("latest")).orderBy(F.desc("latest"), "o_custkey").limit(15)
    few = published.join(F.broadcast(works.select("o_custkey")), "o_custkey", "left_semi")  # 15 rows
    top = ranking.top_n_per_group(few, ["o_custkey"], [F.desc("o_orderdate"), F.col("o_orderkey")], 50, rank="rank")
    return top.select(F.col("o_custkey").alias("work"), F.col("o_orderkey").alias("chapter"), F.col("o_orderdate").alias("published_at"), "rank")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey) > 1 AS superseded FROM orders")
def supersede_duplicates(t: Tables) -> DataFrame:
    return ranking.supersede(t.orders, ["o_custkey", "o_orderpriority"], [F.desc("o_orderdate"), F.col("o_orderkey")]).select("o_orderkey", "superseded")


@query("""
WITH a AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem),
b AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS s FROM a WHERE r <= 2)
SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber FROM b WHERE s <= 2""")
def double_fair_rank(t: Tables) -> DataFrame:
    order = [F.desc("l_quantity"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]
    return ranking.fair_ranks(t.lineitem, ["l_suppkey"], ["l_partkey"], order, 2).select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber")


sql("rotation_or_frontier", """
SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY CASE WHEN l_orderkey > 1000 THEN 0 ELSE 1 END, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rotation,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS frontier FROM lineitem) x WHERE rotation <= 4 OR frontier <= 4""")
sql("window_minmax", """
SELECT l_orderkey, l_linenumber, max(l_shipdate) OVER (PARTITION BY l_partkey) AS latest, min(l_quantity) OVER (PARTITION BY l_partkey) AS least,
  row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem""")


@query("SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_discount DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem WHERE l_returnflag = 'R') x WHERE r <= 3")
def lane_budget(t: Tables) -> DataFrame:
    return ranking.top_n_per_group(t.lineitem.where("l_returnflag = 'R'"), ["l_suppkey"], [F.desc("l_discount"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")], 3).select("l_suppkey", "l_orderkey", "l_linenumber")


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def first_per_work(t: Tables) -> DataFrame:
    return ranking.distinct_on(t.orders.where("o_orderstatus = 'O'"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("SELECT DISTINCT ON (l_partkey, l_suppkey) l_partkey, l_suppkey, l_orderkey, l_linenumber FROM lineitem ORDER BY l_partkey, l_suppkey, l_shipdate DESC, l_orderkey, l_linenumber")
def distinct_on(t: Tables) -> DataFrame:
    return ranking.distinct_on(t.lineitem, ["l_partkey", "l_suppkey"], [F.desc("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]).select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber, running FROM (SELECT *, sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) OVER (PARTITION BY l_partkey ORDER BY l_shipdate NULLS LAST, l_orderkey, l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS running FROM lineitem) x WHERE running <= 3")
def running_sum_cap(t: Tables) -> DataFrame:
    order = [F.asc_nulls_last("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]
    return ranking.running_cap(t.lineitem, ["l_partkey"], order, F.col("l_returnflag") == "N", 3).select("l_orderkey", "l_linenumber", "running")


# -- sorts and bounded horizons; tasks are orders
_PR = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 0 WHEN '2' THEN 1 WHEN '3' THEN 2 ELSE 3 END"
sql("claim_order", f"SELECT o_orderkey, CAST(row_number() OVER (ORDER BY {_PR}, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, o_orderdate DESC NULLS LAST, o_orderkey) AS INT) AS place FROM (SELECT * FROM orders ORDER BY {_PR}, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, o_orderdate DESC NULLS LAST, o_orderkey LIMIT 200) x")
sql("bounded_horizon_claim", f"""
WITH h AS (SELECT * FROM orders WHERE o_orderstatus = 'O' ORDER BY {_PR}, o_orderdate, o_orderkey LIMIT 64),
busy AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P')
SELECT o_orderkey, o_custkey FROM h WHERE NOT EXISTS (SELECT 1 FROM busy WHERE busy.o_custkey = h.o_custkey) ORDER BY {_PR}, o_orderdate, o_orderkey LIMIT 8""")
sql("publishable_frontier", """
WITH f AS (SELECT l_partkey AS work, min(l_suppkey) AS frontier, count(*) AS staged FROM lineitem WHERE l_returnflag = 'N' GROUP BY l_partkey),
g AS (SELECT DISTINCT l_partkey AS work FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag = 'R' AND l_quantity > 45)
SELECT work, frontier, staged FROM f WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.work = f.work) ORDER BY frontier, work LIMIT 40""")
sql("canonical_frontier", """
WITH heads AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS place FROM lineitem)
SELECT l_partkey AS work, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS n FROM heads WHERE place <= 12 AND l_linestatus = 'O') x WHERE n = 1""")
sql("focus_score", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 60 WHEN o_orderstatus = 'P' THEN 40 ELSE 20 END + least(35e0, 1.5e0 * (o_orderkey % 48)) + CASE WHEN o_totalprice > 200000 THEN 5 ELSE 0 END AS score FROM orders")

# -- sequences with gaps: work is l_orderkey, keys are line numbers of which some are missing
_KEYS = "SELECT l_orderkey AS work, l_linenumber AS k FROM lineitem WHERE (l_orderkey + 3 * l_linenumber) % 4 <> 0"


def _keys(t: Tables) -> DataFrame:
    return t.lineitem.where("(l_orderkey + 3 * l_linenumber) % 4 <> 0").select(F.col("l_orderkey").alias("work"), F.col("l_linenumber").alias("k"))


_GAPS = f"""
SELECT work, 'MISSING_START' AS kind, 1::BIGINT AS start, (k - 1)::BIGINT AS "end" FROM (SELECT work, min(k) AS k FROM ({_KEYS}) GROUP BY work) WHERE k > 1
UNION ALL SELECT work, 'INTERNAL', (k + 1)::BIGINT, (nxt - 1)::BIGINT FROM (SELECT work, k, lead(k) OVER (PARTITION BY work ORDER BY k) AS nxt FROM (SELECT DISTINCT * FROM ({_KEYS}))) WHERE nxt - k > 1
"""


@query(_GAPS)
def sequence_gaps(t: Tables) -> DataFrame:
    return sequences.gaps(_keys(t), "work", "k")


@query(f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE EXISTS (SELECT 1 FROM ({_GAPS}) g WHERE work = l_orderkey AND l_linenumber BETWEEN start AND \"end\")")
def gap_cover_interval_join(t: Tables) -> DataFrame:
    found = sequences.gaps(_keys(t), "work", "k").withColumnRenamed("work", "l_orderkey")
    return sequences.covered(t.lineitem.select("l_orderkey", "l_linenumber"), found, "l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber FROM lineitem a WHERE l_linestatus = 'O' AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_linestatus = 'O' AND b.l_linenumber < a.l_linenumber)")
def frontier_antijoin(t: Tables) -> DataFrame:
    return sequences.without_earlier(t.lineitem, "l_orderkey", "l_linenumber", F.col("l_linestatus") == "O").select("l_orderkey", "l_linenumber")


@query("SELECT l_partkey AS work, l_linenumber AS k, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS sources, max(l_quantity) AS pages FROM lineitem GROUP BY l_partkey, l_linenumber")
def chapter_manifest(t: Tables) -> DataFrame:
    sources = F.array_join(F.transform(F.array_sort(F.collect_set("l_suppkey")), lambda x: x.cast("string")), ",")
    return t.lineitem.groupBy(F.col("l_partkey").alias("work"), F.col("l_linenumber").alias("k")).agg(sources.alias("sources"), F.max("l_quantity").alias("pages"))


sql("chapter_status", """
WITH m AS (SELECT DISTINCT l_orderkey AS work, l_linenumber AS k FROM lineitem), p AS (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A'),
s AS (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R'), q AS (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus = 'F'),
u AS (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 10)
SELECT work, k, CASE WHEN p.l_orderkey IS NOT NULL THEN 'PUBLISHED' WHEN s.l_orderkey IS NOT NULL THEN 'STAGED' WHEN q.l_orderkey IS NOT NULL THEN 'QUEUED' WHEN u.l_orderkey IS NOT NULL THEN 'UNRESOLVED_GAP' ELSE 'QUEUED_NEW' END AS status
FROM m LEFT JOIN p ON p.l_orderkey = work AND p.l_linenumber = k LEFT JOIN s ON s.l_orderkey = work AND s.l_linenumber = k LEFT JOIN q ON q.l_orderkey = work AND q.l_linenumber = k LEFT JOIN u ON u.l_orderkey = work AND u.l_linenumber = k""")
sql("fresh_vs_backfill", """
SELECT l_orderkey, l_linenumber, fresh, CASE WHEN NOT tracked THEN 50 WHEN fresh THEN 100 ELSE 70 END AS priority FROM (
  SELECT l_orderkey, l_linenumber, tracked, tracked AND milestone > 0 AND l_linenumber > milestone AS fresh FROM (SELECT l_orderkey, l_linenumber, o_orderstatus <> 'P' AS tracked,
    coalesce(max(CASE WHEN l_returnflag IN ('A', 'R') THEN l_linenumber END) OVER (PARTITION BY l_orderkey), 0) AS milestone FROM lineitem JOIN orders ON l_orderkey = o_orderkey) x) y""")
_SCORED = "SELECT DISTINCT l_partkey AS work, l_suppkey AS source, s_acctbal AS score FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal > 0"


@query(f"SELECT work, arg_max(source, (score, -source)) AS main, array_to_string(list(source ORDER BY score DESC, source)[2:], ',') AS fallbacks FROM ({_SCORED}) GROUP BY work")
def primary_and_fallbacks(t: Tables) -> DataFrame:
    scored = t.lineitem.join(t.supplier.where("s_acctbal > 0"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_partkey", "l_suppkey", "s_acctbal").distinct()
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("s_acctbal")).alias("s"), "l_suppkey"))), lambda x: x["l_suppkey"])
    rows = scored.groupBy(F.col("l_partkey").alias("work")).agg(listed.alias("l"))
    return rows.select("work", F.col("l")[0].alias("main"), F.array_join(F.transform(F.slice("l", 2, F.greatest(F.size("l"), F.lit(1))), lambda x: x.cast("string")), ",").alias("fallbacks"))


# chapters are lines, half of them half a step on; published, completed, missing and confirmed gaps follow from a line's own columns
_CHAPTERS = "SELECT l_orderkey AS work, (l_linenumber + CASE WHEN l_quantity > 40 THEN 0.5 ELSE 0 END)::DOUBLE AS k, l_returnflag = 'A' AND l_orderkey % 3 > 0 AS published, l_returnflag = 'R' AS completed, l_quantity < 6 AS gap FROM lineitem WHERE (l_orderkey + 3 * l_linenumber) % 4 <> 0"
_CONFIRMED = "SELECT l_orderkey AS work, l_linenumber::DOUBLE AS a, (l_linenumber + 2)::DOUBLE AS z FROM lineitem WHERE l_discount >= 0.09"


@query(f"""
WITH c AS ({_CHAPTERS}), g AS ({_CONFIRMED}), p AS (SELECT work, max(k) AS m FROM c WHERE published GROUP BY work),
t AS (SELECT DISTINCT c.work, c.k, p.m FROM c LEFT JOIN p ON p.work = c.work WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.work = c.work AND d.k = c.k AND d.published)),
f AS (SELECT t.*, (SELECT count(DISTINCT d.k) FROM c d WHERE d.work = t.work AND d.k > t.m AND d.k < t.k AND NOT d.gap AND NOT EXISTS (SELECT 1 FROM g WHERE g.work = d.work AND g.a <= d.k AND g.z >= d.k)
    AND NOT EXISTS (SELECT 1 FROM c e WHERE e.work = d.work AND e.k = d.k AND e.completed)) AS blocking,
  EXISTS (SELECT 1 FROM c d WHERE d.work = t.work AND d.k > t.m AND d.k < t.k AND d.gap) AS known, EXISTS (SELECT 1 FROM g WHERE g.work = t.work AND g.a <= t.m + 1 AND g.z >= t.k - 1) AS confirmed,
  EXISTS (SELECT 1 FROM c d WHERE d.work = t.work AND d.k <= 1.5 AND NOT d.gap AND NOT d.completed) AS first, EXISTS (SELECT 1 FROM c d WHERE d.work = t.work AND d.k <= 1.5 AND d.gap) AS nofirst,
  EXISTS (SELECT 1 FROM g WHERE g.work = t.work AND g.a <= 1.5 AND g.z >= t.k - 1) AS started FROM t)
SELECT work, k, CASE WHEN m IS NULL THEN CASE WHEN k > 1.5 AND first AND NOT nofirst AND NOT started THEN 'WAITING_FOR_INITIAL_CHAPTERS' ELSE 'INITIAL_CHAPTER_CLEAR' END WHEN k <= m THEN 'BACKFILL_CLEAR' WHEN k - m <= 1.05 THEN 'BARRIER_CLEAR'
  WHEN blocking > 0 THEN 'UNPUBLISHED_PRECEDING_CHAPTERS' WHEN NOT known AND NOT confirmed THEN 'UNRESOLVED_GAP' ELSE 'BARRIER_CLEAR' END AS reason,
  (CASE WHEN m IS NULL THEN CASE WHEN k > 1.5 AND first AND NOT nofirst AND NOT started THEN 1 ELSE 0 END WHEN k - m <= 1.05 THEN 0 WHEN blocking > 0 THEN blocking WHEN NOT known AND NOT confirmed THEN greatest(1, floor(k - m) - 1) ELSE 0 END)::BIGINT AS blocking FROM f""")
def publication_barrier(t: Tables) -> DataFrame:
    l = t.lineitem  # noqa: E741
    chapters = l.where("(l_orderkey + 3 * l_linenumber) % 4 <> 0").select(
        F.col("l_orderkey").alias("work"), (F.col("l_linenumber") + F.when(F.col("l_quantity") > 40, 0.5).otherwise(0.0)).cast("double").alias("k"),
        ((F.col("l_returnflag") == "A") & (F.col("l_orderkey") % 3 > 0)).alias("published"), (F.col("l_returnflag") == "R").alias("completed"), (F.col("l_quantity") < 6).alias("gap"),
    )
    confirmed = l.where("l_discount >= 0.09").select(F.col("l_orderkey").alias("work"), F.col("l_linenumber").cast("double").alias("start"), (F.col("l_linenumber") + 2).cast("double").alias("end"))
    return sequences.barrier(chapters, confirmed, "work", "k")


sql("claim_fences", """
SELECT l_orderkey, l_linenumber FROM lineitem c WHERE l_linestatus = 'O' AND NOT EXISTS (SELECT 1 FROM lineitem p WHERE p.l_orderkey = c.l_orderkey AND p.l_returnflag = 'A' AND p.l_linenumber >= c.l_linenumber)
AND NOT EXISTS (SELECT 1 FROM lineitem a WHERE a.l_orderkey = c.l_orderkey AND a.l_returnflag = 'R' AND a.l_quantity > 40)
AND l_linenumber = (SELECT min(l_linenumber) FROM lineitem f WHERE f.l_orderkey = c.l_orderkey AND f.l_linestatus = 'O')""")
sql("identity_merge", """
WITH k AS (SELECT l_orderkey AS work, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_linenumber AS STRING) || '.0' ELSE CAST(l_linenumber AS STRING) END AS key, l_partkey AS chapter FROM lineitem UNION ALL SELECT l_orderkey, CAST(l_linenumber AS STRING), l_partkey + 1000000 FROM lineitem WHERE l_linenumber % 4 = 0),
c AS (SELECT work, regexp_replace(key, '[.]0+$', '') AS canonical, key, chapter FROM k), w AS (SELECT work, canonical, max(CASE WHEN key = canonical THEN chapter END) AS stays, min(chapter) AS least FROM c GROUP BY work, canonical)
SELECT c.work, c.canonical, c.chapter AS merged, coalesce(w.stays, w.least) AS target, 'RETARGET' AS audit FROM c JOIN w ON c.work = w.work AND c.canonical = w.canonical WHERE c.chapter <> coalesce(w.stays, w.least)""")
sql("route_selection", """
WITH r AS (SELECT l_partkey AS work, l_suppkey AS source, l_returnflag <> 'R' AS confirmed, l_linestatus = 'O' AS cooling, s_acctbal >= 0 AS healthy, l_discount AS speed FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
g AS (SELECT work, count(CASE WHEN confirmed THEN 1 END) AS routes, count(CASE WHEN confirmed AND healthy THEN 1 END) AS good, count(CASE WHEN confirmed AND healthy AND NOT cooling THEN 1 END) AS ready FROM r GROUP BY work),
b AS (SELECT work, source FROM (SELECT work, source, row_number() OVER (PARTITION BY work ORDER BY speed DESC, source) AS n FROM r WHERE confirmed AND healthy AND NOT cooling) x WHERE n = 1)
SELECT g.work, b.source, CASE WHEN routes = 0 THEN 'NO_CONFIRMED_ROUTE' WHEN good = 0 THEN 'ALL_ROUTES_UNHEALTHY' WHEN ready = 0 THEN 'ALL_ROUTES_COOLDOWN' END AS reason FROM g LEFT JOIN b ON g.work = b.work""")
sql("gap_evidence", """
WITH e AS (SELECT o_custkey AS work, CASE CAST(o_orderkey AS INT) % 5 WHEN 0 THEN '404' WHEN 1 THEN '403' WHEN 2 THEN '429' WHEN 3 THEN 'TIMEOUT' ELSE 'ABSENT' END AS error FROM orders)
SELECT work, count(CASE WHEN error = '404' THEN 1 END) >= 2 OR count(CASE WHEN error = 'ABSENT' THEN 1 END) >= 1 AS proven, count(CASE WHEN error IN ('403', '429', 'TIMEOUT') THEN 1 END) AS transient FROM e GROUP BY work""")


@query("""
WITH RECURSIVE n AS (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
r AS (SELECT o_custkey, o_orderkey, i, o_orderdate AS published_at FROM n WHERE i = 1
  UNION ALL SELECT n.o_custkey, n.o_orderkey, n.i, greatest(n.o_orderdate, r.published_at + INTERVAL 1 MILLISECOND) FROM r JOIN n ON n.o_custkey = r.o_custkey AND n.i = r.i + 1)
SELECT o_orderkey, published_at FROM r""")
def monotone_publish(t: Tables) -> DataFrame:
    """Every chapter is published at its own time, but a millisecond after the one before it at least."""
    return sequences.increasing(t.orders.select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", "o_orderkey", "o_orderdate").select("o_orderkey", F.col("o_orderdate").alias("published_at"))
