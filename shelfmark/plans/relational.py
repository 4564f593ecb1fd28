"""Scans, filters, joins, aggregates and set operations over the proxy tables: works are customers, chapters orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators import ranking, writes
from shelfmark.operators.builder import Query
from shelfmark.plans.registry import Tables, query, sql

# -- scans and sinks
sql("scan_project", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal >= 0 AND c_acctbal < 9000 AND c_custkey <> 7 AND c_name LIKE 'Customer%' AND c_name ILIKE '%1%' AND c_mktsegment IS NOT NULL ORDER BY c_acctbal DESC NULLS LAST LIMIT 50")
def builder_filters(t: Tables) -> DataFrame:
    q = Query(t.customer).in_("c_mktsegment", ["BUILDING", "MACHINERY"]).not_in("c_custkey", []).gte("c_acctbal", 0).lt("c_acctbal", 9000).neq("c_custkey", 7)
    return q.like("c_name", "Customer%").ilike("c_name", "%1%").is_not("c_mktsegment", None).order("c_acctbal", ascending=False).limit(50).select("c_custkey", "c_name", "c_acctbal").df()


@query("SELECT o_orderkey, CAST(c_custkey AS VARCHAR) || '|' || c_name AS work FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000")
def nested_join_struct(t: Tables) -> DataFrame:
    joined = t.orders.where("o_totalprice > 200000").join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    nested = joined.select("o_orderkey", F.struct("c_custkey", "c_name").alias("w"))
    return nested.select("o_orderkey", F.concat_ws("|", F.col("w.c_custkey").cast("string"), "w.c_name").alias("work"))


@query("SELECT * FROM (VALUES ('a', 1), ('b', 2), (NULL, 3)) v(source, position)")
def zip_unnest(t: Tables) -> DataFrame:
    """Bulk values as rows; the shorter array is padded with nulls."""
    return t.spark.range(1).select(F.inline(F.arrays_zip(F.array(F.lit("a"), F.lit("b")).alias("source"), F.array(F.lit(1), F.lit(2), F.lit(3)).alias("position"))))


@query("SELECT event_id, json_extract_string(props, '$.' || k) AS v, k FROM events, (SELECT unnest(json_keys(props)) AS k, event_id AS e FROM events) x WHERE event_id = e")
def json_each_evidence(t: Tables) -> DataFrame:
    keys = t.events.select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("k", "v"))
    return keys.select("event_id", "v", "k")


@query("SELECT event_id, i AS position, k AS item FROM (SELECT event_id, unnest(json_keys(props)) AS k, generate_subscripts(json_keys(props), 1) AS i FROM events)")
def json_ordinality(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.posexplode(F.json_object_keys("props")).alias("p", "item")).select("event_id", (F.col("p") + 1).cast("long").alias("position"), "item")


@query("SELECT event_id FROM events WHERE list_contains(json_keys(props), 'k')")
def json_has_key(t: Tables) -> DataFrame:
    """The key exists, even with a JSON null for value."""
    return t.events.where(F.array_contains(F.json_object_keys("props"), "k")).select("event_id")


@query("SELECT * FROM (VALUES ('s1', 1.5::DOUBLE, true), ('s2', 2.0, NULL)) v(source, score, ok)")
def json_recordset(t: Tables) -> DataFrame:
    text = F.lit('[{"source":"s1","score":1.5,"ok":true},{"source":"s2","score":2.0}]')
    return t.spark.range(1).select(F.inline(F.from_json(text, "array<struct<source:string,score:double,ok:boolean>>")))


_SERIES = """
WITH e AS (SELECT date_trunc('minute', ts) AS m FROM events), b AS (SELECT min(m) AS a, max(m) AS z FROM e),
s AS (SELECT unnest(generate_series(a, z, INTERVAL 1 MINUTE)) AS minute FROM b)
SELECT minute, count(m) AS n FROM s LEFT JOIN e ON m = minute GROUP BY minute
"""


@query(_SERIES)
def minute_series_fill(t: Tables) -> DataFrame:
    """Counts of every minute, with those that have none."""
    e = t.events.select(F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("m"))
    s = e.agg(F.min("m").alias("a"), F.max("m").alias("z")).select(F.explode(F.expr("sequence(a, z, interval 1 minute)")).alias("minute"))
    return s.join(e.groupBy("m").count(), F.col("m") == F.col("minute"), "left").select("minute", F.coalesce("count", F.lit(0)).alias("n"))


@query("SELECT date_trunc('minute', ts) AS minute, count(*) AS n FROM events GROUP BY 1")
def minute_bucket(t: Tables) -> DataFrame:
    """date_trunc gives a TIMESTAMP, which is cast back."""
    return t.events.groupBy(F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("minute")).agg(F.count("*").alias("n"))


@query("SELECT n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT * FROM (VALUES (100, 'ATLANTIS'), (101, 'MU')) v WHERE true")
def insert_ignore(t: Tables) -> DataFrame:
    rows = t.spark.createDataFrame([(1, "IGNORED"), (100, "ATLANTIS"), (101, "MU")], "id int, name string")
    return writes.insert_ignore(t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), rows, ["id"])


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey = 1 THEN 'RENAMED' ELSE n_name END AS name FROM nation UNION ALL SELECT 100, 'ATLANTIS'")
def upsert_merge(t: Tables) -> DataFrame:
    rows = t.spark.createDataFrame([(1, "RENAMED"), (100, "ATLANTIS")], "id int, name string")
    return writes.upsert(t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), rows, ["id"])


@query("SELECT c_custkey, coalesce((SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey), c_acctbal) AS c_acctbal FROM customer")
def update_from_join(t: Tables) -> DataFrame:
    best = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    return writes.update_from(t.customer.select("c_custkey", "c_acctbal"), best, ["c_custkey"], ["c_acctbal"])


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def delete_using(t: Tables) -> DataFrame:
    return writes.delete_using(t.customer.select("c_custkey"), t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT event_type, CAST(count(*) + count(*) FILTER (WHERE user_id % 2 = 0) AS BIGINT) AS n FROM events GROUP BY event_type")
def counter_upsert(t: Tables) -> DataFrame:
    old = t.events.groupBy("event_type").agg(F.count("*").alias("n"))
    new = t.events.where("user_id % 2 = 0").groupBy("event_type").agg(F.count("*").alias("n"))
    return writes.counter_upsert(old, new, ["event_type"], "n")


_CASCADE = """
WITH ready AS (SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderstatus = 'O'),
ev AS (SELECT date_trunc('minute', o_orderdate) AS bucket, count(*) AS events FROM ready GROUP BY 1),
w AS (SELECT o_custkey, max(o_orderdate) AS latest FROM ready GROUP BY 1)
SELECT 'event' AS step, CAST(bucket AS {text}) AS k, events AS n FROM ev
UNION ALL SELECT 'work', CAST(o_custkey AS {text}), CAST(extract(year FROM latest) AS BIGINT) FROM w
UNION ALL SELECT 'done', CAST(o_custkey % 10 AS {text}), count(*) FROM ready GROUP BY 1, 2
"""
sql("publish_cascade", _CASCADE.format(text="STRING").replace("date_trunc('minute', o_orderdate)", "CAST(date_trunc('minute', o_orderdate) AS TIMESTAMP_NTZ)"), _CASCADE.format(text="VARCHAR"))

# -- predicates
sql("null_safe_diff", "SELECT o_orderkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 WHERE c_custkey IS DISTINCT FROM o_custkey")
sql("tri_bool", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE (l.toxic = 1) IS NOT TRUE AND coalesce(l.quality = 1, true)")
sql("any_membership", "SELECT p_partkey, p_brand FROM part WHERE p_size IN (1, 5, 9, 14) AND NOT p_brand IN ('Brand#11', 'Brand#22')")


@query("SELECT p_partkey FROM part WHERE list_has_any(string_split(lower(p_name), ' '), ['green', 'blue', 'red', 'steel', 'small'])")
def alias_overlap(t: Tables) -> DataFrame:
    return t.part.where(F.arrays_overlap(F.split(F.lower("p_name"), " "), F.array(*map(F.lit, ["green", "blue", "red", "steel", "small"])))).select("p_partkey")


@query("SELECT c_custkey, c_name FROM customer WHERE regexp_matches(c_name, '0*[1-9]0$') AND NOT regexp_matches(c_mktsegment, '(?i)^auto')")
def regex_filter(t: Tables) -> DataFrame:
    return t.customer.where(F.col("c_name").rlike("0*[1-9]0$") & ~F.col("c_mktsegment").rlike("(?i)^auto")).select("c_custkey", "c_name")


sql("presentable_filter", "SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE trim(c_name) <> '' AND trim(n_name) <> '' AND c_acctbal >= 1500 AND c_mktsegment IS NOT NULL")
_SOURCES = """
SELECT s_suppkey AS source, CASE CAST(s_suppkey AS INT) % 6 WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'COOLDOWN' WHEN 2 THEN 'PROBING' WHEN 3 THEN 'DEGRADED' WHEN 4 THEN 'RECOVERING' ELSE 'DISABLED' END AS status,
  s_acctbal < 0 AS blocked, s_suppkey % 4 = 0 AS recovery, s_suppkey % 3 = 0 AS cooling FROM supplier
"""
sql("source_eligibility", f"""
SELECT source, status, status IN ('ACTIVE', 'COOLDOWN', 'PROBING', 'DEGRADED') AND NOT (status = 'COOLDOWN' AND cooling) AND (NOT blocked OR recovery) AS shared,
  (status IN ('ACTIVE', 'DEGRADED', 'RECOVERING') OR (status = 'COOLDOWN' AND NOT cooling)) AND (NOT blocked OR recovery) AS route, status <> 'DISABLED' AS claim FROM ({_SOURCES}) x""")
sql("retry_eligible", "SELECT o_orderkey FROM (SELECT *, CASE WHEN o_orderstatus = 'O' THEN 'READY' WHEN o_orderstatus = 'F' THEN 'RETRY_WAIT' ELSE 'DONE' END AS state, o_orderkey % 6 AS attempts FROM orders) x WHERE state = 'READY' OR (state = 'RETRY_WAIT' AND attempts < 5 AND o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 400 DAY)")
_RANKED = "SELECT *, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 0 WHEN '2' THEN 1 WHEN '3' THEN 2 ELSE 3 END AS pr, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS op FROM orders"
sql("operation_rank", f"SELECT o_orderkey, pr AS priority_rank, CASE WHEN op = 2 AND pr = 2 THEN 1 ELSE op END AS operation_rank FROM ({_RANKED}) x")

# -- joins
sql("inner_join_topn", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
sql("left_join_default", "SELECT d.doc_id, coalesce(CASE WHEN l.quality = 1 THEN 'GOOD' WHEN l.quality = 0 THEN 'POOR' END, 'UNKNOWN') AS health FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
sql("fallback_full_join", "SELECT coalesce(a.k, b.k) AS k, coalesce(a.src, b.src) AS src FROM (SELECT min(o_orderkey) AS k, 'head' AS src FROM orders WHERE o_totalprice < -1 HAVING min(o_orderkey) IS NOT NULL) a FULL JOIN (SELECT max(o_orderkey) AS k, 'rest' AS src FROM orders) b ON true")
sql("cross_scalar", "SELECT c_mktsegment, count(*) AS above FROM customer CROSS JOIN (SELECT avg(c_acctbal) AS a FROM customer) x WHERE c_acctbal > a GROUP BY c_mktsegment")
sql("semi_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
sql("anti_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)")
sql("or_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') OR EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND n_regionkey = 1)")


@query("SELECT o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_max FROM orders")
def prev_max_publish(t: Tables) -> DataFrame:
    """The correlated maximum of earlier chapters, as one window instead of a self join."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    return t.orders.select("o_orderkey", F.max("o_totalprice").over(w).alias("prev_max"))


@query("SELECT c_custkey, o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 1) x")
def lateral_top1(t: Tables) -> DataFrame:
    last = ranking.distinct_on(t.orders, ["o_custkey"], [F.desc("o_orderdate"), F.col("o_orderkey")])
    return t.customer.join(last, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey")


sql("left_lateral_max", "SELECT c_custkey, m AS latest FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS m FROM orders GROUP BY o_custkey) x ON o_custkey = c_custkey")
_SPELLED = """WITH k AS (SELECT l_orderkey, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_linenumber AS STRING) || '.00' ELSE CAST(l_linenumber AS STRING) END AS key FROM lineitem UNION ALL SELECT l_orderkey, CAST(l_linenumber AS STRING) FROM lineitem WHERE l_linenumber % 4 = 0)"""
sql("zero_decimal_selfjoin", _SPELLED + """
SELECT a.l_orderkey, a.key AS spelled, b.key AS canonical FROM k a JOIN k b ON a.l_orderkey = b.l_orderkey AND regexp_replace(a.key, '[.]0+$', '') = b.key WHERE a.key <> b.key""", _SPELLED + """,
c AS (SELECT l_orderkey, key, regexp_replace(key, '[.]0+$', '') AS plain FROM k), g AS (SELECT l_orderkey, plain, count(CASE WHEN key = plain THEN 1 END) AS n FROM c GROUP BY l_orderkey, plain)
SELECT l_orderkey, key AS spelled, plain AS canonical FROM (SELECT c.*, unnest(range(n)) AS i FROM c JOIN g USING (l_orderkey, plain) WHERE key <> plain) x""")


@query("SELECT c_custkey, c_name FROM customer ORDER BY (c_custkey <= 100)::INT, c_custkey LIMIT 120")
def circular_cursor(t: Tables) -> DataFrame:
    return ranking.circular_after(t.customer, "c_custkey", 100, 120).select("c_custkey", "c_name")


# -- aggregates
sql("operational_snapshot", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, min(o_orderdate) AS first_at, max(o_orderdate) AS last_at, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY o_orderstatus, o_orderpriority")
sql("publication_diversity", "SELECT count(*) AS chapters, count(DISTINCT event_type) AS sources, count(DISTINCT user_id) AS works FROM events")
sql("count_case", "SELECT o_custkey, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS done, count(CASE WHEN (o_orderstatus = 'F') IS NOT TRUE THEN 1 END) AS open FROM orders GROUP BY o_custkey")
_ROUTES = "SELECT l_partkey AS work, l_suppkey AS source, l_returnflag = 'A' AS healthy, l_linestatus = 'O' AS cooling, l_shipdate AS until_at, l_orderkey, l_linenumber FROM lineitem"
sql("route_flags", f"SELECT work, coalesce(bool_or(healthy AND NOT cooling), false) AS usable, coalesce(bool_or(cooling), false) AS any_cooling, min(greatest(until_at, TIMESTAMP '1995-01-01 00:00:00')) AS next_at FROM ({_ROUTES}) r GROUP BY work".replace("TIMESTAMP '", "TIMESTAMP_NTZ '"), f"SELECT work, coalesce(bool_or(healthy AND NOT cooling), false) AS usable, coalesce(bool_or(cooling), false) AS any_cooling, min(greatest(until_at, TIMESTAMP '1995-01-01 00:00:00')) AS next_at FROM ({_ROUTES}) r GROUP BY work")


@query("SELECT o_custkey, array_to_string(list(o_orderkey ORDER BY o_orderdate, o_orderkey) FILTER (WHERE o_orderstatus = 'O'), ',') AS keys, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_key FROM orders GROUP BY o_custkey")
def ordered_array_agg(t: Tables) -> DataFrame:
    row = F.struct("o_orderdate", "o_orderkey")
    listed = F.transform(F.sort_array(F.collect_list(F.when(F.col("o_orderstatus") == "O", row))), lambda x: x["o_orderkey"].cast("string"))
    return t.orders.groupBy("o_custkey").agg(listed.alias("l"), F.min_by("o_orderkey", row).alias("first_key")).select("o_custkey", F.when(F.size("l") > 0, F.array_join("l", ",")).alias("keys"), "first_key")


@query("SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderpriority) FILTER (WHERE o_totalprice > 50000)), ',') AS kinds FROM orders GROUP BY o_custkey")
def distinct_array_agg(t: Tables) -> DataFrame:
    kinds = F.array_sort(F.collect_set(F.when(F.col("o_totalprice") > 50000, F.col("o_orderpriority"))))
    return t.orders.groupBy("o_custkey").agg(kinds.alias("k")).select("o_custkey", F.when(F.size("k") > 0, F.array_join("k", ",")).alias("kinds"))


@query("""SELECT o_custkey, '[' || string_agg('{"o_orderdate":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g') || '","o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}', ',' ORDER BY o_orderdate, o_orderkey, o_orderstatus) || ']' AS chapters FROM orders GROUP BY o_custkey""")
def nested_json_agg(t: Tables) -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")))
    return t.orders.groupBy("o_custkey").agg(F.to_json(rows).alias("chapters"))


sql("having_flags", f"SELECT work, count(*) AS n FROM ({_ROUTES}) r GROUP BY work HAVING bool_or(healthy AND NOT cooling) = false OR min(source) > 5")
sql("progress_snapshot", """
SELECT (SELECT count(*) FROM customer) AS works, (SELECT count(*) FROM orders) AS chapters, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS published,
  (SELECT count(DISTINCT o_custkey) FROM orders) AS active, (SELECT max(o_orderdate) FROM orders) AS latest, (SELECT count(*) FROM lineitem) AS routes,
  (SELECT count(*) FROM supplier WHERE s_acctbal < 0) AS blocked, (SELECT count(*) FROM events) AS events, (SELECT count(*) FROM documents) AS texts, (SELECT count(DISTINCT text) FROM documents) AS distinct_texts""")
sql("top3_share", """
WITH s AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), t AS (SELECT n FROM s ORDER BY n DESC, user_id LIMIT 3)
SELECT round(1e2 * (SELECT max(n) FROM t) / (SELECT count(*) FROM events), 2) AS top_share, round(1e2 * (SELECT sum(n) FROM t) / (SELECT count(*) FROM events), 2) AS top3_share""")
sql("latency_percentile_cont", "SELECT event_type, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY value), 6) AS p50, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY value), 6) AS p95 FROM events GROUP BY event_type")
sql("bounded_count", "SELECT count(*) AS n FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' LIMIT 500) x")
sql("page_integrity", "SELECT conv_id, count(*) AS n, count(DISTINCT turn) = count(*) AND min(turn) = 0 AND max(turn) = count(*) - 1 AND count(*) FILTER (WHERE trim(coalesce(text, '')) = '') = 0 AS sound FROM conversations GROUP BY conv_id")
sql("staged_frontier", "SELECT l_partkey AS work, min(l_suppkey) AS frontier, count(DISTINCT l_suppkey) AS staged FROM lineitem WHERE l_returnflag = 'N' GROUP BY l_partkey")

# -- set operations
sql("candidate_pool_union", "SELECT 'fresh' AS pool, o_orderkey FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20) a UNION ALL SELECT 'retry', o_orderkey FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20) b UNION ALL SELECT 'staff', o_orderkey FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 5) c")
sql("union_distinct", "SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 5000 UNION SELECT s_nationkey FROM supplier")
sql("union_fallback", "WITH a AS (SELECT o_orderkey FROM orders WHERE o_totalprice > 1e12), b AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') SELECT o_orderkey FROM a UNION ALL SELECT o_orderkey FROM b WHERE NOT EXISTS (SELECT 1 FROM a)")


@query("WITH RECURSIVE r(s) AS (SELECT min(event_type) FROM events UNION ALL SELECT (SELECT min(event_type) FROM events WHERE event_type > s) FROM r WHERE s IS NOT NULL) SELECT s AS event_type FROM r WHERE s IS NOT NULL")
def recursive_distinct(t: Tables) -> DataFrame:
    """A loose index scan by recursion is a plain distinct here."""
    return t.events.select("event_type").distinct()
