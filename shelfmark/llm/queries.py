"""The queries of the ten operators, with production parameters over whole tables, and their SQL where there is some."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfmark.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=3, seed=42, radius=3)


@query()
def op5_token_id_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from shelfmark.llm.tokenbin import token_table

    return token_table(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, added=True)


@query(
    """
    WITH q AS (SELECT vec_id AS id, list_transform(embedding, lambda x: floor(1024.0::DOUBLE * x::DOUBLE)::BIGINT) AS v FROM embeddings
               WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.id AS query_id, b.id AS vec_id, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score
          FROM q a JOIN q b ON a.id % 100 = 0 AND a.id <> b.id)
    SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM
      (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
    """
)
def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfmark.llm.common import written
    from shelfmark.llm.topk import quantised, top_k

    vectors = written(quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 1024), "vectors")
    return top_k(vectors, vectors.where("id % 100 = 0"), k=10)


@query(
    """
    WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
    g AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS newest,
            array_to_string(list_transform(string_split(hex, ''), lambda c: lpad(bin(strpos('0123456789abcdef', c) - 1), 4, '0')), '') AS bits FROM p)
    SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
      array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), lambda j: CASE WHEN substr(bits, (1 + 5 * i + j)::BIGINT, 1) = '1' THEN (1 << (4 - j)::INTEGER) ELSE 0 END))::INTEGER, 1)), '') AS payload_digest,
      CASE WHEN page_id IS NOT DISTINCT FROM newest OR newest IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN page_id IS DISTINCT FROM newest AND newest IS NOT NULL THEN newest END AS refers_to FROM g
    """
)
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfmark.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"), min_bytes=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query(
    r"""
    WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                     md5('1:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS h FROM documents),
    sums AS (SELECT source, sum(size)::BIGINT AS source_size, greatest(1, ceil((sum(size) + count(*) * 16) / 262144))::BIGINT AS shards FROM sized GROUP BY source),
    w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM sums),
    c AS (SELECT *, sid % 3 + 1 AS weight, source_size * 3 AS cap, (source_size * 3)::DOUBLE / (sid % 3 + 1) AS ratio FROM w),
    p AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::DOUBLE AS lvl
          FROM c WINDOW o AS (ORDER BY ratio, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    t AS (SELECT *, least(cap::DOUBLE, weight * coalesce((SELECT arg_min(lvl, (ratio, sid)) FROM p WHERE lvl <= ratio), 3.0::DOUBLE)) AS target FROM p),
    laid AS (SELECT s.*, sid, source_size, target, ('0x' || substr(h, 1, 8))::BIGINT % shards AS shard FROM sized s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
    cells AS (SELECT sid, shard, sum(size)::BIGINT AS length, CASE WHEN any_value(source_size) > 0 THEN any_value(target) * sum(size)::BIGINT / any_value(source_size) ELSE 0.0::DOUBLE END AS goal FROM laid GROUP BY ALL),
    seats AS (SELECT round_even((SELECT sum(size) FROM sized)::DOUBLE / 32, 0)::BIGINT AS n),
    open_ AS (SELECT sid, shard, goal, unnest(range(0, (goal / 32 * 1.1 + 9)::BIGINT)) AS k FROM cells WHERE goal > 0),
    ranked AS (SELECT sid, shard, row_number() OVER (ORDER BY goal / (2 * k + 1) DESC, sid, shard, k) AS place FROM open_),
    quotas AS (SELECT sid, shard, count(*) AS quota FROM ranked, seats WHERE place <= n GROUP BY ALL),
    arcs AS (SELECT sid, shard, length, least(coalesce(quota, 0) * 32, length * 3) AS tokens,
               ('0x' || substr(md5('1:' || sid || ':' || shard), 1, 8))::BIGINT % ceil(length / 32)::BIGINT * 32 AS start
             FROM cells LEFT JOIN quotas USING (sid, shard) WHERE length > 0),
    x AS (SELECT l.*, coalesce(sum(size) OVER (PARTITION BY sid, shard ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS low FROM laid l)
    SELECT doc_id, size, source_size, target,
      coalesce(tokens // length * size + greatest(0, least(low + size, start + tokens % length) - greatest(low, start))
        + greatest(0, least(low + size, start + tokens % length - length) - greatest(low, start - length)), 0)::BIGINT AS taken
    FROM x LEFT JOIN arcs USING (sid, shard)
    """
)
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfmark.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"), cycle=(1, 2, 3), most=3).select("doc_id", "size", "source_size", "target", "taken")


@query(
    r"""
    WITH d AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
    i AS (SELECT item_id, list_filter(string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL),
    s AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
    ds AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k
             FROM d, (SELECT DISTINCT least(len(w), 5) AS n FROM i WHERE len(w) > 0) WHERE len(w) >= n)),
    m AS (SELECT item_id, count(*) AS item_shingles FROM s GROUP BY item_id)
    SELECT doc_id, x.item_id, shared, item_shingles, shared / item_shingles AS containment
    FROM (SELECT doc_id, s.item_id, count(*) AS shared FROM ds JOIN s USING (s) GROUP BY ALL) x JOIN m ON x.item_id IS NOT DISTINCT FROM m.item_id
    WHERE shared / item_shingles >= 0.8 - 1e-9
    """
)
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfmark.llm.decontam import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), threshold=0.8, width=5)


@query()
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfmark.llm.quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def list_entries(pages: DataFrame) -> DataFrame:
    """A dated list feed over the hosts of pages: hosts are listed and struck off on days that follow from their MD5."""
    from pyspark.sql import functions as F

    from shelfmark.llm.urlfilter import host_of

    hosts = pages.select(host_of(F.col("url")).alias("h")).where("h <> ''").distinct()
    x = F.conv(F.substring(F.md5("h"), 1, 4), 16, 10).cast("int")
    day = lambda n: F.timestamp_add("DAY", n, F.lit("2024-01-01").cast("timestamp_ntz"))
    row = lambda *c: F.struct(*(v.alias(k) for v, k in zip(c, ("list", "key", "action", "op", "at"), strict=True)))
    add, strike = day(x % 40), day(60 + x % 90)
    own = F.array(row(F.lit("hosts"), F.col("h"), F.lit("block"), F.lit("add"), add), row(F.lit("hosts"), F.col("h"), F.lit("block"), F.lit("remove"), strike))
    path = F.array(row(F.lit("paths"), F.concat("h", F.lit("/en")), F.lit("allow"), F.lit("add"), day(x % 20)))
    none = F.array().cast(own_type := "array<struct<list:string,key:string,action:string,op:string,at:timestamp_ntz>>")
    listed = hosts.select(F.explode(F.concat(F.when(x % 3 == 0, own.cast(own_type)).otherwise(none), F.when(x % 6 == 0, path.cast(own_type)).otherwise(none))).alias("e")).select("e.*")
    fixed = [("domains", "example.org", "block", op, at) for op, at in (("add", "2024-02-15"), ("remove", "2024-03-10"), ("add", "2024-05-01"))]
    return listed.unionByName(pages.sparkSession.createDataFrame(fixed, "list string, key string, action string, op string, at string").withColumn("at", F.col("at").cast("timestamp_ntz")))


@query(
    r"""
    WITH p AS (SELECT page_id, url, TIMESTAMP '2024-01-01' + to_days((page_id % 180)::INTEGER) AS fetched,
                 lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS h,
                 lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/+([^/?#]*)', 1)) AS s FROM pages),
    hosts AS (SELECT h, ('0x' || substr(md5(h), 1, 4))::INTEGER AS x FROM (SELECT DISTINCT h FROM p WHERE h <> '')),
    held AS (
      SELECT 'hosts' AS list, h AS key, 'block' AS action, TIMESTAMP '2024-01-01' + to_days(x % 40) AS since, TIMESTAMP '2024-01-01' + to_days(60 + x % 90) AS until FROM hosts WHERE x % 3 = 0
      UNION ALL SELECT 'paths', h || '/en', 'allow', TIMESTAMP '2024-01-01' + to_days(x % 20), NULL FROM hosts WHERE x % 6 = 0
      UNION ALL SELECT * FROM (VALUES ('domains', 'example.org', 'block', TIMESTAMP '2024-02-15', TIMESTAMP '2024-03-10'), ('domains', 'example.org', 'block', TIMESTAMP '2024-05-01', NULL))),
    m AS (SELECT page_id, list, key, action, row_number() OVER (PARTITION BY page_id ORDER BY contains(key, '/') DESC, len(key) - len(replace(key, '.', '')) DESC, action, list, key) AS n
          FROM p JOIN held ON (h = key OR ends_with(h, '.' || key) OR h || '/' || s = key) AND since <= fetched AND (until IS NULL OR until > fetched))
    SELECT p.page_id, p.url, p.fetched, coalesce(action, 'allow') AS verdict, list, key FROM p LEFT JOIN m ON p.page_id = m.page_id AND n = 1
    """
)
def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from shelfmark.llm.urlfilter import judge

    pages = table(spark, sf_dir, "pages")
    fetched = F.timestamp_add("DAY", F.col("page_id") % 180, F.lit("2024-01-01").cast("timestamp_ntz"))
    return judge(pages.withColumn("fetched", fetched), list_entries(pages))


def _license_sql() -> str:
    from shelfmark.llm.licenses import DIGESTS, EQUIVALENT, LICENCES

    def canonical(lines: str) -> str:
        """SQL for the canonical text of a list of lines."""
        kept = rf"list_filter({lines}, lambda l: NOT regexp_matches(l, '^[ \t*#/]*(copyright\b|\(c\)|©|all rights reserved)', 'i') OR regexp_matches(l, '^[ \t*#/]*copyright[ \t]+(holder|owner|notice|law)', 'i'))"
        t = rf"trim(regexp_replace(lower(array_to_string({kept}, chr(10))), '[^\p{{L}}\p{{M}}\p{{N}}]+', ' ', 'g'))"
        for other, one in EQUIVALENT:
            t = rf"regexp_replace({t}, '\b{other}(s?)\b', '{one}\1', 'g')"
        return t

    known = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in LICENCES)
    given = ", ".join(f"('{k}', '{d}')" for k, d in DIGESTS)
    return f"""
    WITH known AS (SELECT digest, min(license) AS license FROM (SELECT license, sha256({canonical("string_split(t, chr(10))")}) AS digest FROM (VALUES {known}) v(license, t) UNION ALL SELECT * FROM (VALUES {given})) GROUP BY 1),
    b AS MATERIALIZED (SELECT doc_id, text, row_number() OVER () AS rid FROM documents),
    d AS (SELECT doc_id, rid, {canonical("string_split_regex(text, '[\\n\\r]')")} AS c FROM b),
    l AS (SELECT rid, {canonical("[line]")} AS c FROM (SELECT rid, unnest(string_split_regex(text, '[\\n\\r]+')) AS line FROM b)),
    n AS (SELECT rid, array_to_string(list_sort(list(DISTINCT license)), ',') AS notices FROM l JOIN known ON sha256(l.c) = digest WHERE l.c <> '' GROUP BY rid)
    SELECT d.doc_id, CASE WHEN c <> '' THEN sha256(c) END AS digest, license, coalesce(notices, '') AS notices
    FROM d LEFT JOIN known ON c <> '' AND sha256(c) = digest LEFT JOIN n ON d.rid = n.rid
    """


@query(_license_sql())
def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfmark.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents"))


@query()
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfmark.llm.pii import scan

    return scan(table(spark, sf_dir, "documents"))
