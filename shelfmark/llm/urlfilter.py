"""URL filters: dated list entries become validity intervals, and captures meet the entries active when they were fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import small, written

#: Days of a bucket of time: an interval is found in every bucket it touches, a capture in its own.
BUCKET_DAYS = 32


def host_of(url: Column) -> Column:
    """Host of a URL in lower case, without user, port and final dot; '' for none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*+@)?([^/?#:]*?)\.?(?=[/?#:]|$)", 1)), F.lit(""))


def segments_of(url: Column) -> Column:
    """Segments of a URL's path that aren't empty."""
    return F.filter(F.split(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*+([^?#]*)", 1), "/"), lambda s: s != "")


def intervals(entries: DataFrame) -> DataFrame:
    """(list, key, action, op, at) to (list, key, action, since, until): until is null while an entry is active.

    An add holds until the next entry of its list, key and action; at one instant a remove wins. Keys are the same in any
    case. Entries with a null key, action, op or time are ignored; repeated ones change nothing.
    """
    sound = entries.where("key is not null and action is not null and op is not null and at is not null").select("list", F.lower("key").alias("key"), "action", "op", "at").distinct()
    order = Window.partitionBy("list", "key", "action").orderBy("at", "op")  # add before remove
    held = sound.withColumn("until", F.lead("at").over(order)).where("op = 'add' and (until is null or until > at)")
    return held.select("list", "key", "action", F.col("at").alias("since"), "until")


def judge(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched", id_col: str = "page_id") -> DataFrame:
    """id, url, fetched, verdict ('allow' or 'block'), list, key of every capture.

    A key is a host, which covers its subdomains, or a host and the first segments of a path (`a.org/x/y`). Of the
    entries active at the fetch time the most specific decides: paths before hosts, longer before shorter, then allow
    before block, then the list and key that come first. Nothing active, or a null url or time: allow, with a null key.
    Rows may repeat. Only as many labels and segments are looked at as the lists' longest keys have.
    """
    held = intervals(entries)
    last = captures.agg(F.max(time_col)).first()[0]
    day = lambda c: F.floor(F.unix_timestamp(c.cast("timestamp")) / (86400 * BUCKET_DAYS))
    held = held.where(F.col("since") <= F.lit(last)) if last is not None else held.limit(0)
    held = held.withColumn("bucket", F.explode(F.sequence(day(F.col("since")), day(F.least(F.coalesce("until", F.lit(last)), F.lit(last))))))
    held = written(held, "intervals")
    most = held.agg(F.max(F.size(F.split(F.substring_index("key", "/", 1), r"\."))).alias("labels"), F.max(F.size(F.split("key", "/")) - 1).alias("segments")).first()
    labels, deepest = most["labels"] or 0, most["segments"] or 0
    parts = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(time_col).alias("fetched")).withColumns({"_h": host_of(F.col("url")), "_s": F.slice(segments_of(F.col("url")), 1, max(1, deepest))})
    hosts = F.transform(F.sequence(F.lit(1), F.lit(max(1, labels))), lambda i: F.call_function("substring_index", F.col("_h"), F.lit("."), -i))
    paths = F.transform(F.sequence(F.lit(1), F.lit(max(1, deepest))), lambda i: F.when(i <= F.size("_s"), F.concat(F.col("_h"), F.lit("/"), F.array_join(F.slice("_s", F.lit(1), i), "/"))))
    keys = F.when(F.col("url").isNotNull() & (F.col("_h") != ""), F.array_distinct(F.concat(hosts, F.filter(F.transform(paths, F.lower), lambda k: k.isNotNull()))))
    # a first key that no list has keeps every capture, and goes where its own hash says
    own = F.concat(F.lit("\0"), F.xxhash64("id", "url", "fetched").cast("string"))
    keyed = parts.select("id", "url", "fetched", F.posexplode(F.concat(F.array(own), F.coalesce(keys, F.array().cast("array<string>")))).alias("i", "k"), day(F.col("fetched")).alias("b"))
    known = small(held)
    on = (keyed.k == known.key) & (keyed.b == known.bucket) & (known.since <= keyed.fetched) & (known.until.isNull() | (known.until > keyed.fetched))
    depth = F.when(F.contains(F.col("key"), F.lit("/")), 1000 + F.size(F.split("key", "/"))).otherwise(F.size(F.split("key", r"\.")))
    hit = F.when(F.col("key").isNotNull(), F.struct((-depth).alias("depth"), "action", F.col("list"), F.col("key")))  # 'allow' < 'block'
    met = keyed.join(known, on, "left").groupBy("id", "url", "fetched").agg(F.min(hit).alias("hit"), F.count(F.when(F.col("i") == 0, 1)).alias("times"))
    rows = met.withColumn("times", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return rows.select(F.col("id").alias(id_col), F.col("url").alias(url_col), F.col("fetched").alias(time_col), F.coalesce("hit.action", F.lit("allow")).alias("verdict"), "hit.list", "hit.key")
