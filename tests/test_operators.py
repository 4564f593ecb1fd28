"""Operators on small literal tables."""

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import text as fn
from shelfmark.operators import ranking, sequences, writes
from shelfmark.operators.builder import Query
from shelfmark.sources.catalog import Procedures, page_after, settings_map, works


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_gaps(spark):
    k = spark.createDataFrame([("a", 3), ("a", 4), ("a", 7), ("a", 7), ("b", 1), (None, 2), ("c", None)], "work string, k int")
    assert set(map(tuple, sequences.gaps(k, "work", "k").collect())) == {("a", "MISSING_START", 1, 2), ("a", "INTERNAL", 5, 6), (None, "MISSING_START", 1, 1)}


def test_writes(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    r = spark.createDataFrame([(2, "x"), (3, "y")], "id int, v string")
    assert rows(writes.insert_ignore(t, r, ["id"])) == [(1, "a"), (2, "b"), (3, "y")]
    assert rows(writes.upsert(t, r, ["id"])) == [(1, "a"), (2, "x"), (3, "y")]
    assert rows(writes.update_from(t, r, ["id"], ["v"])) == [(1, "a"), (2, "x")]
    assert rows(writes.delete_using(t, r, ["id"])) == [(1, "a")]


def test_ranking(spark):
    t = spark.createDataFrame([(g, i) for g in "ab" for i in range(5)], "g string, i int")
    assert rows(ranking.distinct_on(t, ["g"], [F.desc("i")])) == [("a", 4), ("b", 4)]
    assert [r.i for r in ranking.circular_after(t.where("g = 'a'"), "i", 2, 4).collect()] == [3, 4, 0, 1]
    assert rows(ranking.running_cap(t, ["g"], ["i"], F.col("i") % 2 == 0, 1).select("g", "i")) == [("a", 0), ("a", 1), ("b", 0), ("b", 1)]


def test_builder(spark):
    q = Query(spark.createDataFrame([(1, "a", ["x"]), (2, None, ["y"])], "id int, v string, t array<string>"))
    assert q.in_("id", []).df().count() == 0 and q.not_in("id", []).df().count() == 2
    assert q.is_("v", None).single().id == 2 and q.overlaps("t", ["x", "z"]).single().id == 1
    assert q.eq("id", 9).maybe_single() is None
    with pytest.raises(ValueError):
        q.single()
    assert [r.id for r in q.order("v").df().collect()] == [1, 2]


def test_aliases(spark):
    df = spark.createDataFrame([("C", ["C++", "c ++", "C Sharp", "C", "", None, "進撃"])], "p string, a array<string>")
    assert df.select(fn.merge_aliases("p", "a")).first()[0] == ["C++", "C Sharp", "進撃"]


def test_sources(spark):
    p = spark.createDataFrame([(1, "https://a.org/x", "<h1>The <b>Name</b></h1><a href=\"/1\">x</a>"), (2, None, None)], "page_id int, url string, html string")
    got = {r.page_id: r for r in works(p).collect()}
    assert (got[1].source, got[1].slug, got[1].title, got[1].links) == ("a.org", "the-name", "The Name", ["/1"]) and got[2].title is None
    first, cursor = page_after(spark.range(15), "id")
    assert cursor == 9 and page_after(spark.range(15), "id", cursor)[1] is None
    calls = Procedures()
    calls.register("n", lambda n: spark.range(n))
    assert calls.call("n", n=3).count() == 3 and settings_map(spark.createDataFrame([("a", "1")], "key string, value string")) == {"a": "1"}
    with pytest.raises(KeyError):
        calls.call("unknown")


def test_stream_equals_batch(spark):
    from shelfmark.plans.registry import QUERIES, load

    load()
    d = "/root/testdata/sf0.001"
    assert rows(QUERIES["stream_dedup"](spark, d).select("event_id")) == rows(spark.read.parquet(f"{d}/events.parquet").select("event_id").distinct())


def test_images(spark):
    from shelfmark.functions.media import inspect_image

    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big") + b"\x08\x06"
    gif = b"GIF89a" + (3).to_bytes(2, "little") + (4).to_bytes(2, "little") + b"\0" * 20
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + (50).to_bytes(2, "big") + (70).to_bytes(2, "big") + b"\0" * 20
    webp = b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (9).to_bytes(3, "little") + (19).to_bytes(3, "little")
    avif = b"\0\0\0\x1cftypavif" + b"\0" * 8 + b"ispe\0\0\0\0" + (8).to_bytes(4, "big") + (6).to_bytes(4, "big")
    wide = png[:16] + (20_000).to_bytes(4, "big") + png[20:]
    df = spark.createDataFrame(list(enumerate([png, gif, jpeg, webp, avif, wide, png[:20], b"text", None])), "i int, b binary")
    got = {r.i: tuple(r.m) for r in df.select("i", inspect_image("b").alias("m")).collect()}
    assert [got[i] for i in range(5)] == [("png", 640, 480, True), ("gif", 3, 4, True), ("jpeg", 70, 50, True), ("webp", 10, 20, True), ("avif", 8, 6, True)]
    assert not got[5][3] and got[6] == ("png", None, None, False) and got[7] == got[8] == (None, None, None, False)
