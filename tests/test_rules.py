"""Rules and folds against plain Python that was written from the rules alone."""

import math
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.functions import titles
from shelfmark.operators import folds, leases, quantiles, sequences


def test_fold_follows_unicode(spark):
    """Accents go from Latin, Greek and Cyrillic letters; kana and Hangul stay whole."""
    texts = ["Ação ÉTÉ", "Ёжик Й", "άέή", "ブ パ ガ", "나 혼자", "ＡＢＣ", "e\u0301a\u0308", "ß ø", None, ""]

    def plain(s):
        return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if not "\u0300" <= c <= "\u036f"))

    got = spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", titles.folded(F.col("s")).alias("f")).collect()
    assert {r.i: r.f for r in got} == {i: None if s is None else plain(s) for i, s in enumerate(texts)}


def brute_tier(samples):
    """The figures of a source, a sample at a time."""
    page, chapter, per, ok, tier, times, pages, chapters, bad = 4200.0, 65000.0, 24.0, 0.98, "NORMAL", [], 0, 0, 0
    for kind, ms, n in samples:
        if kind == "page":
            ms = min(max(ms, 20), 120000)
            times.append(ms)
            pages += 1
            w = 0.35 if pages < 5 else 0.15
            page, ok = page * (1 - w) + ms * w, min(1, ok * 0.97 + 0.03)
        elif kind == "chapter":
            ms = min(max(ms, 100), 600000)
            chapters += 1
            w = 0.45 if chapters < 3 else 0.25
            chapter, ok = chapter * (1 - w) + ms * w, ok * 0.75 + 0.25
            per = per * (1 - w) + n * w if n else per
        else:
            bad += 1
            ok, chapter = ok * 0.75, min(300000, chapter * 0.85 + max(min(ms, 600000), 120000) * 0.15)
        last = sorted(times[-32:])
        if not (pages >= 12 or chapters >= 2 or bad >= 3):
            continue
        p95 = last[min(len(last) - 1, math.floor(len(last) * 0.95))] if len(last) >= 6 else page * 1.35
        long = chapter * 24 / per if per > 24 else chapter
        proven = chapters >= 2 and long <= 75000 and ok >= 0.9 and page < 7500
        if tier == "SLOW":
            slow = page >= 5200 or (len(last) >= 8 and p95 >= 11500 and page >= 3200) or (chapters >= 2 and long >= 95000) or ok < 0.84
        else:
            slow = page >= 7000 or (len(last) >= 8 and p95 >= 15000 and page >= 4500) or (chapters >= 2 and long >= 135000) or (chapters + bad >= 3 and ok < 0.72)
        if slow and not proven:
            tier = "SLOW"
        elif tier == "FAST":
            tier = "FAST" if page <= 3500 and (len(last) < 8 or p95 <= 7800 or page <= 2000) and ok >= 0.85 and (not chapters or long <= 70000) else "NORMAL"
        else:
            tier = "FAST" if page <= 2800 and (len(last) < 8 or p95 <= 6500 or page <= 1800) and ok >= 0.9 and (not chapters or long <= 55000) else "NORMAL"
    return tier, page, chapter, ok, pages, chapters, bad


def test_source_tiers(spark):
    rng, rows, want = np.random.default_rng(4), [], {}
    for k in range(40):
        speed, bad = float(rng.choice([300, 2000, 5000, 9000])), float(rng.choice([0, 0.1, 0.5]))
        mine = []
        for i in range(int(rng.integers(0, 90))):
            kind = "failure" if rng.random() < bad else "chapter" if rng.random() < 0.2 else "page"
            mine.append((kind, float(rng.gamma(2, speed / 2) * (1 if kind == "page" else 20)), int(rng.integers(0, 60))))
            rows.append((f"s{k}", i, *mine[-1]))
        if mine:
            want[f"s{k}"] = brute_tier(mine)
    rows.append(("s0", 1000, "page", None, 0))
    got = folds.source_tiers(spark.createDataFrame(rows, "source string, i int, kind string, ms double, n int"), "source", ["i"], "kind", "ms", "n").collect()
    assert {r.source: (r.tier, *(pytest.approx(x) for x in (r.page_ms, r.chapter_ms, r.success)), r.pages, r.chapters, r.failures) for r in got} == want
    assert {w[0] for w in want.values()} == {"FAST", "NORMAL", "SLOW"}


def test_breaker_waits_follow_failures_in_a_row():
    s = {"state": "CLOSED", "run": 0, "trips": 0, "until": 0.0, "refused": 0, "wait_s": 0}
    now, seen = 0.0, []
    for _ in range(10):
        folds.breaker_step(s, now, False)
        seen.append((s["state"], s["wait_s"]))
        now = max(now + 1, s["until"])
    assert seen == [("DEGRADED", 0), ("DEGRADED", 0), ("OPEN", 60), ("OPEN", 120), ("OPEN", 240), ("OPEN", 480), ("OPEN", 960), ("OPEN", 1920), ("OPEN", 1920), ("OPEN", 1920)]
    folds.breaker_step(s, now - 1, False)
    assert s["refused"] == 1
    folds.breaker_step(s, now, True)
    assert (s["state"], s["run"]) == ("CLOSED", 0)


def test_rate_limits():
    s = folds.limit_start(5.0)
    for i in range(16):
        folds.limit_step(s, i * 0.01, True)
    assert s["rate"] == 6.0 and s["admitted"] == 16 and s["waited_s"] > 0
    folds.limit_step(s, 10.0, False)
    assert s["rate"] == pytest.approx(4.8) and s["until"] == 14.0
    folds.limit_step(s, 13.0, True)
    assert s["refused"] == 1
    for i in range(100):
        folds.limit_step(s, 20.0 + i * 0.3, True)
    assert s["refused"] == 1 + 100 - (60 - 17)  # sixty in any minute
    folds.limit_step(s, 200.0, True)
    assert s["admitted"] == 61


def test_fair_allocation(spark):
    """One slot at a time to whoever asks for most."""
    rng = np.random.default_rng(9)
    for tiers in (["NORMAL"], ["FAST", "NORMAL", "SLOW"]):
        rows = [(f"s{i:02}", int(rng.integers(0, 40)), int(rng.integers(1, 9)), tiers[i % len(tiers)]) for i in range(13)]
        for slots in (5, 20, 37, 200):
            def deal(entries, n, weigh):
                given = {e[0]: 1 for e in entries}
                for _ in range(max(0, n - len(entries))):
                    free = [e for e in entries if given[e[0]] < e[2]]
                    if not free:
                        break
                    w = lambda e: folds.WEIGHTS[e[3]] if weigh else 1.0
                    best = min(free, key=lambda e: (-e[1] * w(e) / given[e[0]], -w(e), -e[2], e[0]))
                    given[best[0]] += 1
                return given

            entries = [(s, d, max(1, min(m, d)), t) for s, d, m, t in rows if d > 0]
            main, slow = [e for e in entries if e[3] != "SLOW"], [e for e in entries if e[3] == "SLOW"]
            if not main or not slow:
                want = deal(entries, slots, True)
            else:
                need, reserve = sum(e[2] for e in main), max(2, slots // 4)
                part = min(sum(e[2] for e in slow), max(reserve, slots - need))
                each = (2 if len(slow) >= 3 else min(3, part)) if need > slots - reserve else slots
                want = deal(main, max(len(main), slots - part), True) | deal([(s, d, max(1, min(m, each)), t) for s, d, m, t in slow], part, False)
            got = folds.fair_allocation(spark.createDataFrame(rows, "source string, demand int, most int, tier string"), slots).collect()
            assert {r.source: r.slots for r in got} == want, (tiers, slots)


def test_leases_belong_to_their_owner(spark):
    kind = "id int, type string, status string, priority int, attempts int, max_attempts int, owner string, lease_until timestamp, next_run timestamp, error string"
    at = lambda s: F.expr(f"timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, {s})")
    rows = [(1, "A", "IMPORTING", 1, 5, 5, "x", 100), (2, "D", "IMPORTING", 1, 9, 5, "x", 100), (3, "A", "IMPORTING", 1, 1, 5, "y", 900), (4, "A", "QUEUED", 5, 0, 5, None, None), (5, "A", "RETRY", 9, 0, 5, None, None)]
    t = spark.createDataFrame([(*r[:7], None, None, None) for r in rows], kind).withColumn("lease_until", F.when(F.col("id") < 3, at(100)).when(F.col("id") == 3, at(900))).withColumn("next_run", F.when(F.col("id") == 5, at(800)).otherwise(at(0)))
    now = at(500)
    got = {r.id: r for r in leases.recover(t, now, F.col("type") == "D").collect()}
    assert [(got[i].status, got[i].owner) for i in (1, 2, 3)] == [("BLOCKED", None), ("RETRY", None), ("IMPORTING", "y")]
    beats = spark.createDataFrame([(3, "x"), (1, "x")], "id int, worker string")
    kept = {r.id: r.lease_until for r in leases.renew(t, beats, now).collect()}
    before = {r.id: r.lease_until for r in t.collect()}
    assert kept[3] == before[3] and kept[1] > before[1]
    ends = spark.createDataFrame([(3, "x", "COMPLETED", None, None), (1, "x", "RETRY", "why", 7)], "id int, worker string, status string, error string, delay_s int")
    done = {r.id: (r.status, r.owner, r.error) for r in leases.release(t, ends, now).collect()}
    assert done[3] == ("IMPORTING", "y", None) and done[1] == ("RETRY", None, "why")
    took = {r.id: (r.status, r.owner, r.attempts) for r in leases.claim(t, now, "z", 2).collect()}
    assert took[4] == ("IMPORTING", "z", 1) and took[1] == ("IMPORTING", "z", 6) and took[5][0] == "RETRY" and took[2][1] == "x"


def test_nearest_ranks(spark):
    rng = np.random.default_rng(5)
    data = {"a": rng.normal(0, 1, 5000).round(3).tolist(), "b": [1.0] * 700 + [2.0] * 3, "c": [5.0], None: rng.integers(0, 5, 99).astype(float).tolist()}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs] + [("a", None), ("d", None)], "k string, v double")
    got = {(r.k, r.p): r.v for r in quantiles.nearest_ranks(df, "k", "v", [0.0, 0.5, 0.95, 1.0]).collect()}
    assert got == {(k, p): sorted(v)[min(len(v) - 1, math.floor(len(v) * p))] for k, v in data.items() for p in (0.0, 0.5, 0.95, 1.0)}


def test_increasing_and_covered(spark):
    df = spark.sql("SELECT * FROM VALUES ('a', 1, timestamp'2024-01-02'), ('a', 2, timestamp'2024-01-01'), ('a', 3, timestamp'2024-01-01'), ('a', 4, timestamp'2024-01-02 00:00:00.002'), ('b', 1, NULL) t(g, i, at)")
    got = [(r.g, r.i, str(r.at)) for r in sequences.increasing(df, "g", "i", "at").orderBy("g", "i").collect()]
    assert got == [("a", 1, "2024-01-02 00:00:00"), ("a", 2, "2024-01-02 00:00:00.001000"), ("a", 3, "2024-01-02 00:00:00.002000"), ("a", 4, "2024-01-02 00:00:00.003000"), ("b", 1, "None")]
    points = spark.createDataFrame([("a", k) for k in range(8)] + [(None, 1)], "g string, k int")
    spans = spark.createDataFrame([("a", 1, 2), ("a", 1, 4), ("a", 6, 6), (None, 0, 9), ("b", 0, 9)], "g string, start int, end int")
    assert sorted(r.k for r in sequences.covered(points, spans, "g", "k").collect()) == [1, 2, 3, 4, 6]
    assert sorted((r.g or "", r.k) for r in sequences.covered(points, spans, "g", "k", inside=False).collect()) == [("", 1), ("a", 0), ("a", 5), ("a", 7)]
