"""Folds over ordered samples of a group: source tiers, circuit breakers, rate limits; and fair shares of slots.

Samples are dealt out by group and sorted within each part, and a part is folded as a stream of Arrow batches: a fold
keeps a few numbers and the batch at hand, so that no group is ever collected. A fold over a stream keeps the same state
between batches (see shelfmark.streaming).
"""

from __future__ import annotations

from collections import deque, namedtuple
from collections.abc import Iterator
from datetime import UTC, datetime
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _fold(df: DataFrame, key: str, order: list[str], fields: str, step, start) -> DataFrame:
    """One row for each group: the state after the last sample, as step(state, row) leaves it from start(). Null keys are a group."""
    kinds = {"double": pa.float64(), "string": pa.string(), "long": pa.int64()}
    outs = [f.split() for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = (), {}

        def batch(done):
            columns = zip(*done, strict=True) if done else [()] * (len(outs) + 1)
            types = [key_type, *(kinds[t] for _, t in outs)]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=[key, *(n for n, _ in outs)])

        key_type = None
        for b in batches:
            row_of, done = namedtuple("Row", b.schema.names), []
            key_type = b.schema.field(key).type
            for row in map(row_of._make, zip(*(c.to_pylist() for c in b.columns), strict=True)):
                k = getattr(row, key)
                if now != (k,):
                    if now:
                        done.append((now[0], *(state[n] for n, _ in outs)))
                    now, state = (k,), start()
                step(state, row)
            yield batch(done)
        if now:
            yield batch([(now[0], *(state[n] for n, _ in outs))])

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, {fields}")


def _seconds(at: datetime) -> float:
    return (at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp()


def _p95(ring: list[float]) -> float:
    return sorted(ring)[min(len(ring) - 1, int(len(ring) * 0.95))]


def source_start() -> dict:
    """A source of which nothing is known: normal speed."""
    return {"tier": "NORMAL", "pages": 0, "chapters": 0, "failures": 0, "page_ms": 4200.0, "chapter_ms": 65_000.0, "per_chapter": 24.0, "success": 0.98, "ring": [], "p95_ms": 0.0}


def source_step(s: dict, kind: str, ms: float, pages: int = 0, keep: int = 32) -> None:
    """Takes in a page, a chapter or a failure of a source: smoothed figures, the last `keep` page times, the tier.

    The first four pages weigh 0.35 each and later ones 0.15, the first two chapters 0.45 and later ones 0.25.
    """
    if kind == "page":
        ms = max(20.0, min(120_000.0, ms))
        if len(s["ring"]) < keep:
            s["ring"].append(ms)
        else:
            s["ring"][s["pages"] % keep] = ms
        s["pages"] += 1
        s["page_ms"] += (0.35 if s["pages"] <= 4 else 0.15) * (ms - s["page_ms"])
        s["success"] = min(1.0, s["success"] * 0.97 + 0.03)
    elif kind == "chapter":
        ms = max(100.0, min(600_000.0, ms))
        s["chapters"] += 1
        alpha = 0.45 if s["chapters"] <= 2 else 0.25
        s["chapter_ms"] += alpha * (ms - s["chapter_ms"])
        if pages > 0:
            s["per_chapter"] += alpha * (pages - s["per_chapter"])
        s["success"] += 0.25 * (1 - s["success"])
    else:
        s["failures"] += 1
        s["success"] *= 0.75
        s["chapter_ms"] = min(300_000.0, s["chapter_ms"] * 0.85 + max(min(600_000.0, ms), 120_000.0) * 0.15)
    s["tier"] = source_tier(s)
    s["p95_ms"] = _p95(s["ring"]) if s["ring"] else 0.0


def source_tier(s: dict) -> str:
    """FAST, NORMAL or SLOW; bounds to leave a tier are wider than those to enter it. Little evidence changes nothing."""
    if s["pages"] < 12 and s["chapters"] < 2 and s["failures"] < 3:
        return s["tier"]
    n, page, success, chapters = len(s["ring"]), s["page_ms"], s["success"], s["chapters"]
    p95 = _p95(s["ring"]) if n >= 6 else page * 1.35
    chapter = s["chapter_ms"] * (24 / s["per_chapter"] if s["per_chapter"] > 24 else 1)
    if not (chapters >= 2 and chapter <= 75_000 and success >= 0.9 and page < 7500):
        at, tail, floor, long = (5200, 11_500, 3200, 95_000) if s["tier"] == "SLOW" else (7000, 15_000, 4500, 135_000)
        failing = success < 0.84 if s["tier"] == "SLOW" else chapters + s["failures"] >= 3 and success < 0.72
        if page >= at or (n >= 8 and p95 >= tail and page >= floor) or (chapters >= 2 and chapter >= long) or failing:
            return "SLOW"
    most, tail, sure, least, long = (3500, 7800, 2000, 0.85, 70_000) if s["tier"] == "FAST" else (2800, 6500, 1800, 0.9, 55_000)
    quick = page <= most and (n < 8 or p95 <= tail or page <= sure) and success >= least and (chapters == 0 or chapter <= long)
    return "FAST" if quick else "NORMAL"


def source_tiers(samples: DataFrame, key: str, order: list[str], kind: str, ms: str, pages: str) -> DataFrame:
    """Tier and smoothed figures of each source. Samples: kind (page, chapter, failure), milliseconds, pages; null times are skipped."""
    fields = "tier string, page_ms double, p95_ms double, chapter_ms double, success double, pages long, chapters long, failures long"
    return _fold(samples.where(f"{ms} is not null"), key, order, fields, lambda s, r: source_step(s, getattr(r, kind), float(getattr(r, ms)), int(getattr(r, pages) or 0)), source_start)


def breaker_step(s: dict, now: float, ok: bool, failures: int = 3, base_s: int = 60, most_s: int = 3600) -> None:
    """Takes in an event of a source; those that come while its breaker is open are refused."""
    if s["state"] == "OPEN" and now >= s["until"]:
        s["state"] = "HALF_OPEN"
    if s["state"] == "OPEN":
        s["refused"] += 1
    elif ok:
        s.update(state="CLOSED", run=0)
    else:
        s["run"] += 1
        wait = min(most_s, base_s * 2 ** min(max(0, s["run"] - failures), 5))
        if s["state"] == "HALF_OPEN" or s["run"] >= failures:
            s.update(state="OPEN", until=now + wait, wait_s=wait, trips=s["trips"] + 1)
        else:
            s["state"] = "DEGRADED"


def breakers(events: DataFrame, key: str, order: list[str], at: str, ok: str) -> DataFrame:
    """Circuit breaker of each source: DEGRADED after a failure, OPEN after three in a row, HALF_OPEN when its wait is over.

    A wait doubles with every failure in a row beyond the third, five times at most, and is never over an hour.
    """
    start = lambda: {"state": "CLOSED", "run": 0, "trips": 0, "until": 0.0, "refused": 0, "wait_s": 0}
    return _fold(events, key, order, "state string, trips long, refused long, wait_s long", lambda s, r: breaker_step(s, _seconds(getattr(r, at)), getattr(r, ok)), start)


def limit_start(rate: float = 5.0) -> dict:
    return {"rate": rate, "least": max(1.0, rate * 0.5), "most": max(rate * 2.5, 16.0), "tokens": float(max(2, ceil(rate * 2))), "last": None, "run": 0, "tries": 0, "until": 0.0, "recent": deque(), "admitted": 0, "refused": 0, "waited_s": 0.0}


def limit_step(s: dict, now: float, ok: bool, cut: float = 0.8, per_minute: int = 60) -> None:
    """Takes in a request of a host: refused while the host is blocked or had so many in the last 60 s; else it takes a
    token, for which it may wait. Every 8th success in a row adds 0.5 a second, a failure cuts the rate and blocks."""
    while s["recent"] and now - s["recent"][0] >= 60:
        s["recent"].popleft()
    if now < s["until"] or len(s["recent"]) >= per_minute:
        s["refused"] += 1
        return
    if s["last"] is not None:
        s["tokens"] = min(float(max(2, ceil(s["rate"] * 2))), s["tokens"] + max(0.0, now - s["last"]) * s["rate"])
    s["last"] = max(now, s["last"] or now)
    if s["tokens"] < 1:
        wait = (1 - s["tokens"]) / s["rate"]
        s.update(waited_s=s["waited_s"] + wait, last=s["last"] + wait, tokens=1.0)
    s["tokens"] -= 1
    s["recent"].append(now)
    s["admitted"] += 1
    if ok:
        s.update(run=s["run"] + 1, tries=0)
        if s["run"] >= 8:
            s.update(run=0, rate=min(s["most"], s["rate"] + 0.5))
    else:
        s["tries"] += 1
        s.update(run=0, rate=max(s["least"], s["rate"] * cut), until=now + min(60, 2 ** min(s["tries"], 6) * 2))


def rate_limits(events: DataFrame, key: str, order: list[str], at: str, ok: str) -> DataFrame:
    """Token bucket of each host with additive increase and multiplicative decrease, and a cap on any 60 s."""
    return _fold(events, key, order, "rate double, admitted long, refused long, waited_s double", lambda s, r: limit_step(s, _seconds(getattr(r, at)), getattr(r, ok)), limit_start)


# What a unit of demand counts by tier.
WEIGHTS = {"FAST": 3.0, "NORMAL": 1.0, "SLOW": 0.35}


def _dealt(entries: DataFrame, slots: int, weighted: bool) -> DataFrame:
    """(source, slots): one each, then one by one to the highest demand for each slot held, none above its maximum.

    A source with k slots asks with demand / k, so the slots go to the highest quotients of all: a top-k, no loop.
    """
    left = max(0, slots - entries.count())
    asks = entries.select("source", "maximum", "weight", "demand", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.col("maximum") - 1, F.lit(max(1, left)))))).alias("k")).where("k < maximum")
    value = F.col("demand") * (F.col("weight") if weighted else F.lit(1.0)) / F.col("k")
    won = asks.orderBy(value.desc(), *([F.desc("weight")] if weighted else []), F.desc("maximum"), "source", "k").limit(left).groupBy("source").agg(F.count("*").alias("more"))
    return entries.join(won, "source", "left").select("source", (1 + F.coalesce("more", F.lit(0))).alias("slots"))


def fair_allocation(demand: DataFrame, slots: int) -> DataFrame:
    """(source, slots) for rows (source, demand, most, tier): capacity by demand, with a part of it for slow sources.

    A source has one slot at least, and never more than its own limit or demand. With sources of both kinds, slow ones
    share a quarter of the slots (two at least) or what the others leave, two or three each where demand is strong.
    """
    tier = F.coalesce("tier", F.lit("NORMAL"))
    weight = F.create_map(*(F.lit(x) for pair in WEIGHTS.items() for x in pair))[tier]
    entries = demand.where("demand > 0").select("source", "demand", F.greatest(F.lit(1), F.least("most", "demand")).cast("int").alias("maximum"), tier.alias("tier"), weight.alias("weight"))
    slow = F.col("tier") == "SLOW"
    n, n_slow, need, need_slow = entries.agg(F.count("*"), F.count(F.when(slow, 1)), F.coalesce(F.sum(F.when(~slow, F.col("maximum"))), F.lit(0)), F.coalesce(F.sum(F.when(slow, F.col("maximum"))), F.lit(0))).first()
    if n_slow in (0, n):
        return _dealt(entries, slots, True)
    reserve = max(2, slots // 4)
    for_slow = min(need_slow, max(reserve, slots - need))
    strong = need > slots - reserve
    each = (2 if n_slow >= 3 else min(3, for_slow)) if strong else slots
    main = _dealt(entries.where(~slow), max(n - n_slow, slots - for_slow), True)
    rest = entries.where(slow).withColumn("maximum", F.greatest(F.lit(1), F.least("maximum", F.lit(each))))
    return main.unionByName(_dealt(rest, for_slow, False))
