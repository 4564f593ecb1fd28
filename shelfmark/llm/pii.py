"""Personal data: base patterns, and bootstrapped contextual extraction of what they don't know.

Base matches are the seeds. The two words before a match are its lexical pattern; patterns and instances (matches and
other tokens that look like identifiers) form a graph, on which confidence goes back and forth: a pattern is as good
as the instances it introduces, an instance as the patterns that introduce it. Patterns that stay good and have enough
different instances mark the tokens they introduce as personal data too.

Words are runs of characters other than white space and the punctuation of BREAK. A run with a digit, @ or + is found as
such, so that what comes before it in the text is known from the runs and gaps before it, for seeds and tokens alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import small, written

KINDS = ("email", "ip", "card", "phone")
# The base patterns. Possessive where nothing can be given back, and begun at the start of a run of
# their first class or where the last match ended (no match can begin elsewhere), so that long runs cost linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What parts words, as a regex class.
BREAK = r"\s\"'<>()\[\]{},;"
#: Runs in which a base match may begin; those with a digit or @ and five characters or more may be identifiers.
RUN = rf"(?<![^{BREAK}])[^{BREAK}0-9@+]*+[0-9@+][^{BREAK}]*+"


def _checked(kind: Column, m: Column) -> Column:
    """Whether a base match is one, by its kind's further rule."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    parts = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    ip = F.forall(parts, lambda p: (F.length(p) <= 3) & (F.lpad(p, 3, "0") <= "255"))
    n = F.length(digits)
    value = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    double = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    luhn = F.aggregate(F.sequence(F.lit(1), F.when((n >= 13) & (n <= 19), n).otherwise(1)), F.lit(0), lambda a, i: a + F.when((n - i) % 2 == 1, double(value(i))).otherwise(value(i)))
    card = (n >= 13) & (n <= 19) & (luhn % 10 == 0)
    return F.when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", (n >= 9) & (n <= 15)).otherwise(True)


def _found(text: Column, kind: str, pattern: str) -> Column:
    """Matches of a pattern, leftmost and non-overlapping: kind, match, characters before it since the last; for runs
    the last two words of these, too."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
    none = F.array().cast("array<string>")
    last = lambda g: _last(F.filter(F.split(F.lower(g), f"[{BREAK}]+"), lambda w: w != ""))
    return F.transform(F.arrays_zip(matches.alias("m"), gaps.alias("g")), lambda z: F.struct(F.lit(kind).alias("kind"), z["m"].alias("m"), F.length(z["g"]).alias("gap"), (last(z["g"]) if kind == "run" else none).alias("words")))


def _last(words: Column) -> Column:
    """The last two words of some."""
    return F.slice(words, F.greatest(F.lit(1), F.size(words) - 1), F.lit(2))


def _pattern(words: Column) -> Column:
    """The words before a match in lower case, digits as 0; null without any."""
    return F.nullif(F.regexp_replace(F.array_join(words, " "), "[0-9]+", "0"), F.lit(""))


def discover(edges: DataFrame, rounds: int, support: int, confidence: float) -> DataFrame:
    """(pattern, instance, seed kind or null), distinct pairs, to (pattern, kind) of the patterns to be trusted.

    A pattern's confidence for a kind is the sum of its instances' confidences over their number plus one; a seed has 1
    for its kind and 0 for others, any other instance that of its best pattern. Patterns with fewer than `support`
    instances are never trusted. Sums and maxima are pre-aggregated, so a hot pattern or instance is no hot task.
    """
    many = written(edges.groupBy("pattern").agg(F.count("*").alias("n"), F.count("seed").alias("seeds")).where((F.col("n") >= support)), "patterns")
    links = written(edges.join(small(many), "pattern").select("pattern", "instance", "seed", "n"), "links")
    belief = links.where("seed is not null").select("instance", F.col("seed").alias("kind"), F.lit(1.0).alias("c")).distinct()
    trust = None
    for _ in range(rounds):
        sums = links.join(belief, "instance").groupBy("pattern", "kind").agg((F.sum("c") / (F.first("n") + 1)).alias("p"))
        trust = written(sums, "trust")
        fresh = links.where("seed is null").join(trust, "pattern").groupBy("instance", "kind").agg(F.max("p").alias("c"))
        seeds = links.where("seed is not null").select("instance", F.col("seed").alias("kind"), F.lit(1.0).alias("c")).distinct()
        belief = written(fresh.unionByName(seeds), "belief")
    return trust.where(F.col("p") >= confidence).groupBy("pattern").agg(F.max_by("kind", F.struct("p", "kind")).alias("kind"))


def scan(docs: DataFrame, rounds: int = 3, support: int = 5, confidence: float = 0.7) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_more of every row.

    spans are kind:start:end in code points, by kind as in KINDS, then start, joined by commas; the counts and the
    digest are of the base patterns' spans alone, n_more counts what trusted patterns add, outside of base spans. Null
    texts count as empty; rows are kept apart even if their ids repeat; texts are searched whole.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumn("any", F.col("text").rlike("[0-9@]"))
    some = rows.where("any").select("doc_id", F.monotonically_increasing_id().alias("rid"), F.concat(*(_found(F.col("text"), k, p) for k, p in (PATTERNS | {"run": RUN}).items())).alias("f"))
    kept = written(some, "found")  # what is written keeps its rid
    each = kept.select("rid", F.posexplode("f").alias("i", "x")).select("rid", "i", "x.*")
    before = Window.partitionBy("rid", "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.length("m")).over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    word = lambda n: F.array(F.lower(F.lag("m", n).over(before)))
    prior = F.concat(word(2), F.coalesce(F.lag("words").over(before), F.array().cast("array<string>")), word(1), "words")
    run = F.col("kind") == "run"
    placed = each.withColumn("end", end).withColumn("start", F.col("end") - F.length("m")).withColumn("words", F.when(run, _last(F.filter(prior, lambda w: w.isNotNull()))))
    sound = placed.where(run | _checked(F.col("kind"), F.col("m")))
    # a base match begins in the last run that begins no later: what the run has before it is a word of its context
    base_end, base_start = F.when(~run, F.col("end")), F.when(~run, F.col("start"))
    order = Window.partitionBy("rid").orderBy("start", F.when(run, 0).otherwise(1), F.desc("end"), "kind")
    # frames that only grow, as those to the end of a window take quadratic time
    back = Window.partitionBy("rid").orderBy(F.desc("start"), F.when(run, 1).otherwise(0), "end", F.desc("kind"))
    so_far, ahead = (w.rowsBetween(Window.unboundedPreceding, Window.currentRow) for w in (order, back))
    its = F.last(F.when(run, F.struct("start", "m", "words")), ignorenulls=True).over(so_far)
    near = sound.withColumn("left", F.max(base_end).over(so_far)).withColumn("right", F.min(base_start).over(ahead)).withColumn("in", its)
    part = F.substring(F.lower("in.m"), F.lit(1), F.col("start") - F.col("in.start"))
    context = F.when(part == "", F.col("in.words")).otherwise(_last(F.concat("in.words", F.array(part))))
    # tokens lose their last punctuation, and those that touch a base span are part of it
    cut = F.when(run, F.regexp_replace("m", r"[.,:!?%#*&$|-]+$", "")).otherwise(F.col("m"))
    trimmed = near.withColumn("pattern", _pattern(context)).withColumn("kind", F.when(run, "token").otherwise(F.col("kind"))).withColumn("m", cut).withColumn("end", F.col("start") + F.length("m")).where(F.length("m") >= 5)
    clear = (F.coalesce("left", F.lit(0)) <= F.col("start")) & (F.coalesce("right", F.col("end")) >= F.col("end")) & F.col("m").rlike("[0-9@]")
    spans = written(trimmed.where((F.col("kind") != "token") | clear).select("rid", "kind", "start", "end", "pattern", F.lower("m").alias("instance")), "spans")
    seed = F.when(F.col("kind") != "token", F.col("kind"))
    edges = written(spans.where("pattern is not null").groupBy("pattern", "instance").agg(F.max(seed).alias("seed")), "edges")
    trusted = small(written(discover(edges, rounds, support, confidence).withColumnRenamed("kind", "as"), "trusted"))
    more = spans.where("kind = 'token'").join(trusted, "pattern").select("rid", F.col("as").alias("kind"), "start", "end", F.lit(0).alias("base"))
    base = spans.where("kind <> 'token'").select("rid", "kind", "start", "end", F.lit(1).alias("base"))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    listed = base.unionByName(more).groupBy("rid").agg(F.array_sort(F.collect_list(F.struct(rank.alias("r"), "start", "end", "kind", "base"))).alias("s"))
    at = written(kept.select("rid", "doc_id"), "ids").join(listed, "rid", "left").select("doc_id", "s")
    out = at.unionByName(rows.where("not any").select("doc_id", F.lit(None).cast(at.schema["s"].dataType).alias("s")))
    s = F.coalesce("s", F.array().cast(at.schema["s"].dataType))
    only = F.filter(s, lambda x: x["base"] == 1)
    join = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter(only, lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *map(count, KINDS), F.sha2(join(only), 256).alias("base_sha256"), join(s).alias("spans"), (F.size(s) - F.size(only)).cast("long").alias("n_more"))
