"""Benchmark decontamination: short test items inside long documents, by size-partitioned MinHash containment.

A MinHash of a long document says nothing about a short passage in it, so only the items are sketched: the shingles
with the least hashes. Items are partitioned by the number of their shingles (powers of two), and all of a partition
have as many values as guarantee that a document holding the threshold's share of an item's shingles holds some of
its sketch. Documents look up their shingles in the sketches; candidates with enough values are verified by exact
containment of shingles as text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import small, written


def normal_words(text: Column) -> Column:
    """Lower-case runs of letters, marks and digits; an empty array for null and for none."""
    return F.array_remove(F.coalesce(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), F.array().cast("array<string>")), "")


def shingle_rows(df: DataFrame, text: str, keep: list[str], width: int) -> DataFrame:
    """A row for each run of `width` words: the kept columns and w0, w1, ... A text of fewer words has none."""
    # a generator keeps the optimizer from writing the words' expression into each of its uses
    words = df.select(*keep, F.explode(F.array(normal_words(F.col(text)))).alias("_w")).where(F.size("_w") >= width)
    runs = words.withColumn("n", F.size("_w") - (width - 1))
    shifted = [F.slice("_w", i + 1, F.col("n")).alias(f"w{i}") for i in range(width)]
    zipped = runs.select(*keep, F.arrays_zip(*shifted).alias("_z"))
    # never empty; the outer form spares a filter that would make the arrays a second time
    return zipped.select(*keep, F.inline_outer("_z").alias(*(f"w{i}" for i in range(width))))


def _runs(width: int) -> list[str]:
    return [f"w{i}" for i in range(width)]


#: Bits of the map of sketch values that spares most shingles of documents the shuffle.
MAP_BITS = 1 << 24


def _likely(rows: DataFrame, sketch: DataFrame) -> DataFrame:
    """The rows whose h may be in the sketch, by a map of bits of fixed size: none is lost."""
    at = F.pmod("h", F.lit(MAP_BITS))
    set_ = sketch.select(at.alias("b")).groupBy(F.floor(F.col("b") / 64).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("bits"))
    words = sketch.sparkSession.range(MAP_BITS // 64).withColumnRenamed("id", "i").join(F.broadcast(set_), "i", "left").select("i", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    one = words.agg(F.array_sort(F.collect_list(F.struct("i", "bits")))["bits"].alias("_map"))  # one row of a fixed size
    word = F.element_at("_map", (F.floor(at / 64) + 1).cast("int"))
    return rows.crossJoin(F.broadcast(written(one, "map"))).where(F.getbit(word, (at % 64).cast("int")) == 1).drop("_map")


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8, width: int = 5) -> DataFrame:
    """doc_id, item_id, shared, item_shingles, containment of all pairs that share at least that part of the item.

    Shingles have `width` words; an item of fewer words is one shingle of all its words, and is found wherever a document
    has them in a row. Rows that share an id are one document or item (an item of rows of several widths counts the
    shingles of all); null ids are an id too. Null texts and texts without words never match. Both tables may have
    further columns. Empty tables give an empty result.
    """
    have = F.size(normal_words(F.col("text")))
    of_items = None
    for w in range(1, width + 1):
        some = items.where(have == w) if w < width else items.where(have >= width)
        made = shingle_rows(some.select("item_id", "text"), "text", ["item_id"], w).select("item_id", F.concat_ws(" ", *_runs(w)).alias("s"), F.xxhash64(*_runs(w)).alias("h"), F.lit(w).alias("w"))
        of_items = made if of_items is None else of_items.unionByName(made)
    known = written(of_items.distinct().withColumn("m", F.count("*").over(Window.partitionBy("item_id"))), "items")
    widths = sorted(r.w for r in known.select("w").distinct().collect())  # width of them at most
    if not widths:
        widths = [width]

    def shingles(df: DataFrame, *of) -> DataFrame:
        """doc_id and one column: of(runs) of each shingle of each of the items' widths."""
        made = [shingle_rows(df.select("doc_id", "text"), "text", ["doc_id"], w).select("doc_id", *(f(_runs(w)) for f in of)) for w in widths]
        return reduce(DataFrame.unionByName, made)

    spare = F.floor(F.lit(1 - threshold + 1e-9) * F.col("m")).cast("int")
    part = F.floor(F.log2("m") + 1e-9)
    values = F.floor(F.lit(1 - threshold + 1e-9) * (F.pow(F.lit(2), part + 1) - 1)).cast("int") + 1
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.xxhash64(F.lit(1), "h"), "h", "s"))
    sketch = known.withColumns({"part": part, "values": F.least(values, F.col("m").cast("int")), "place": place}).where("place <= values")
    sketch = written(sketch.select("h", "item_id", (F.col("values") - spare).alias("least")), "sketch")
    few = small(sketch)
    rows = shingles(docs, lambda runs: F.xxhash64(*runs).alias("h"))
    hits = (rows if few is not sketch else _likely(rows, sketch)).join(few, "h")
    tally = hits.groupBy("doc_id", "item_id").agg(F.count_distinct("h").alias("found"), F.first("least").alias("least"))
    found = written(tally.where("found >= least").select("doc_id", "item_id"), "candidates")
    suspects = small(written(found.select(F.col("doc_id").alias("d")).distinct(), "suspects"))
    held = docs.join(suspects, docs.doc_id.eqNullSafe(suspects.d), "left_semi")
    exact = shingles(held, lambda runs: F.concat_ws(" ", *runs).alias("s"))
    shared = exact.join(small(known.select("s", "item_id", "m")), "s").groupBy("doc_id", "item_id").agg(F.count_distinct("s").alias("shared"), F.first("m").alias("item_shingles"))
    return shared.withColumn("containment", F.col("shared") / F.col("item_shingles")).where(F.col("containment") >= threshold - 1e-9)


def clean(docs: DataFrame, items: DataFrame, threshold: float = 0.8, width: int = 5) -> DataFrame:
    """The documents that hold no test item, with all their columns."""
    bad = contaminated(docs, items, threshold, width).select(F.col("doc_id").alias("_d")).distinct()
    bad = small(written(bad, "leaks"))
    return docs.join(bad, docs.doc_id.eqNullSafe(bad["_d"]), "left_anti")
