"""A corpus from raw documents to token shards: quality, near-duplicates, benchmark leaks, mixing, token ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import digest_of, small, written
from shelfmark.llm.decontam import contaminated
from shelfmark.llm.mixing import mix
from shelfmark.llm.quality import classify
from shelfmark.llm.simhash import duplicate_rows
from shelfmark.llm.tokenbin import token_table

#: The tokenizer's file; every executor has it.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _digest(docs: DataFrame) -> Column:
    return digest_of(docs.text)


def without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """docs less the rows that have a doc_id and digest of bad, with all their columns."""
    bad = small(written(bad.select("doc_id", "digest"), "bad").distinct())
    return docs.join(bad, docs.doc_id.eqNullSafe(bad.doc_id) & (_digest(docs) == bad.digest), "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    As in all stages: null texts count as empty, null ids, languages and sources are values of their own, rows with one
    id are told apart by their texts and repeated rows share their fate, texts may be of any length, and an empty table
    gives an empty one. Further columns are kept, whatever their names.
    """
    seen = docs.select("doc_id", "text", "source", "lang", _digest(docs).alias("digest"))
    return without(docs, classify(seen, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=("digest",)).where("not keep"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the smallest doc_id, a null one if all are.

    Of rows with equal id and text one stays, too, null ids among them. Texts without words are near nothing but equals.
    """
    kept = without(docs, duplicate_rows(docs.select("doc_id", "text"), nulls=True))
    twice = written(kept.groupBy("doc_id").count().where("count > 1").select("doc_id"), "twice")
    if twice.isEmpty():
        return kept
    twice = small(twice)
    repeated = kept.doc_id.eqNullSafe(twice.doc_id)
    return kept.join(twice, repeated, "left_anti").unionByName(kept.join(twice, repeated, "left_semi").dropDuplicates(["doc_id", "text"]))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; each is judged by its own text, whatever else has its id."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = contaminated(docs.select(_digest(docs).alias("doc_id"), "text"), items, threshold=0.8, width=5)
    leaks = small(written(leaks.select("doc_id"), "leaks").distinct())
    return docs.join(leaks, _digest(docs) == leaks.doc_id, "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come to their target weights: a document comes as often as the mix takes its middle word, up to 3 times.

    Texts without words aren't taken.
    """
    counts = mix(docs.select("doc_id", "text", "source", _digest(docs).alias("digest")), cycle=(1, 2, 3), most=3, carry=("digest",))
    times = counts.groupBy("doc_id", "digest").agg(F.round(F.avg("copies")).cast("int").alias("copies")).where("copies > 0")
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", _digest(docs).alias("digest"))  # apart from columns of any name
    joined = rows.join(times, rows.doc_id.eqNullSafe(times.doc_id) & (rows.digest == times.digest))
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids go to wavelet matrix shards; a row for each document, read back from them."""
    return token_table(docs, TOKENIZER, end_id=0, added=True)


STAGES = [("quality classifier", quality), ("simhash near-dedup", near_dedup), ("benchmark decontamination", decontaminate), ("mixing to target weights", mixing), ("token ids", tokens)]

#: A fitted model, verified links and a tokenizer can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each on what the one before it kept, written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.split()[0])
    return docs
