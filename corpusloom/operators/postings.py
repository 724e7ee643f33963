"""A stored index of words: which documents hold a word, and where; searches read only their words."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import fulltext

#: Folders of the index; within one, files and row groups are ranges of words, which their statistics rule out.
BUCKETS = 16


def bucket_of(term: Column) -> Column:
    return F.pmod(F.crc32(term), F.lit(BUCKETS)).cast("int")


def _bucket(term: str) -> int:
    return zlib.crc32(term.encode()) % BUCKETS


def postings(docs: DataFrame, *, key: str, text: Column, language: Column, title: Column | None = None) -> DataFrame:
    """``(bucket, term, key, pos)``: a row for each word of each document, its title before its text, folded by its
    language.

    Null and empty texts have none; documents that repeat a key add up. No shuffle.
    """
    text = text if title is None else F.concat(F.coalesce(title, F.lit("")), F.lit(" "), text)
    words = docs.select(F.col(key).alias("key"), F.posexplode(tx.tokens(fulltext.content_fold(text, language))).alias("pos", "term"))
    return words.select(bucket_of(F.col("term")).alias("bucket"), "term", "key", (F.col("pos") + 1).alias("pos"))


def write_index(index: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Stores postings by bucket, sorted by term, key and place; a bucket that is written again replaces the old.

    One shuffle, into ranges of bucket, term and key, so that a word of all documents is spread over several.
    """
    order = ["bucket", "term", "key"]
    index.repartitionByRange(*order).sortWithinPartitions(*order, "pos").write.mode(mode).partitionBy("bucket").parquet(path)


def read_index(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def found(index: DataFrame, q: fulltext.Query) -> DataFrame:
    """``(key, events)`` of the documents that match: the words of the query there, in order of place.

    Only the buckets and terms of the query are read; what is gathered for a document are its own matches.
    """
    if q.empty:
        return index.select("key", F.array().cast("array<struct<pos:int,term:string>>").alias("events")).limit(0)
    words = q.words
    rows = index.filter(F.col("bucket").isin(sorted({_bucket(w) for w in words})) & F.col("term").isin(words))
    out = rows.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("pos", "term"))).alias("events")).filter(fulltext.matches_at(q))
    if q.excluded:
        bad = index.filter(F.col("bucket").isin(sorted({_bucket(w) for w in q.excluded})) & F.col("term").isin(*q.excluded)).select("key").distinct()
        out = out.join(bad, "key", "left_anti")
    return out


def search(index: DataFrame, q: fulltext.Query, *, limit: int = 20) -> DataFrame:
    """``(key, rank)``: the best matches by cover density, then by key."""
    return found(index, q).select("key", F.round(fulltext.cover_rank_at(q), 6).alias("rank")).orderBy(F.desc("rank"), "key").limit(limit)


def index_counts(index: DataFrame) -> DataFrame:
    """``(term, documents, places)`` of each word."""
    per = index.groupBy("term", "key").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("term").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("places"))
