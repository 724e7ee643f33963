"""Exact vector search, the hashing embedder, hybrid fusion and incremental embedding."""

from __future__ import annotations

import hashlib
import importlib
import math
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null for vectors of different sizes or without length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms)


def nearest(df: DataFrame, vector: list[float], *, column: str, key: str, k: int, min_score: float | None = None) -> DataFrame:
    """The k most similar rows to one vector; the least score is applied to these, after the limit."""
    q = F.array(*[F.lit(float(x)) for x in vector])
    top = df.withColumn("score", F.round(cosine(F.col(column), q), 6)).filter("score is not null").orderBy(F.desc("score"), key).limit(k)
    return top if min_score is None else top.filter(F.col("score") >= min_score)


def check_dimensions(vector: list[float], dimensions: int) -> None:
    if len(vector) != dimensions:
        raise ValueError(f"the model has {dimensions} dimensions, the vector {len(vector)}")


def hash_vector(text: str, dimensions: int) -> list[float]:
    """Casefolded character trigrams hashed to signed buckets, of unit length; the first axis if empty."""
    folded, out = text.casefold(), [0.0] * dimensions
    for i in range(len(folded) - 2):
        digest = hashlib.sha256(folded[i : i + 3].encode()).digest()
        out[int.from_bytes(digest[:8], "big") % dimensions] += 1.0 if digest[8] & 1 else -1.0
    norm = math.sqrt(sum(x * x for x in out))
    return [x / norm for x in out] if norm else [1.0, *[0.0] * (dimensions - 1)]


PROVIDERS: dict[str, Callable[[int], Callable[[list[str]], list[list[float]]]]] = {
    "hashing": lambda d: lambda texts: [hash_vector(t, d) for t in texts],
}


def provider_of(name: str) -> Callable[[int], Callable[[list[str]], list[list[float]]]]:
    """A registered provider, or the one at ``package.module:name``: from a number of dimensions to a function from
    texts to vectors (a class with ``embed``, or a plain function)."""
    if name in PROVIDERS:
        return PROVIDERS[name]
    module, colon, attribute = name.partition(":")
    if not colon:
        raise ValueError(f"unknown provider {name!r}: one of {sorted(PROVIDERS)} or package.module:name")
    try:
        made = getattr(importlib.import_module(module), attribute)
    except (ImportError, AttributeError) as e:
        raise ValueError(f"the provider {name!r} cannot be loaded: {e}") from e
    return lambda dimensions: made().embed if isinstance(made, type) else made(dimensions)


def with_retry(call: Callable[[list[str]], list[list[float]]], retries: int = 3, base: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> Callable[[list[str]], list[list[float]]]:
    """Repeats a failing call after pauses that double."""
    def run(texts: list[str]) -> list[list[float]]:
        for attempt in range(retries + 1):
            try:
                return call(texts)
            except Exception:
                if attempt == retries:
                    raise
                sleep(base * 2**attempt)
        raise AssertionError

    return run


def embed(df: DataFrame, *, text: str, provider: str = "hashing", dimensions: int = 64, batch: int = 64, column: str = "vector") -> DataFrame:
    """Adds vectors, ``batch`` texts a call; a vector of another size fails the job as a whole."""
    make = provider_of(provider)

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        call = with_retry(make(dimensions))
        for s in parts:
            out: list[list[float]] = []
            texts = s.fillna("").tolist()
            for i in range(0, len(texts), batch):
                out += call(texts[i : i + batch])
            for v in out:
                check_dimensions(v, dimensions)
            yield pd.Series(out)

    return df.withColumn(column, vectors(F.col(text)))


def embedding_plan(chunks: DataFrame, existing: DataFrame) -> DataFrame:
    """(chunk_id, content_hash, action): new, updated or reused, by what is stored for the chunk."""
    old = existing.select(F.col("chunk_id").alias("_id"), F.col("content_hash").alias("_old"))
    joined = chunks.join(old, chunks["chunk_id"] == F.col("_id"), "left")
    action = F.when(F.col("_id").isNull(), "new").when(F.col("_old").eqNullSafe(F.col("content_hash")), "reused").otherwise("updated")
    return joined.select("chunk_id", "content_hash", action.alias("action"))


def latest_version(df: DataFrame, *, model: str, version: str) -> DataFrame:
    """Per model the greatest version, compared as text."""
    return df.groupBy(model).agg(F.max(version).alias(version))


def fuse(keyword: DataFrame, vector: DataFrame, *, on: list[str], weight_fts: float = 0.5, weight_vector: float = 0.5, k: int | None = None, min_score: float | None = None, fields: tuple[str, ...] = ()) -> DataFrame:
    """``on`` with fts, vec, score, retrievers and ``fields``: keyword ranks over the greatest of their query,
    plus vector scores.

    The last name of ``on`` is the item, those before it the query, each with its own greatest rank. Without a
    weight a path is not asked at all; a hit of one path only counts 0 in the other. Each of ``fields`` is the
    keyword hit's, or else the vector hit's. ``min_score`` and then ``k`` apply to each query.
    """
    per = on[:-1]

    def best(df: DataFrame, score: str, name: str, weight: float) -> DataFrame:
        top = [F.max_by(F.col(c), F.struct(F.col(c).isNotNull(), F.col(score), F.col(c))).alias(f"_{name}_{c}") for c in fields if c in df.columns]
        return df.groupBy(*on).agg(F.max(score).alias(name), *top).filter(F.lit(weight > 0))

    f, v = best(keyword, "rank", "rank", weight_fts), best(vector, "score", "vec", weight_vector)
    if per:  # a row for each query
        f = f.join(f.groupBy(*[F.col(c).alias(f"_q_{c}") for c in per]).agg(F.max("rank").alias("most")), [F.col(c).eqNullSafe(F.col(f"_q_{c}")) for c in per]).drop(*[f"_q_{c}" for c in per])
    else:
        f = f.withColumn("most", f.agg(F.max("rank")).scalar())
    both = f.join(v, on, "full")
    fts = F.when(F.col("most") > 0, F.col("rank") / F.col("most")).when(F.col("rank").isNotNull(), F.lit(0.0))
    score = F.round(weight_fts * F.coalesce(fts, F.lit(0.0)) + weight_vector * F.coalesce("vec", F.lit(0.0)), 9)
    names = F.array_join(F.array_compact(F.array(F.when(F.col("rank").isNotNull(), "fts"), F.when(F.col("vec").isNotNull(), "vector"))), "+")
    carried = [F.coalesce(*[F.col(f"_{n}_{c}") for n in ("rank", "vec") if f"_{n}_{c}" in both.columns]).alias(c) for c in fields]
    out = both.select(*on, F.round(fts, 6).alias("fts"), F.round("vec", 6).alias("vec"), score.alias("score"), names.alias("retrievers"), *carried)
    if min_score is not None:
        out = out.filter(F.col("score") >= min_score)
    if k is None:
        return out
    if not per:
        return out.orderBy(F.desc("score"), *on).limit(k)
    w = Window.partitionBy(*per).orderBy(F.desc("score"), on[-1])
    return out.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= k).drop("_k")
