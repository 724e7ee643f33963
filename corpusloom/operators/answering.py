"""Retrieval for questions: citations, context, extractive answers and their grounding."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import fulltext, vectors

NOTHING = "No supporting passages were retrieved, so no answer can be given."


@dataclass(frozen=True)
class AnswerConfig:
    k: int = 8
    weight_fts: float = 0.5
    weight_vector: float = 0.5
    min_score: float = 0.0
    max_chars: int = 2000
    grounded_fraction: float = 0.6


def retrieve(hits: DataFrame, config: AnswerConfig = AnswerConfig(), keys: list[str] | None = None) -> DataFrame:
    """The best hits with an id and a text that reach the least score, numbered from 1, in each ``keys`` group."""
    good = hits.filter(F.col("chunk_id").isNotNull() & (F.trim(F.coalesce("text", F.lit(""))) != "") & (F.col("score") >= config.min_score))
    if not keys:
        top = good.orderBy(F.desc("score"), "chunk_id").limit(config.k)
        return top.withColumn("source_no", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")))  # k rows
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "chunk_id")
    return good.withColumn("source_no", F.row_number().over(w)).filter(F.col("source_no") <= config.k)


def passage(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit("…"))).otherwise(c)


def extractive_answer(sources: DataFrame, keys: list[str], config: AnswerConfig = AnswerConfig(), quoted: int = 3) -> DataFrame:
    """Per group the best passages, squeezed and marked, a blank line and a line that names the marks."""
    top = sources.filter(F.col("source_no") <= quoted).withColumn("_m", F.concat(F.lit("[S"), F.col("source_no").cast("string"), F.lit("]")))
    line = F.concat("_m", F.lit(" "), tx.squeeze(passage(F.col("text"), config.max_chars)))
    got = top.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("source_no", line.alias("line"), F.col("_m").alias("mark")))).alias("_l"))  # at most ``quoted`` each
    return got.select(*keys, F.concat(F.array_join("_l.line", "\n"), F.lit("\n\nThe above excerpts (from "), F.array_join("_l.mark", ", "), F.lit(") are the retrieved support for the question.")).alias("answer"))


def grounding(answer: Column, n_sources: Column, fraction: float = 0.6) -> Column:
    """A struct (grounded, note): whether the answer's marks exist and enough sentences carry one."""
    marks = F.transform(F.regexp_extract_all(answer, F.lit("\\[S(\\d+)\\]"), F.lit(1)), lambda m: m.cast("int"))
    outside = F.sort_array(F.array_distinct(F.filter(marks, lambda m: (m <= 0) | (m > n_sources))))
    sentences = F.filter(F.split(answer, f"(?<=[.!?。「」])[{tx.BLANK_CLASS}]+"), lambda s: tx.strip(s) != "")
    marked = F.size(F.filter(sentences, lambda s: s.rlike("\\[S\\d+\\]")))
    notes = F.array_compact(
        F.array(
            F.when(F.size(outside) > 0, F.concat(F.lit("markers out of range: ["), F.array_join(outside.cast("array<string>"), ", "), F.lit("]"))),
            F.when((F.size(sentences) > 0) & (marked / F.size(sentences) < fraction), F.concat(F.lit("only "), marked.cast("string"), F.lit("/"), F.size(sentences).cast("string"), F.lit(" sentences carry a citation"))),
        )
    )
    note = F.when(n_sources == 0, "no sources provided").when(F.size(marks) == 0, "answer cites no sources").when(F.size(notes) == 0, "all claims are cited").otherwise(F.array_join(notes, "; "))
    return F.struct((note == "all claims are cited").alias("grounded"), note.alias("note"))


def answer(spark, question: str, chunks: DataFrame, *, config: AnswerConfig = AnswerConfig(), embedded: DataFrame | None = None, dimensions: int = 64, generate: Callable[[str, list[tuple[int, str]]], str] | None = None) -> dict:
    """Answers one question from chunks ``(chunk_id, text)``: at most k rows reach the driver.

    With ``embedded`` (chunk_id, vector) both paths are fused, without it keywords alone decide.
    """
    pool = max(3 * config.k, 20)
    q = fulltext.parse_query(question)
    words = fulltext.search(chunks, q, text=F.col("text"), keys=["chunk_id"], limit=pool).select("chunk_id", "rank")
    if embedded is not None:
        near = vectors.nearest(embedded, vectors.hash_vector(question, dimensions), column="vector", key="chunk_id", k=pool).select("chunk_id", "score")
    else:
        near = spark.createDataFrame([], "chunk_id string, score double")
    fused = vectors.fuse(words, near, on=["chunk_id"], weight_fts=config.weight_fts, weight_vector=config.weight_vector if embedded is not None else 0.0)
    rows = retrieve(fused.join(chunks.select("chunk_id", "text"), "chunk_id"), config).orderBy("source_no").collect()
    context = [(r["source_no"], r["text"] if len(r["text"]) <= config.max_chars else r["text"][: config.max_chars] + "…") for r in rows]
    text = (generate or _quote)(question, context)
    ok = spark.range(1).select(grounding(F.lit(text), F.lit(len(rows)), config.grounded_fraction).alias("g")).first()["g"]
    return {"answer": text, "sources": [r["chunk_id"] for r in rows], "grounded": ok["grounded"], "note": ok["note"]}


def _quote(question: str, context: list[tuple[int, str]]) -> str:
    if not context:
        return NOTHING
    quoted = [f"[S{n}] {re.sub(r'\s+', ' ', t).strip()}" for n, t in context[:3]]
    names = ", ".join(f"[S{n}]" for n, _ in context[:3])
    return "\n".join([*quoted, "", f"The above excerpts (from {names}) are the retrieved support for the question."])


def parse_citation(c: Column) -> Column:
    """A struct (kind, first, second) of ``chapter:verse``, ``collection #number`` or ``book, p. page``; null for
    others."""
    verse, item, page = "^([0-9]+):([0-9]+)", "^(.+) #([0-9]+)$", "^(.+), p\\. ([0-9]+)$"

    def parts(kind: str, pattern: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.regexp_extract(c, pattern, 1).alias("first"), F.regexp_extract(c, pattern, 2).cast("int").alias("second"))

    return F.when(c.rlike(verse), parts("verse", verse)).when(c.rlike(item), parts("item", item)).when(c.rlike(page), parts("page", page))


def rehydrate(hits: DataFrame, records: DataFrame, on: str, fields: list[str]) -> DataFrame:
    """Hits with each field as the stored record has it, or as the hit says where there is no record."""
    stored = records.select(F.col(on).alias("_on"), *[F.col(f).alias(f"_{f}") for f in fields])
    out = hits.join(stored, hits[on] == F.col("_on"), "left")
    return out.select(*[F.coalesce(F.col(f"_{c}"), hits[c]).alias(c) if c in fields else hits[c] for c in hits.columns])


@dataclass(frozen=True)
class Backend:
    """Where an answer's passages come from: any function from question and limit to (chunk_id, score, text)."""

    search: Callable[[str, int], DataFrame]

    def retrieve(self, question: str, config: AnswerConfig = AnswerConfig()) -> DataFrame:
        return retrieve(self.search(question, config.k), config)
