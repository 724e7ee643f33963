"""The registered queries over the training-data operators, each over its whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm import contamination, fused_ranking, languages, lookalikes, name_variants, neighbours, prose, quality, splitting, tokenizing
from corpusloom.session import shipped, table

TOKENIZERS = os.environ.get("CORPUSLOOM_TOKENIZERS", "/opt/tokenizers")
EQUAL_SAY = {"fts_score": 1.0, "vector_score": 1.0, "score": 1.0}


def _p1_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split_oversized(splitting.latest_oversized(table(spark, sf, "content_chunks")))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _p1_pieces(spark, sf).filter((F.col("piece") == 1) & (F.col("n_pieces") > 1)).select("chunk_id").distinct()


def p1_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return _p1_pieces(spark, sf)


def p1_joined(spark: SparkSession, sf: str) -> DataFrame:
    """Each oversized text put together again from its pieces, as a digest, and what any of these does wrong."""
    p = _p1_pieces(spark, sf)
    w = Window.partitionBy("chunk_id").orderBy("piece")
    rows = p.withColumn("_over", F.lag("end", 1).over(w) - F.col("start")).withColumn("_own", F.substr("text", F.coalesce("_over", F.lit(0)) + 1))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece", "_own"))), lambda x: x["_own"]), "")
    wrong = F.count_if((F.col("tokens") > 512) | (F.col("_over") <= 0) | (F.col("_over") > 64 * 4) | (F.length("text") != F.col("end") - F.col("start")))
    return rows.groupBy("chunk_id").agg(F.md5(text).alias("digest"), F.max("end").cast("long").alias("chars"), wrong.alias("wrong"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    ranked = fused_ranking.borda(table(spark, sf, "hybrid_hits"), EQUAL_SAY)
    return ranked.filter("position <= 5").select("query_id", "chunk_id")


def p2_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return fused_ranking.borda(table(spark, sf, "hybrid_hits"), EQUAL_SAY)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    found = neighbours.neighbours(neighbours.valid_vectors(table(spark, sf, "chunk_vectors")), min_cosine=0.9)
    a, b = F.col("_key"), F.col("_other")
    return found.select(F.least(a, b).alias("chunk_id_a"), F.greatest(a, b).alias("chunk_id_b")).distinct()


def p3_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The five most similar vectors, whatever their similarity, of every row whose id is divisible by 20."""
    rows = table(spark, sf, "chunk_vectors")
    asked = rows.filter(F.regexp_extract("id", "([0-9]+)$", 1).cast("long") % 20 == 0).select(F.col("model_name").alias("_model"), F.col("chunk_id").alias("_key"))
    found = neighbours.neighbours(neighbours.valid_vectors(rows), queries=asked)
    return found.select(F.col("_model").alias("model_name"), F.col("_key").alias("chunk_id"), F.col("_other").alias("neighbour_id"), F.round("_cos", 5).alias("cosine"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = lookalikes.look_alike_pairs(table(spark, sf, "normalized_texts"))
    return pairs.select(F.col("key_a").alias("block_id_a"), F.col("key_b").alias("block_id_b"))


def p4_looks(spark: SparkSession, sf: str) -> DataFrame:
    """The look and the spelling of every block, as digests."""
    return lookalikes.look_classes(table(spark, sf, "normalized_texts"))


def p4_normalized(spark: SparkSession, sf: str) -> DataFrame:
    return lookalikes.normalized(table(spark, sf, "normalized_texts"))


def _p5_names(spark: SparkSession, sf: str) -> DataFrame:
    people = table(spark, sf, "metadata_candidates").filter(F.col("field").isin("author", "translator", "editor", "publisher")).select(F.col("value").alias("name"))
    return people.unionByName(table(spark, sf, "search_hits").select(F.col("author").alias("name")))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return name_variants.variant_pairs(_p5_names(spark, sf))


def p5_entities(spark: SparkSession, sf: str) -> DataFrame:
    return name_variants.variant_classes(_p5_names(spark, sf)).select("name", F.md5("star").alias("entity"))


def _p6_rows(spark: SparkSession, sf: str) -> DataFrame:
    texts = table(spark, sf, "normalized_texts").select(F.col("id").alias("row_id"), F.col("original_text").alias("text"), F.col("language").alias("label"))
    hits = table(spark, sf, "search_hits").select(F.col("hit_id").alias("row_id"), F.col("matched_text").alias("text"), F.col("language").alias("label"))
    return texts.unionByName(hits)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = _p6_rows(spark, sf)
    return languages.unnamed_languages(rows, languages.train_from(rows, text="text", label="label"))


def p6_segments(spark: SparkSession, sf: str) -> DataFrame:
    rows = _p6_rows(spark, sf)
    return languages.segments(rows, languages.train_from(rows, text="text", label="label"))


def p6_documents(spark: SparkSession, sf: str) -> DataFrame:
    rows = _p6_rows(spark, sf)  # copies of a row change no share
    return languages.document_languages(languages.segments(rows, languages.train_from(rows, text="text", label="label")))


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokenizing.encode(table(spark, sf, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return p8_leaks(spark, sf).select("doc_id", "item_id").distinct()


def p8_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return contamination.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p8_items(spark: SparkSession, sf: str) -> DataFrame:
    """Which test items leaked, into how many documents."""
    return p8_found(spark, sf).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return p9_kinds(spark, sf).filter("other >= 0.5").select("doc_id")


def p9_kinds(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return prose.classify(docs, prose.train_from(docs))


def p9_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return quality.statistics(table(spark, sf, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from corpusloom.llm import properties

    every = globals() | vars(properties)
    return {name: shipped(f) for name, f in every.items() if name[0] == "p" and name[1].isdigit()}


def oracle_sql() -> dict[str, str]:
    """SQL where SQL can say it; the others are tested against brute force, round trips or held-out rows."""
    from corpusloom.llm import properties

    points = " + ".join(
        f"CASE WHEN n > 1 THEN (n - CASE WHEN {s} IS NULL THEN (n + 1) / 2.0 ELSE rank() OVER (PARTITION BY query_id ORDER BY {s} DESC NULLS LAST)"
        f" + (count(*) OVER (PARTITION BY query_id, {s}) - 1) / 2.0 END) / (n - 1) ELSE 0.5 END"
        for s in EQUAL_SAY
    )
    ranking = f"""
        WITH h AS (SELECT query_id, chunk_id, max(fts_score) fts_score, max(vector_score) vector_score, max(score) score FROM hybrid_hits GROUP BY ALL),
        c AS (SELECT *, count(*) OVER (PARTITION BY query_id) n FROM h),
        p AS (SELECT query_id, chunk_id, round({points}, 9) points FROM c)
        SELECT query_id, chunk_id, points, row_number() OVER (PARTITION BY query_id ORDER BY points DESC, chunk_id) AS position FROM p"""
    return properties.oracle_sql() | {
        "p1_found": """
            SELECT chunk_id FROM (SELECT chunk_id, language, text, row_number() OVER (PARTITION BY chunk_id ORDER BY updated_at DESC, text DESC) k FROM content_chunks)
            WHERE k = 1 AND ceil(length(text) / CASE WHEN language IN ('ar', 'ur') THEN 3.0 ELSE 4.0 END) > 512""",
        "p1_joined": """
            SELECT chunk_id, md5(text) AS digest, length(text) AS chars, 0 AS wrong FROM (SELECT chunk_id, language, text, row_number() OVER (PARTITION BY chunk_id ORDER BY updated_at DESC, text DESC) k FROM content_chunks)
            WHERE k = 1 AND ceil(length(text) / CASE WHEN language IN ('ar', 'ur') THEN 3.0 ELSE 4.0 END) > 512""",
        "p2_ranking": ranking,
        "p3_found": """
            WITH v AS (SELECT model_name, chunk_id, vector, row_number() OVER (PARTITION BY model_name, chunk_id ORDER BY updated_at DESC, vector DESC) k FROM chunk_vectors),
            d AS (SELECT model_name, arg_max(dimensions, n) AS size FROM (SELECT model_name, dimensions, count(*) n FROM chunk_vectors WHERE dimensions IS NOT NULL GROUP BY ALL) GROUP BY model_name),
            ok AS (SELECT model_name, chunk_id, CAST(vector AS DOUBLE[]) AS vec FROM v JOIN d USING (model_name) WHERE k = 1 AND len(vector) = size
                AND len(list_filter(vector, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
            s AS (SELECT a.model_name, a.chunk_id AS a, b.chunk_id AS b, list_cosine_similarity(a.vec, b.vec) AS cos FROM ok a JOIN ok b ON a.model_name = b.model_name AND a.chunk_id <> b.chunk_id),
            r AS (SELECT a, b, cos, row_number() OVER (PARTITION BY model_name, a ORDER BY cos DESC, b) AS rank FROM s)
            SELECT DISTINCT least(a, b) AS chunk_id_a, greatest(a, b) AS chunk_id_b FROM r WHERE rank <= 5 AND cos >= 0.9""",
        "p2_found": f"SELECT query_id, chunk_id FROM ({ranking}) WHERE position <= 5",
    }
