"""What the results of the training-data operators must have, over the whole tables, in a form that SQL can say too."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import languages, quality, queries, tokenizing
from corpusloom.session import table

# Invisible characters, and the inside of a class of blanks.
_UNSEEN = r"[\x{AD}\x{200B}-\x{200F}\x{2060}\x{FEFF}]"
_BLANKS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def p4_blanks(spark: SparkSession, sf: str) -> DataFrame:
    """The pairs whose texts differ in blanks and invisible characters only."""
    rows = table(spark, sf, "normalized_texts").select(F.col("content_block_id").alias("id"), F.md5(F.trim(F.regexp_replace(F.regexp_replace("original_text", _UNSEEN, ""), _BLANKS, " "))).alias("plain")).distinct()
    pairs = queries.p4_found(spark, sf)
    a, b = rows.select(F.col("id").alias("block_id_a"), "plain"), rows.select(F.col("id").alias("block_id_b"), "plain")
    return pairs.join(a, "block_id_a").join(b, ["block_id_b", "plain"]).select("block_id_a", "block_id_b").distinct()


def p5_letters(spark: SparkSession, sf: str) -> DataFrame:
    """The pairs of names of the same words, whatever their case and marks."""
    def words(c: str):
        return F.array_join(F.regexp_extract_all(F.lower(c), F.lit("[\\p{L}\\p{N}]+"), F.lit(0)), " ")

    return queries.p5_found(spark, sf).filter(words("name_a") == words("name_b"))


def p6_labels(spark: SparkSession, sf: str) -> DataFrame:
    """What every label names."""
    return queries._p6_rows(spark, sf).groupBy("label", languages.canonical(F.col("label")).alias("language")).agg(F.count(F.lit(1)).alias("n"))


def p7_decoded(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of the texts as decoded from their ids, and whether every id begins where the one before it ends."""
    at = f"{queries.TOKENIZERS}/byte_bpe_50k.tiktoken"
    sent = spark.sparkContext.broadcast(tokenizing._bytes(at))

    @F.pandas_udf(T.StructType([T.StructField("digest", T.StringType()), T.StructField("joined", T.BooleanType())]))
    def back(ids: pd.Series, begins: pd.Series) -> pd.DataFrame:
        import hashlib

        tokenizing.merger(at, sent.value)
        pieces = tokenizing._pieces(at)
        out = []
        for i, b in zip(ids, begins):
            parts = [pieces[int(k)] for k in i]
            ends, place = [], 0
            for part in parts:
                ends.append(place)
                place += len(part)
            out.append((hashlib.md5(b"".join(parts)).hexdigest(), ends == [int(x) for x in b]))
        return pd.DataFrame(out, columns=["digest", "joined"])

    made = tokenizing.encode(table(spark, sf, "documents"), at, offsets=True)
    return made.withColumn("r", back("ids", "begins")).select("doc_id", "r.digest", "r.joined")


def p8_verbatim(spark: SparkSession, sf: str) -> DataFrame:
    """The leaks in which the item stands letter for letter."""
    texts, items = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "eval_items").select("item_id", F.col("text").alias("item"))
    return queries.p8_found(spark, sf).join(texts, "doc_id").join(items, "item_id").filter(F.contains("text", "item")).select("doc_id", "item_id")


def p9_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """The statistics that SQL counts alike."""
    def count(share: str):
        return F.round(F.col(share) * F.col("chars")).cast("long")

    return quality.statistics(table(spark, sf, "documents")).select("doc_id", F.col("chars").cast("long").alias("chars"), count("digit_ratio").alias("digits"), count("letter_ratio").alias("letters"))


def oracle_sql() -> dict[str, str]:
    labels = " ".join(f"WHEN p IN ({names}) OR b IN ({names}) THEN '{code}'" for code, names in (
        ("id", "'id', 'in', 'ind', 'indonesian', 'indonésien', 'indonesien', 'bahasa', 'bahasa indonesia', 'indonesia', 'الإندونيسية', 'انڈونیشی'"),
        ("fr", "'fr', 'fra', 'fre', 'french', 'français', 'francais', 'prancis', 'bahasa prancis', 'الفرنسية', 'فرانسیسی'"),
        ("ur", "'ur', 'urd', 'urdu', 'ourdou', 'اردو', 'أردو', 'الأردية'"),
        ("ar", "'ar', 'ara', 'arb', 'arabic', 'arabe', 'arab', 'bahasa arab', 'العربية', 'عربي', 'عربی'"),
        ("en", "'en', 'eng', 'english', 'anglais', 'inggris', 'bahasa inggris', 'الإنجليزية', 'انگریزی'"),
    ))
    plain = f"trim(regexp_replace(regexp_replace(original_text, '{_UNSEEN}', '', 'g'), '{_BLANKS}', ' ', 'g'))"
    return {
        "p4_blanks": f"""WITH r AS (SELECT DISTINCT content_block_id AS id, original_text AS t, {plain} AS plain FROM normalized_texts WHERE original_text IS NOT NULL)
            SELECT DISTINCT a.id AS block_id_a, b.id AS block_id_b FROM r a JOIN r b ON a.plain = b.plain AND a.id < b.id AND a.t <> b.t""",
        "p5_letters": r"""WITH n AS (SELECT DISTINCT name FROM (SELECT value AS name FROM metadata_candidates WHERE field IN ('author', 'translator', 'editor', 'publisher') UNION ALL SELECT author FROM search_hits) WHERE name IS NOT NULL),
            w AS (SELECT name, array_to_string(regexp_extract_all(lower(name), '[\p{L}\p{N}]+'), ' ') AS k FROM n)
            SELECT a.name AS name_a, b.name AS name_b FROM w a JOIN w b ON a.k = b.k AND a.name < b.name WHERE a.k NOT IN ('', 'n a', 'na', 'none', 'null', 'unknown', 'unknown author', 'anonymous', 'anon', 'various', 'various authors', 'tba', 's n')""",
        "p6_labels": f"""WITH r AS (SELECT language AS label FROM normalized_texts UNION ALL SELECT language FROM search_hits), f AS (SELECT label, lower(trim(label)) AS p, regexp_replace(lower(trim(label)), '[-_]([a-z]{{2,4}}|[0-9]{{3}})$', '') AS b FROM r)
            SELECT label, CASE {labels} END AS language, count(*) AS n FROM f GROUP BY ALL""",
        "p7_decoded": "SELECT doc_id, md5(coalesce(text, '')) AS digest, true AS joined FROM documents",
        "p8_verbatim": "SELECT doc_id, item_id FROM documents d JOIN eval_items e ON contains(d.text, e.text)",
        "p9_sizes": r"""SELECT doc_id, coalesce(length(text), 0) AS chars, coalesce(length(text) - length(regexp_replace(text, '\p{N}', '', 'g')), 0) AS digits, coalesce(length(text) - length(regexp_replace(text, '[\p{L}\p{M}]', '', 'g')), 0) AS letters FROM documents""",
    }
