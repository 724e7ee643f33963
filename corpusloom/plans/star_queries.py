"""Queries of the stored index and of the searches that join where their hits stand."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import corpus, fulltext, postings, stars
from corpusloom.plans.registry import query
from corpusloom.plans.retrieval_queries import CHUNKS, _similar, chunks
from corpusloom.plans.text_queries import COLLAPSE, LAYOUT, TOKENS
from corpusloom.session import shared_folder, table

# The fold of a text as it is indexed, by its language.
_BASE = f"replace({COLLAPSE.format('nfc_normalize(' + LAYOUT.format('text') + ')')}, 'ـ', '')"
_ARABIC = f"translate(nfc_normalize(regexp_replace(translate(translate({_BASE}, 'أؤإآ', 'اواا'), '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789'), '[\\x{{640}}\\x{{64B}}-\\x{{65F}}\\x{{670}}]', '', 'g')), 'ٱآأإى', 'ااااي')".replace("{{", "{").replace("}}", "}")
_FOLDED = f"CASE WHEN language = 'ar' THEN {_ARABIC} WHEN language = 'ur' THEN translate({_BASE}, '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789') ELSE {_BASE} END"

_AUTHORS = """(SELECT source_file_id AS file_id, value AS author FROM (SELECT *, row_number() OVER (PARTITION BY source_file_id ORDER BY CASE WHEN status = 'approved' THEN 0 ELSE 1 END,
    CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END, -CASE source WHEN 'filename' THEN 1 WHEN 'first_pages' THEN 2 WHEN 'title_page' THEN 3 WHEN 'pdf_metadata' THEN 4 WHEN 'user_provided' THEN 5 ELSE 0 END, created_at, id) AS k
    FROM (SELECT DISTINCT * FROM metadata_candidates) WHERE status <> 'rejected' AND field = 'author') WHERE k = 1)"""
_BOOKS = f"""(SELECT b.id AS book_id, b.title, b.subtitle, b.language, b.source_file_id AS file_id, a.author, b.category_id AS category, sha256(b.source_file_id) AS sha256, CASE WHEN ascii(right(b.source_file_id, 1)) % 2 = 0 THEN 'pdf' ELSE 'txt' END AS format
    FROM (SELECT DISTINCT id, title, subtitle, language, source_file_id, category_id FROM books) b LEFT JOIN {_AUTHORS} a ON a.file_id = b.source_file_id)"""
_CHAPTERS = f"(SELECT chapter_id, c.book_id, chapter_no, 'Chapter ' || chapter_no || ' of ' || b.title AS chapter FROM (SELECT chapter_id, min(book_id) AS book_id, min(metadata.chapter_no) AS chapter_no FROM content_chunks WHERE chapter_id IS NOT NULL GROUP BY chapter_id) c JOIN (SELECT DISTINCT id, title FROM books) b ON c.book_id = b.id)"
_SECTIONS = f"(SELECT section_id, s.chapter_id, s.book_id, section_no, 'Section ' || section_no || ' in ' || c.chapter AS section FROM (SELECT section_id, min(chapter_id) AS chapter_id, min(book_id) AS book_id, min(metadata.section_no) AS section_no FROM content_chunks WHERE section_id IS NOT NULL GROUP BY section_id) s JOIN {_CHAPTERS} c ON s.chapter_id = c.chapter_id)"


def catalog(spark: SparkSession, sf: str) -> stars.Catalog:
    """The dimensions as far as the tables hold them: titles of chapters and sections come from their numbers,
    authors from the best facts, digests and formats of files from their ids."""
    b = table(spark, sf, "books").select(F.col("id").alias("book_id"), "title", "subtitle", "language", F.col("source_file_id").alias("file_id"), F.col("category_id")).distinct()
    best = corpus.merge_candidates(table(spark, sf, "metadata_candidates").filter("field = 'author'").distinct()).select(F.col("source_file_id").alias("file_id"), F.col("value").alias("author"))
    raw = table(spark, sf, "content_chunks")
    chapters = raw.filter("chapter_id is not null").groupBy("chapter_id").agg(F.min("book_id").alias("book_id"), F.min("metadata.chapter_no").alias("chapter_no"))
    chapters = chapters.join(b.select("book_id", "title"), "book_id").select("chapter_id", "book_id", "chapter_no", F.concat(F.lit("Chapter "), F.col("chapter_no").cast("string"), F.lit(" of "), F.col("title")).alias("chapter"))
    sections = raw.filter("section_id is not null").groupBy("section_id").agg(F.min("chapter_id").alias("chapter_id"), F.min("book_id").alias("book_id"), F.min("metadata.section_no").alias("section_no"))
    sections = sections.join(chapters.select("chapter_id", "chapter"), "chapter_id").select("section_id", "chapter_id", "book_id", "section_no", F.concat(F.lit("Section "), F.col("section_no").cast("string"), F.lit(" in "), F.col("chapter")).alias("section"))
    files = b.select("file_id").distinct().select("file_id", F.sha2("file_id", 256).alias("sha256"), F.when(F.ascii(F.right("file_id", F.lit(1))) % 2 == 0, "pdf").otherwise("txt").alias("format"))
    books = b.withColumn("author_id", F.col("file_id"))
    return stars.Catalog(books, files, best.withColumnRenamed("file_id", "author_id"), b.select("category_id", F.col("category_id").alias("category")).filter("category_id is not null").distinct(), chapters, sections)


def _index(spark: SparkSession, sf: str) -> DataFrame:
    """The postings of all chunks with the titles of their books, written to the shared folder and read back."""
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    titles = table(spark, sf, "books").select(F.col("id").alias("book_id"), F.col("title")).distinct()
    rows = chunks(spark, sf).select("chunk_id", "book_id", "text", "language").join(titles, "book_id", "left")
    postings.write_index(postings.postings(rows, key="chunk_id", text=F.col("text"), language=F.col("language"), title=F.col("title")), path)
    return postings.read_index(spark, path)


_TITLED = f"(SELECT c.* EXCLUDE (text), c.text AS body, coalesce(b.title, '') || ' ' || c.text AS text FROM {CHUNKS} c LEFT JOIN (SELECT DISTINCT id, title FROM books) b ON c.book_id = b.id)"


@query(f"SELECT term, count(DISTINCT chunk_id) AS documents, count(*) AS places FROM (SELECT chunk_id, unnest({TOKENS.format('(' + _FOLDED + ')')}) AS term FROM {_TITLED}) GROUP BY term")
def index_documents(spark, sf):
    return postings.index_counts(_index(spark, sf))


_PLACE = f"JOIN {_BOOKS} b ON h.book_id = b.book_id LEFT JOIN {_CHAPTERS} ch ON h.chapter_id = ch.chapter_id LEFT JOIN {_SECTIONS} se ON h.section_id = se.section_id"
_PAGE = "coalesce(nullif(h.page_start, 0), h.page_end)"


@query(f"""WITH t AS (SELECT *, {TOKENS.format('(' + _FOLDED + ')')} AS tokens FROM {_TITLED} WHERE language = 'en'), h AS (SELECT *, round(len(list_filter(tokens, lambda t: t IN ('merchant', 'salt'))) * 0.1, 6) AS rank FROM t)
    SELECT 'content' AS domain, rank, h.chunk_id, h.body AS text, b.title AS book, b.author, b.category, ch.chapter, se.section, {_PAGE} AS page, h.language, h.book_id, h.chapter_id, h.section_id, b.file_id, b.sha256, b.format, h.chunk_id AS citation
    FROM h {_PLACE} WHERE rank > 0 AND b.format = 'pdf' ORDER BY rank DESC, h.chunk_id LIMIT 50""")
def content_star(spark, sf):
    return stars.content_search(_index(spark, sf), chunks(spark, sf), catalog(spark, sf), "Merchant salt", scope=stars.Scope(language="en", source_format="pdf"), limit=50)


def _sql_trigram(name: str, asked: str) -> str:
    return f"round({_similar(name, repr(asked))}, 6)"


@query(f"""SELECT 'book' AS domain, round(greatest({_similar('title', repr('the care'))}, {_similar('subtitle', repr('the care'))}, {_similar('author', repr('the care'))}), 6) AS rank, book_id, title, author, category, lower(coalesce(language, '')) AS language, file_id, sha256
    FROM {_BOOKS} WHERE (contains(lower(title), 'the care') OR contains(lower(coalesce(subtitle, '')), 'the care') OR contains(lower(coalesce(author, '')), 'the care')) AND lower(coalesce(language, '')) IN ('en', 'eng', 'english') ORDER BY rank DESC, book_id LIMIT 20""")
def book_star(spark, sf):
    return stars.book_search(catalog(spark, sf), "the care", scope=stars.Scope(language="en"))


@query(f"""SELECT 'chapter' AS domain, {_sql_trigram('c.chapter', 'chapter 2')} AS rank, c.chapter_id, c.chapter, b.book_id, b.title AS book, b.author, b.category, lower(coalesce(b.language, '')) AS language, b.file_id
    FROM {_CHAPTERS} c JOIN {_BOOKS} b ON c.book_id = b.book_id WHERE contains(lower(c.chapter), 'chapter 2') ORDER BY rank DESC, chapter_id LIMIT 40""")
def chapter_search(spark, sf):
    return stars.chapter_search(catalog(spark, sf), "chapter 2", limit=40)


@query(f"""SELECT 'section' AS domain, {_sql_trigram('s.section', 'section 1')} AS rank, s.section_id, s.section, c.chapter_id, c.chapter, b.book_id, b.title AS book, b.author, b.category, lower(coalesce(b.language, '')) AS language, b.file_id
    FROM {_SECTIONS} s JOIN {_CHAPTERS} c ON s.chapter_id = c.chapter_id JOIN {_BOOKS} b ON c.book_id = b.book_id WHERE contains(lower(s.section), 'section 1') AND lower(coalesce(b.language, '')) IN ('en', 'eng', 'english') ORDER BY rank DESC, section_id LIMIT 40""")
def section_search(spark, sf):
    return stars.section_search(catalog(spark, sf), "section 1", scope=stars.Scope(language="en"), limit=40)


_VECTORS = "(SELECT model_name, model_version, chunk_id, vector FROM (SELECT *, row_number() OVER (PARTITION BY model_name, chunk_id ORDER BY updated_at DESC, vector DESC) AS k FROM chunk_vectors) WHERE k = 1 AND vector IS NOT NULL)"


def _embedded(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "chunk_vectors").groupBy("model_name", "chunk_id").agg(F.max(F.struct("updated_at", "vector", "model_version")).alias("r"))
    return v.select("model_name", "chunk_id", "r.vector", "r.model_version").filter("vector is not null")


_ASKED = "[" + ", ".join(f"{((i * 37) % 19 - 9) / 10}" for i in range(64)) + "]"
_ASKED_VECTOR = [((i * 37) % 19 - 9) / 10 for i in range(64)]
_FINITE = "len(list_filter(v.vector, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(v.vector, lambda x: x <> 0)) > 0"


@query(f"""SELECT round(list_cosine_similarity(CAST(v.vector AS DOUBLE[]), CAST({_ASKED} AS DOUBLE[])), 6) AS score, h.chunk_id, h.text, b.title AS book, b.author, b.category, ch.chapter, se.section, {_PAGE} AS page, h.language, h.book_id, h.chapter_id, h.section_id, b.file_id, b.sha256, b.format
    FROM {_VECTORS} v JOIN {CHUNKS} h ON v.chunk_id = h.chunk_id {_PLACE} WHERE v.model_name = 'hash-grams' AND v.model_version = (SELECT max(model_version) FROM {_VECTORS} WHERE model_name = 'hash-grams') AND len(v.vector) = 64 AND {_FINITE} AND h.language = 'en' ORDER BY score DESC, h.chunk_id LIMIT 20""")
def vector_star(spark, sf):
    rows = _embedded(spark, sf).filter(F.forall("vector", lambda x: ~F.isnan(x)))
    return stars.vector_search(rows, chunks(spark, sf), catalog(spark, sf), _ASKED_VECTOR, model="hash-grams", scope=stars.Scope(language="en"))


@query(f"""SELECT h.chunk_id, h.book_id, b.title AS book, h.chapter_id, ch.chapter, h.section_id, se.section, h.page_start, h.page_end, {_PAGE} AS page, b.file_id, b.sha256,
    concat_ws(', ', coalesce(nullif(b.title, ''), h.book_id), 'ch. ' || ch.chapter, se.section, 'p. ' || {_PAGE}, h.chunk_id) AS reference FROM {CHUNKS} h LEFT JOIN {_BOOKS} b ON h.book_id = b.book_id LEFT JOIN {_CHAPTERS} ch ON h.chapter_id = ch.chapter_id LEFT JOIN {_SECTIONS} se ON h.section_id = se.section_id""")
def chunk_citations(spark, sf):
    return stars.citations(chunks(spark, sf), catalog(spark, sf))


@query(f"""WITH t AS (SELECT chunk_id, {TOKENS.format('(' + _FOLDED + ')')} AS tokens FROM {_TITLED}), h AS (SELECT chunk_id, round(len(list_filter(tokens, lambda t: t IN ('scribe', 'ledger'))) * 0.1, 6) AS rank FROM t), f AS (SELECT * FROM h WHERE rank > 0 ORDER BY rank DESC, chunk_id LIMIT 30),
    v AS (SELECT v.chunk_id, round(list_cosine_similarity(CAST(v.vector AS DOUBLE[]), CAST({_ASKED} AS DOUBLE[])), 6) AS score FROM {_VECTORS} v JOIN (SELECT chunk_id FROM {CHUNKS}) c ON v.chunk_id = c.chunk_id WHERE v.model_name = 'hash-grams' AND v.model_version = (SELECT max(model_version) FROM {_VECTORS} WHERE model_name = 'hash-grams') AND len(v.vector) = 64 AND {_FINITE} ORDER BY score DESC, v.chunk_id LIMIT 30),
    m AS (SELECT coalesce(f.chunk_id, v.chunk_id) AS chunk_id, f.rank / (SELECT max(rank) FROM f) AS fts, v.score AS vec FROM f FULL JOIN v ON f.chunk_id = v.chunk_id)
    SELECT m.chunk_id, round(fts, 6) AS fts, round(vec, 6) AS vec, round(0.5 * coalesce(fts, 0) + 0.5 * coalesce(vec, 0), 9) AS score, concat_ws('+', CASE WHEN fts IS NOT NULL THEN 'fts' END, CASE WHEN vec IS NOT NULL THEN 'vector' END) AS retrievers, b.title AS book, b.category, h.language, {_PAGE} AS page
    FROM m JOIN {CHUNKS} h ON m.chunk_id = h.chunk_id JOIN {_BOOKS} b ON h.book_id = b.book_id ORDER BY score DESC, m.chunk_id LIMIT 10""")
def hybrid_star(spark, sf):
    rows = _embedded(spark, sf).filter(F.forall("vector", lambda x: ~F.isnan(x)))
    hits = stars.hybrid_search(_index(spark, sf), rows, chunks(spark, sf), catalog(spark, sf), "scribe ledger", _ASKED_VECTOR, model="hash-grams", limit=10)
    return hits.select("chunk_id", "fts", "vec", "score", "retrievers", "book", "category", "language", "page")
