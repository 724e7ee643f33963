"""Searches that say where their hits stand: documents, chunks or headings joined with book, file, author, category,
chapter and section, scoped before they are ranked."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import fulltext, library, postings, vectors


@dataclass
class Catalog:
    """The dimensions of a library, each with unique ids.

    ``books`` (book_id, title, subtitle, language, file_id, author_id, category_id), ``files`` (file_id, sha256,
    format), ``authors`` (author_id, author), ``categories`` (category_id, category), ``chapters`` (chapter_id,
    book_id, chapter_no, chapter) and ``sections`` (section_id, chapter_id, book_id, section_no, section).
    """

    books: DataFrame
    files: DataFrame
    authors: DataFrame
    categories: DataFrame
    chapters: DataFrame
    sections: DataFrame


@dataclass(frozen=True)
class Scope:
    """What a search is narrowed to; an unknown language or format narrows nothing."""

    language: str | None = None
    category: str | None = None
    author: str | None = None
    sha: str | None = None
    source_format: str | None = None


def books_in(c: Catalog, scope: Scope = Scope(), *, by_language: bool = True) -> DataFrame:
    """Books with file, author and category, of the scope: every book has a file, the others may be missing."""
    out = c.books.join(c.files, "file_id").join(c.authors, "author_id", "left").join(c.categories, "category_id", "left")
    return library.scope(out, language=scope.language if by_language else None, alias=True, category=scope.category, author=scope.author, sha=scope.sha, source_format=scope.source_format)


_BOOK = ["book_id", "title as book", "author", "category", "file_id", "sha256", "format"]


def _placed(hits: DataFrame, c: Catalog, scope: Scope) -> DataFrame:
    """Hits ``(book_id, chapter_id, section_id, page_start, page_end, ...)`` with all that the catalog knows of
    their place. The page is the first one, or the last where that is missing or 0."""
    books = books_in(c, scope, by_language=False).selectExpr(*_BOOK)
    out = hits.join(books, "book_id").join(c.chapters.select("chapter_id", "chapter"), "chapter_id", "left").join(c.sections.select("section_id", "section"), "section_id", "left")
    return out.withColumn("page", F.coalesce(F.nullif(F.col("page_start"), F.lit(0)), F.col("page_end")))


def scoped_chunks(chunks: DataFrame, c: Catalog, scope: Scope) -> DataFrame:
    """Chunks of the books in scope and of its language; without a scope, all."""
    if scope.language in library.LANGUAGES:
        chunks = chunks.filter(F.col("language") == scope.language)
    if scope.category or scope.author or scope.sha or scope.source_format:
        chunks = chunks.join(books_in(c, scope, by_language=False).select("book_id"), "book_id", "left_semi")
    return chunks


def content_search(index: DataFrame, chunks: DataFrame, c: Catalog, query: str, *, every: bool = False, scope: Scope = Scope(), limit: int = 20) -> DataFrame:
    """The best chunks by cover density, with their place: domain, rank, text and provenance.

    ``index`` holds the postings of ``chunks`` by chunk_id. Only the postings of the query's words are read; the
    scope and the limit come before any text or dimension is joined.
    """
    q = fulltext.normalized_query(query, every)
    ranked = postings.found(index, q).select(F.col("key").alias("chunk_id"), F.round(fulltext.cover_rank_at(q), 6).alias("rank"))
    names = ["chunk_id", "book_id", "chapter_id", "section_id", "page_start", "page_end", "language"]
    best = ranked.join(scoped_chunks(chunks, c, scope).select(*names), "chunk_id").join(books_in(c).select("book_id"), "book_id", "left_semi").orderBy(F.desc("rank"), "chunk_id").limit(limit)
    out = _placed(best, c, Scope()).join(chunks.select("chunk_id", "text"), "chunk_id").orderBy(F.desc("rank"), "chunk_id")
    return out.select(F.lit("content").alias("domain"), "rank", "chunk_id", "text", "book", "author", "category", "chapter", "section", "page", "language", "book_id", "chapter_id", "section_id", "file_id", "sha256", "format", F.col("chunk_id").alias("citation"))


def _title_hits(rows: DataFrame, domain: str, title: str, query: str, rank: Column | None = None) -> DataFrame:
    rank = tx.similarity(F.lower(F.col(title)), F.lit(query)) if rank is None else rank
    return rows.withColumn("rank", F.round(rank, 6)).withColumn("domain", F.lit(domain))


def book_search(c: Catalog, query: str, *, scope: Scope = Scope(), limit: int = 20) -> DataFrame:
    """Books whose title, subtitle or author holds the query, by the greatest of the three similarities."""
    asked = query.lower()
    names = [F.lower(F.coalesce(F.col(n), F.lit(""))) for n in ("title", "subtitle", "author")]
    hit = names[0].contains(asked) | names[1].contains(asked) | names[2].contains(asked)
    rank = F.greatest(*[tx.similarity(n, F.lit(query)) for n in names])
    out = _title_hits(books_in(c, scope).filter(hit), "book", "title", query, rank)
    return out.orderBy(F.desc("rank"), "book_id").limit(limit).select("domain", "rank", "book_id", "title", "author", "category", F.lower(F.coalesce("language", F.lit(""))).alias("language"), "file_id", "sha256")


def chapter_search(c: Catalog, query: str, *, scope: Scope = Scope(), limit: int = 20) -> DataFrame:
    """Chapters whose title holds the query, with their book."""
    rows = c.chapters.filter(F.lower("chapter").contains(query.lower())).join(books_in(c, scope).selectExpr(*_BOOK, "language"), "book_id")
    out = _title_hits(rows, "chapter", "chapter", query).orderBy(F.desc("rank"), "chapter_id").limit(limit)
    return out.select("domain", "rank", "chapter_id", "chapter", "book_id", "book", "author", "category", F.lower(F.coalesce("language", F.lit(""))).alias("language"), "file_id")


def section_search(c: Catalog, query: str, *, scope: Scope = Scope(), limit: int = 20) -> DataFrame:
    """Sections whose title holds the query, with their chapter and book."""
    rows = c.sections.filter(F.lower("section").contains(query.lower())).join(c.chapters.select("chapter_id", "chapter"), "chapter_id").join(books_in(c, scope).selectExpr(*_BOOK, "language"), "book_id")
    out = _title_hits(rows, "section", "section", query).orderBy(F.desc("rank"), "section_id").limit(limit)
    return out.select("domain", "rank", "section_id", "section", "chapter_id", "chapter", "book_id", "book", "author", "category", F.lower(F.coalesce("language", F.lit(""))).alias("language"), "file_id")


def vector_search(embedded: DataFrame, chunks: DataFrame, c: Catalog, vector: list[float], *, model: str, version: str | None = None, scope: Scope = Scope(), limit: int = 20, min_score: float | None = None) -> DataFrame:
    """The chunks most similar to a vector among those embedded by one model, with their place.

    ``embedded`` has (chunk_id, model_name, model_version, vector); without a version the greatest of the model, by
    text, is taken. The least score applies to the hits after the limit. A vector of another size than the model's
    is refused by the first row it meets.
    """
    rows = embedded.filter(F.col("model_name") == model)
    rows = rows.filter(F.col("model_version") == version) if version else rows.filter(F.col("model_version") == rows.agg(F.max("model_version")).scalar())
    names = ["chunk_id", "book_id", "chapter_id", "section_id", "page_start", "page_end", "language"]
    rows = rows.select("chunk_id", "vector").join(scoped_chunks(chunks, c, scope).select(*names), "chunk_id")
    best = vectors.nearest(rows, vector, column="vector", key="chunk_id", k=limit, min_score=min_score).drop("vector")
    out = _placed(best, c, Scope()).join(chunks.select("chunk_id", "text"), "chunk_id").orderBy(F.desc("score"), "chunk_id")
    return out.select("score", "chunk_id", "text", "book", "author", "category", "chapter", "section", "page", "language", "book_id", "chapter_id", "section_id", "file_id", "sha256", "format")


def hybrid_search(index: DataFrame, embedded: DataFrame, chunks: DataFrame, c: Catalog, query: str, vector: list[float] | None, *, model: str, weight_fts: float = 0.5, weight_vector: float = 0.5, scope: Scope = Scope(), limit: int = 20, min_score: float | None = None) -> DataFrame:
    """Both searches over pools of three times the limit (20 at least), fused; each hit with all that either knows."""
    pool = max(3 * limit, 20)
    fields = ("text", "book", "author", "category", "chapter", "section", "page", "language", "book_id", "file_id", "sha256", "format")
    words = content_search(index, chunks, c, query, scope=scope, limit=pool)
    if vector is None or weight_vector <= 0:
        near, weight_vector = words.select("chunk_id", F.col("rank").alias("score"), *fields).limit(0), 0.0
    else:
        near = vector_search(embedded, chunks, c, vector, model=model, scope=scope, limit=pool)
    return vectors.fuse(words, near, on=["chunk_id"], weight_fts=weight_fts, weight_vector=weight_vector, k=limit, min_score=min_score, fields=fields)


def citations(chunks: DataFrame, c: Catalog) -> DataFrame:
    """The lineage of every chunk and the reference by which it is cited; what is missing stays null."""
    books = c.books.join(c.files, "file_id", "left").select("book_id", F.col("title").alias("book"), "file_id", "sha256")
    out = chunks.join(books, "book_id", "left").join(c.chapters.select("chapter_id", "chapter"), "chapter_id", "left").join(c.sections.select("section_id", "section"), "section_id", "left")
    page = F.coalesce(F.nullif(F.col("page_start"), F.lit(0)), F.col("page_end"))
    col = F.col
    ref = tx.citation(F.lit("book"), title=col("book"), book_id=col("book_id"), chapter=col("chapter"), section=col("section"), page=page, chunk_id=col("chunk_id"))
    return out.select("chunk_id", "book_id", "book", "chapter_id", "chapter", "section_id", "section", "page_start", "page_end", page.alias("page"), "file_id", "sha256", ref.alias("reference"))


def cite(records: DataFrame, kind: str, **names: str) -> DataFrame:
    """``reference`` of records of one kind: ``chunk``, ``verse``, ``translation`` or ``report``; others are refused.

    ``names`` says which column holds which part of the reference (see ``text.citation``).
    """
    kinds = {"chunk": "book", "verse": "quran", "translation": "quran", "report": "hadith"}
    if kind not in kinds:
        raise TypeError(f"no citation exists for {kind}")
    parts = {part: F.col(column) for part, column in names.items() if not (kind == "verse" and part in ("language", "translator"))}
    return records.withColumn("reference", tx.citation(F.lit(kinds[kind]), **parts))
