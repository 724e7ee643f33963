"""Scopes, domain searches over verses and reports, snippets, sort modes, links and structure review."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import fulltext

# Fixed values.
LANGUAGES = ["ar", "ur", "en", "other"]
ALIASES = {"ar": ["ar", "ara", "arabic"], "ur": ["ur", "urd", "urdu"], "en": ["en", "eng", "english"]}
SCOPES = {"all": ["content", "book", "chapter", "section", "quran", "hadith"], "books": ["content", "book", "chapter", "section"], "quran": ["quran"], "hadith": ["hadith"]}
ANSWER_SOURCES = {"library": 6}
DEFAULT_ANSWER_SOURCES = 4


def domains(scope: str) -> list[str]:
    return SCOPES.get(scope, SCOPES["all"])


def answer_sources(scope: str) -> int:
    return ANSWER_SOURCES.get(scope, DEFAULT_ANSWER_SOURCES)


def scope(df: DataFrame, *, language: str | None = None, alias: bool = False, category: str | None = None, author: str | None = None, sha: str | None = None, source_format: str | None = None, columns: dict[str, str] | None = None) -> DataFrame:
    """The rows of a search scope. An unknown language or format filters nothing; ``alias`` compares labels
    by all their names. ``columns`` says where a condition's column has another name."""
    at = {"language": "language", "category": "category", "author": "author", "sha": "sha256", "source_format": "format"} | (columns or {})
    if language and not alias and language in LANGUAGES:
        df = df.filter(F.col(at["language"]) == language)
    if language and alias and language in ALIASES:
        df = df.filter(F.lower(F.coalesce(F.col(at["language"]), F.lit(""))).isin(ALIASES[language]))
    if category:
        df = df.filter(F.col(at["category"]) == category)
    if author:
        df = df.filter(F.lower(F.col(at["author"])).contains(author.lower()))
    if sha:
        df = df.filter(F.col(at["sha"]).startswith(sha))
    if source_format and source_format in ("pdf", "epub", "docx", "txt", "html", "json"):
        df = df.filter(F.col(at["source_format"]) == source_format)
    return df


def validate(query: str, limit: int, scope_name: str = "all") -> None:
    """Bounds of a search request."""
    if not 1 <= len(query.strip()) <= 500:
        raise ValueError("a query has 1 to 500 characters")
    if not 1 <= limit <= 100:
        raise ValueError("a limit is between 1 and 100")
    if scope_name not in SCOPES:
        raise ValueError(f"unknown scope: {scope_name}")


def text_layer(files: DataFrame, jobs: DataFrame, key: str) -> DataFrame:
    """Files whose inspection found pages with text; files never inspected stay."""
    seen = jobs.select(F.col(key).alias("_k"), F.get_json_object("manifest", "$.text_pages").try_cast("int").alias("_n"))
    return files.join(seen, files[key] == F.col("_k"), "left").filter(F.coalesce(F.col("_n") > 0, F.lit(True))).drop("_k", "_n")


def verse_search(verses: DataFrame, query: str, *, language: str | None = None, limit: int = 20) -> DataFrame:
    """Hits ``(citation, text, language, rank)`` of ``(chapter, verse, text, translation, translator, language)``.

    The original is asked in folded form where the language is none, ar or other, translations where it is
    none, en, ur or other; a translation's citation names the translator.
    """
    q = fulltext.parse_query(query)
    folded = verses.select("chapter", "verse", "text", tx.search_fold(F.col("text")).alias("_f")).distinct()
    ref = F.concat_ws(":", F.col("chapter").cast("string"), F.col("verse").cast("string"))
    parts = []
    if language in (None, "", "ar", "other"):
        asked = fulltext.Query(tuple(_fold(t) for t in q.terms), tuple(tuple(map(_fold, p)) for p in q.phrases), tuple(map(_fold, q.excluded)), q.every, tuple(tuple(map(_fold, g)) for g in q.groups))
        hits = fulltext.matching(folded, asked, F.col("_f"))
        parts.append(hits.select(ref.alias("citation"), "text", F.lit("ar").alias("language"), F.round(fulltext.term_rank(asked), 6).alias("rank")))
    if language in (None, "", "en", "ur", "other"):
        hits = fulltext.matching(verses.filter("translation is not null"), q, F.col("translation"))
        parts.append(hits.select(F.concat(ref, F.lit(" ("), F.col("translator"), F.lit(")")).alias("citation"), F.col("translation").alias("text"), "language", F.round(fulltext.term_rank(q), 6).alias("rank")))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.orderBy(F.desc("rank"), "citation").limit(limit)


def _fold(word: str) -> str:
    bare = re.sub("[ـ\u064b-\u065f\u0670]", "", word)
    return unicodedata.normalize("NFC", bare).translate(str.maketrans("ٱآأإى", "ااااي"))


def report_search(reports: DataFrame, query: str, *, limit: int = 20) -> DataFrame:
    """Hits ``(citation, text, rank)`` of ``(collection, number, text, text_arabic)``: both texts are asked,
    both sides folded, whatever the language."""
    q = fulltext.parse_query(query)
    asked = fulltext.Query(tuple(_fold(t) for t in q.terms), tuple(tuple(map(_fold, p)) for p in q.phrases), tuple(map(_fold, q.excluded)), q.every, tuple(tuple(map(_fold, g)) for g in q.groups))
    both = F.concat_ws(" ", tx.search_fold(F.col("text")), tx.search_fold(F.col("text_arabic")))
    hits = fulltext.matching(reports, asked, both)
    return hits.select(F.concat("collection", F.lit(" #"), F.col("number").cast("string")).alias("citation"), "text", F.round(fulltext.term_rank(asked), 6).alias("rank")).orderBy(F.desc("rank"), "citation").limit(limit)


def snippet(text: Column, terms: list[str], words: int = 24) -> Column:
    """At most ``words`` words round the first term, all terms in <mark>."""
    parts = F.split(tx.squeeze(text), " ")
    pattern = "(?i)(?<![\\p{L}\\p{N}])(" + "|".join(map(re.escape, terms)) + ")(?![\\p{L}\\p{N}])"
    hits = F.filter(F.transform(parts, lambda w, i: F.when(w.rlike(pattern), i)), lambda i: i.isNotNull())
    start = F.greatest(F.lit(0), F.coalesce(F.get(hits, F.lit(0)), F.lit(0)) - words // 3)
    return F.regexp_replace(F.array_join(F.slice(parts, start + 1, F.lit(words)), " "), pattern, "<mark>$1</mark>")


def merged_hits(hits: DataFrame, query: str, limit: int, *, rank: str = "rank", domain: str = "domain", key: str = "hit_id") -> DataFrame:
    """The best hits of each query over all domains, numbered: by rank as it is, then domain and key."""
    w = Window.partitionBy(query).orderBy(F.desc(rank), domain, key)
    return hits.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= limit)


def terms_of(query: str) -> list[str]:
    """The distinct words of a query as typed, lower-cased."""
    return list(dict.fromkeys(query.strip().lower().split()))


def all_terms(haystack: Column, terms: list[str]) -> Column:
    """Whether every term stands in the text, whatever the case."""
    return F.forall(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower(haystack), t))


def book_score(title: Column, author: Column, description: Column, terms: list[str]) -> Column:
    """30 for any term in the title, 20 and 10 for the first one in author and description, and one for each term."""
    def low(c: Column) -> Column:
        return F.lower(F.coalesce(c, F.lit("")))

    first = terms[0] if terms else ""
    some = F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(low(title), t))
    return F.when(some, 30).otherwise(0) + F.when(F.contains(low(author), F.lit(first)), 20).otherwise(0) + F.when(F.contains(low(description), F.lit(first)), 10).otherwise(0) + len(terms)


def chapter_score(chapter: Column, terms: list[str]) -> Column:
    """14 for any term in the chapter's title, 8 where only the book's has them."""
    return F.when(F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower(chapter), t)), 14).otherwise(8)


def page_score(page: Column) -> Column:
    """6, and one more for the first two pages."""
    return F.when(page <= 2, 7).otherwise(6)


def sort_mode(mode: str) -> list[Column]:
    """Orders of a book list; each ends in the id."""
    first = {"recent": F.desc("updated_at"), "title": F.lower(F.col("title")), "pages": F.desc_nulls_last("page_count")}
    if mode not in first:
        raise ValueError(f"unknown order: {mode}")
    return [first[mode], F.col("id")]


def book_link(book: Column, page: Column, chapter: Column | None = None) -> Column:
    """A deep link into a book."""
    parts = F.concat_ws("&", F.when(page.isNotNull(), F.concat(F.lit("page="), page.cast("string"))), F.when(chapter.isNotNull(), F.concat(F.lit("chapter="), chapter)) if chapter is not None else F.lit(None))
    return F.concat(F.lit("/books/"), F.translate(book, " ", "-"), F.when(parts != "", F.concat(F.lit("?"), parts)).otherwise(""))


def candidate_headings(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, line_no, line)``: short lines between empty ones that end no sentence, by built-ins only."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    w = Window.partitionBy(key).orderBy("line_no")
    near = lines.withColumn("_p", F.lag("line", 1, "").over(w)).withColumn("_n", F.lead("line", 1, "").over(w))
    t = F.trim("line")
    n = F.size(F.filter(F.split(t, "[ \t]+"), lambda x: x != ""))
    alone = (F.trim("_p") == "") & (F.trim("_n") == "")
    ok = (n >= 2) & (n <= 14) & (F.length(t) <= 90) & ~t.rlike("[،؛:.؟!?—۔]$")
    return near.filter(alone & ok).select(key, "line_no", t.alias("line"))


def review_blocks(blocks: DataFrame, decisions: DataFrame) -> DataFrame:
    """Blocks with the status that ``(book_id, page, sequence, action)`` gives: published or quarantined."""
    on = ["book_id", "page", "sequence"]
    out = blocks.join(decisions.select(*on, "action"), on, "left")
    return out.withColumn("status", F.when(F.col("action") == "approve", "published").when(F.col("action") == "reject", "quarantined").otherwise(F.col("status"))).drop("action")


def linked(left: DataFrame, links: DataFrame, right: DataFrame, on_left: str, on_right: str) -> DataFrame:
    """Both sides of a many-to-many relation, a row for each distinct link."""
    return left.join(links.select(on_left, on_right).distinct(), on_left).join(right, on_right)


def stage_report(df: DataFrame, stage: str, key: str) -> DataFrame:
    """``(key, stage, report, summary)``: the row as JSON and as one line of text."""
    names = [c for c in df.columns if c != key]
    line = F.concat_ws(", ", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in names])
    return df.select(key, F.lit(stage).alias("stage"), F.to_json(F.struct(*names)).alias("report"), F.concat(F.lit(f"{stage}: "), line).alias("summary"))
