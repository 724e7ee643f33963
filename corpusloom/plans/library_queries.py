"""Queries of scopes, snippets, links, reports and of rollups over structure and seeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import corpus, fulltext, library, structure, vectors
from corpusloom.plans.corpus_queries import _PAGES, _pages
from corpusloom.plans.registry import query
from corpusloom.plans.retrieval_queries import _DOCS, _docs, _hit
from corpusloom.plans.text_queries import SPACES
from corpusloom.session import table

_HITS = "(SELECT DISTINCT hit_id, domain, rank, language, author, category, book_id, source_file_id, page FROM search_hits)"


def _hits(spark, sf):
    return table(spark, sf, "search_hits").select("hit_id", "domain", "rank", "language", "author", "category", "book_id", "source_file_id", "page").distinct()


@query(f"SELECT hit_id FROM {_HITS} WHERE language = 'en' AND category = 'history'")
def scope_exact_language(spark, sf):
    return library.scope(_hits(spark, sf), language="en", category="history", source_format="unknown").select("hit_id")


@query(f"SELECT hit_id FROM {_HITS} WHERE lower(coalesce(language, '')) IN ('ar', 'ara', 'arabic') AND contains(lower(author), 'al-')")
def scope_language_alias(spark, sf):
    return library.scope(_hits(spark, sf), language="ar", alias=True, author="AL-").select("hit_id")


@query(f"SELECT hit_id FROM {_HITS} WHERE starts_with(source_file_id, 'sf-0000001')")
def scope_unknown_language(spark, sf):
    return library.scope(_hits(spark, sf), language="xx", sha="sf-0000001", columns={"sha": "source_file_id"}).select("hit_id")


@query(f"SELECT hit_id, '/books/' || replace(book_id, ' ', '-') || CASE WHEN page IS NOT NULL THEN '?page=' || page ELSE '' END AS link FROM {_HITS}")
def citation_urls(spark, sf):
    return _hits(spark, sf).select("hit_id", library.book_link(F.col("book_id"), F.col("page")).alias("link"))


_MARK = r"regexp_replace({0}, '(?i)(^|[^\p{{L}}\p{{N}}>])(treasurer|lamps)($|[^\p{{L}}\p{{N}}<])', '\1<mark>\2</mark>\3', 'g')"


@query(f"""WITH p AS (SELECT doc_id, string_split(trim(regexp_replace(text, '[{SPACES}]+', ' ', 'g')), ' ') AS w FROM {_DOCS} WHERE {_hit('treasurer')} OR {_hit('lamps')}),
    f AS (SELECT doc_id, w, coalesce(list_min(list_filter(range(1, len(w) + 1), lambda i: regexp_matches(w[i], '(?i)(^|[^\\p{{L}}\\p{{N}}])(treasurer|lamps)($|[^\\p{{L}}\\p{{N}}])'))) - 1, 0) AS spot FROM p),
    s AS (SELECT doc_id, array_to_string(w[greatest(0, spot - 8) + 1 : greatest(0, spot - 8) + 24], ' ') AS t FROM f)
    SELECT doc_id, {_MARK.format(_MARK.format('t'))} AS snippet FROM s""")
def snippets(spark, sf):
    q = fulltext.parse_query("treasurer lamps")
    return fulltext.matching(_docs(spark, sf), q, F.col("text")).select("doc_id", library.snippet(F.col("text"), ["treasurer", "lamps"]).alias("snippet"))


@query(f"SELECT count(*) AS n, count(DISTINCT doc_id) AS docs FROM {_DOCS} WHERE {_hit('treasurer')} OR {_hit('lamps')}")
def match_counts(spark, sf):
    q = fulltext.parse_query("treasurer lamps")
    return fulltext.matching(_docs(spark, sf), q, F.col("text")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))


@query(r"""WITH l AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, a[i] AS line, CASE WHEN i > 1 THEN a[i - 1] ELSE '' END AS p, CASE WHEN i < len(a) THEN a[i + 1] ELSE '' END AS n
    FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL), LATERAL (SELECT unnest(range(1, len(a) + 1)) AS i))
    SELECT doc_id, line_no, trim(line, ' ') AS line FROM l WHERE trim(p, ' ') = '' AND trim(n, ' ') = '' AND len([w for w in regexp_split_to_array(trim(line, ' '), '[ \t]+') if w <> '']) BETWEEN 2 AND 14
    AND length(trim(line, ' ')) <= 90 AND NOT regexp_matches(trim(line, ' '), '[،؛:.؟!?—۔]$')""")
def candidate_headings(spark, sf):
    return library.candidate_headings(table(spark, sf, "documents").filter("text is not null"), "doc_id", "text")


@query()
def blocks_by_type(spark, sf):
    pages = table(spark, sf, "documents").filter("book_id is not null").select("book_id", F.coalesce("page_number", F.lit(0)).alias("page"), "text")
    return structure.structure_books(pages).groupBy("type", "review").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH e AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND doc_id % 2 = 0), i AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL)
    SELECT CASE WHEN e.doc_id IS NULL THEN 'created' WHEN e.text = i.text THEN 'skipped' ELSE 'conflict' END AS action, count(*) AS n FROM i LEFT JOIN e USING (doc_id) GROUP BY 1""")
def seed_report(spark, sf):
    docs = table(spark, sf, "documents").filter("text is not null").select("doc_id", "text")
    return corpus.seed(docs.filter("doc_id % 2 = 0"), docs, ["doc_id"], "text").groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH m AS (SELECT chunk_id, content_hash, row_number() OVER (PARTITION BY chunk_id ORDER BY updated_at DESC, id DESC) AS k FROM chunk_vectors WHERE model_name = 'dense-leaf')
    SELECT CASE WHEN m.chunk_id IS NULL THEN 'new' WHEN m.content_hash = substring(c.chunk_id, 1, 16) THEN 'reused' ELSE 'updated' END AS action, count(*) AS n, CAST(ceil(count(*) / 64.0) AS BIGINT) AS batches
    FROM (SELECT DISTINCT chunk_id FROM content_chunks) c LEFT JOIN m ON c.chunk_id = m.chunk_id AND m.k = 1 GROUP BY 1""")
def embed_counters(spark, sf):
    old = table(spark, sf, "chunk_vectors").filter("model_name = 'dense-leaf'").groupBy("chunk_id").agg(F.max_by("content_hash", F.struct("updated_at", "id")).alias("content_hash"))
    now = table(spark, sf, "content_chunks").select("chunk_id").distinct().withColumn("content_hash", F.substring("chunk_id", 1, 16))
    n = F.count(F.lit(1))
    return vectors.embedding_plan(now, old).groupBy("action").agg(n.alias("n"), F.ceil(n / 64).cast("long").alias("batches"))


@query(f"""WITH p AS (SELECT file, length(coalesce(text, '')) AS n, coalesce(has_images, false) AS images FROM {_PAGES}),
    r AS (SELECT file, count(*) AS pages, count(*) FILTER (n >= 30) AS text_pages, count(*) FILTER (n < 30 AND images) AS scanned_pages, count(*) FILTER (n = 0 AND NOT images) AS blank_pages, 0 AS unreadable_pages, CAST(sum(n) AS BIGINT) AS chars FROM p GROUP BY file),
    k AS (SELECT *, CASE WHEN scanned_pages >= 0.8 * pages OR text_pages = 0 THEN 'scanned' WHEN text_pages >= 0.95 * pages AND scanned_pages <= 0.02 * pages THEN 'text' ELSE 'mixed' END AS kind FROM r)
    SELECT file, 'inspect' AS stage, printf('{{"pages":%d,"text_pages":%d,"scanned_pages":%d,"blank_pages":%d,"unreadable_pages":%d,"chars":%d,"kind":"%s"}}', pages, text_pages, scanned_pages, blank_pages, unreadable_pages, chars, kind) AS report,
    printf('inspect: pages: %d, text_pages: %d, scanned_pages: %d, blank_pages: %d, unreadable_pages: %d, chars: %d, kind: %s', pages, text_pages, scanned_pages, blank_pages, unreadable_pages, chars, kind) AS summary FROM k""")
def inspect_reports(spark, sf):
    return library.stage_report(corpus.inspect_pages(_pages(spark, sf)), "inspect", "file")


@query("SELECT id, title, page_count, row_number() OVER (ORDER BY page_count DESC NULLS LAST, id) AS position FROM (SELECT DISTINCT id, title, page_count FROM books) QUALIFY position <= 15")
def books_by_pages(spark, sf):
    books = table(spark, sf, "books").select("id", "title", "page_count").distinct()
    from corpusloom.operators.operations import page_of

    return page_of(books, library.sort_mode("pages"), 1, 15).select("id", "title", "page_count", F.col("position").cast("long").alias("position"))


@query("SELECT language, field, count(*) AS n FROM (SELECT DISTINCT b.id, b.language, t.field FROM (SELECT DISTINCT id, language, source_file_id FROM books) b JOIN (SELECT DISTINCT source_file_id, field FROM metadata_candidates) t ON b.source_file_id = t.source_file_id) GROUP BY ALL")
def books_by_fact(spark, sf):
    """Books and fields as two sides of a many-to-many relation."""
    b = table(spark, sf, "books").select("id", "language", "source_file_id").distinct()
    t = table(spark, sf, "metadata_candidates").select("source_file_id", "field").distinct()
    links = b.select("id", "source_file_id").join(t, "source_file_id")
    return library.linked(b, links, t.select("field").distinct(), "id", "field").groupBy("language", "field").agg(F.count(F.lit(1)).alias("n"))


def _verses(spark, sf):
    """Evaluation items as verses: the text as the original of every third, as its translation of all."""
    i = F.col("item_id")
    return table(spark, sf, "eval_items").select((i % 114 + 1).cast("int").alias("chapter"), i.cast("int").alias("verse"), F.when(i % 3 == 0, F.col("text")).alias("text"), F.col("text").alias("translation"), F.lit("T. R.").alias("translator"), F.col("lang").alias("language"))


_WORDS = r"regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}]+')"
_FOLD = "translate(nfc_normalize(regexp_replace({0}, '[\u0640\u064b-\u065f\u0670]', '', 'g')), 'ٱآأإى', 'ااااي')"


@query(f"""WITH v AS (SELECT CAST(item_id % 114 + 1 AS VARCHAR) || ':' || item_id AS ref, item_id, text, lang FROM eval_items),
    o AS (SELECT ref AS citation, text, 'ar' AS language, round(len(list_filter({_WORDS.format(_FOLD.format('text'))}, lambda t: t IN ('scribe', 'salt'))) * 0.1, 6) AS rank FROM v WHERE item_id % 3 = 0),
    t AS (SELECT ref || ' (T. R.)' AS citation, text, lang AS language, round(len(list_filter({_WORDS.format('text')}, lambda t: t IN ('scribe', 'salt'))) * 0.1, 6) AS rank FROM v)
    SELECT * FROM (SELECT * FROM o UNION ALL SELECT * FROM t) WHERE rank > 0 ORDER BY rank DESC, citation LIMIT 40""")
def verse_search(spark, sf):
    return library.verse_search(_verses(spark, sf), "scribe salt", limit=40)


@query(f"""WITH r AS (SELECT split || ' #' || item_id AS citation, text, {_WORDS.format(_FOLD.format("text || ' ' || coalesce(question, '')"))} AS w FROM eval_items)
    SELECT citation, text, round(len(list_filter(w, lambda t: t IN ('scribe', 'salt'))) * 0.1, 6) AS rank FROM r WHERE list_contains(w, 'scribe') OR list_contains(w, 'salt') ORDER BY rank DESC, citation LIMIT 30""")
def report_search(spark, sf):
    rows = table(spark, sf, "eval_items").select(F.col("split").alias("collection"), F.col("item_id").alias("number"), "text", F.col("question").alias("text_arabic"))
    return library.report_search(rows, "scribe salt", limit=30)


@query(f"SELECT count(DISTINCT w) AS words, count(*) AS places FROM (SELECT unnest({_WORDS.format('text')}) AS w FROM documents)")
def distinct_terms(spark, sf):
    words = table(spark, sf, "documents").select(F.explode(tx.tokens(F.col("text"))).alias("w"))
    return words.agg(F.countDistinct("w").alias("words"), F.count(F.lit(1)).alias("places"))


@query(r"SELECT p_partkey, regexp_matches(upper(left(p_name, 2)), '^(M{0,3})(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$') AS roman FROM part")
def roman_numerals(spark, sf):
    return table(spark, sf, "part").select("p_partkey", tx.is_roman(F.upper(F.left("p_name", F.lit(2)))).alias("roman"))


@query("SELECT c.chunk_id, c.sequence FROM (SELECT chunk_id, sequence, source_file_id, row_number() OVER (PARTITION BY chunk_id ORDER BY updated_at DESC, id DESC) AS k FROM content_chunks) c WHERE k = 1 AND starts_with(source_file_id, 'sf-0000000') ORDER BY sequence, chunk_id LIMIT 30")
def cite_by_file(spark, sf):
    from corpusloom.plans.retrieval_queries import chunks

    return library.scope(chunks(spark, sf), sha="sf-0000000", columns={"sha": "source_file_id"}).orderBy("sequence", "chunk_id").limit(30).select("chunk_id", "sequence")
