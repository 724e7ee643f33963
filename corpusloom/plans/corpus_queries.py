"""Queries of the corpus pipeline: ingest, inspection, metadata, chunks and seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import chunking, corpus, operations
from corpusloom.plans.registry import query
from corpusloom.plans.retrieval_queries import CHUNKS, chunks
from corpusloom.plans.text_queries import ENDS, LETTERS, LINE_BREAK, SPACES, STRIP, VISIBLE
from corpusloom.session import table

_EXT = "CASE doc_id % 5 WHEN 0 THEN 'PDF' WHEN 1 THEN 'txt' WHEN 2 THEN 'htm' WHEN 3 THEN 'xyz' ELSE 'md' END"
_FILES = f"(SELECT '/in/' || source || '/' || doc_id || '.' || {_EXT} AS path, source AS category, coalesce(length(text), 0) AS size, sha256(coalesce(text, '')) AS sha256 FROM documents)"


def _files(spark: SparkSession, sf: str) -> DataFrame:
    ext = F.element_at(F.array(*map(F.lit, ["PDF", "txt", "htm", "xyz", "md"])), (F.col("doc_id") % 5 + 1).cast("int"))
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf, "documents").select(F.concat(F.lit("/in/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"), F.col("source").alias("category"), F.length(t).cast("long").alias("size"), F.sha2(t, 256).alias("sha256"))


@query(f"""WITH r AS (SELECT *, regexp_extract(path, '([^/]+)$', 1) AS name, CASE WHEN ends_with(path, '.xyz') THEN 'unsupported format' WHEN size = 0 THEN 'empty file' END AS reason FROM {_FILES}),
    n AS (SELECT *, row_number() OVER (PARTITION BY sha256, reason IS NULL ORDER BY path) AS k, row_number() OVER (PARTITION BY name, reason IS NULL ORDER BY path) - 1 AS m FROM r)
    SELECT path, reason, CASE WHEN reason IS NOT NULL THEN 'quarantined' WHEN k > 1 THEN 'duplicate' ELSE 'registered' END AS status,
    CASE WHEN reason IS NULL THEN concat_ws('/', 'raw', category, substring(sha256, 1, 2), substring(sha256, 3, 2), sha256, name) WHEN m = 0 THEN 'quarantine/' || name
    ELSE 'quarantine/' || regexp_extract(name, '^(.*?)(\\.[^.]*)?$', 1) || '-' || m || regexp_extract(name, '^(.*?)(\\.[^.]*)?$', 2) END AS target FROM n""")
def ingest_routing(spark, sf):
    return corpus.ingest(_files(spark, sf)).select("path", "reason", "status", "target")


@query("SELECT format, count(*) AS n FROM (SELECT CASE doc_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'txt' WHEN 2 THEN 'html' WHEN 4 THEN 'txt' END AS format FROM documents) GROUP BY format")
def format_stats(spark, sf):
    return _files(spark, sf).groupBy(corpus.file_format(F.col("path")).alias("format")).agg(F.count(F.lit(1)).alias("n"))


_PAGES = "(SELECT book_id AS file, page_number AS page, text, doc_id % 3 = 0 AS has_images FROM documents WHERE book_id IS NOT NULL)"


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").filter("book_id is not null").select(F.col("book_id").alias("file"), F.col("page_number").alias("page"), "text", (F.col("doc_id") % 3 == 0).alias("has_images"))


@query(f"""WITH p AS (SELECT file, length(coalesce(text, '')) AS n, coalesce(has_images, false) AS images FROM {_PAGES}),
    r AS (SELECT file, count(*) AS pages, count(*) FILTER (n >= 30) AS text_pages, count(*) FILTER (n < 30 AND images) AS scanned_pages, count(*) FILTER (n = 0 AND NOT images) AS blank_pages, CAST(0 AS BIGINT) AS unreadable_pages, CAST(sum(n) AS BIGINT) AS chars FROM p GROUP BY file)
    SELECT *, CASE WHEN scanned_pages >= 0.8 * pages OR text_pages = 0 THEN 'scanned' WHEN text_pages >= 0.95 * pages AND scanned_pages <= 0.02 * pages THEN 'text' ELSE 'mixed' END AS kind FROM r""")
def doc_classification(spark, sf):
    return corpus.inspect_pages(_pages(spark, sf))


@query(f"""SELECT file, count(*) FILTER (q = 'ok') AS ok, count(*) FILTER (q = 'garbled') AS garbled, count(*) FILTER (q = 'blank') AS blank FROM (
    SELECT file, CASE WHEN text IS NULL OR {VISIBLE.format('text')} = 0 THEN 'blank' WHEN {LETTERS.format('text')} < 0.5 * {VISIBLE.format('text')} OR length(text) - length(replace(text, '?', '')) > 0.3 * {VISIBLE.format('text')} THEN 'garbled' ELSE 'ok' END AS q FROM {_PAGES}) GROUP BY file""")
def page_rollup(spark, sf):
    q = F.col("q")
    return _pages(spark, sf).withColumn("q", tx.extract_quality(F.col("text"))).groupBy("file").agg(F.count_if(q == "ok").alias("ok"), F.count_if(q == "garbled").alias("garbled"), F.count_if(q == "blank").alias("blank"))


@query("""SELECT DISTINCT p.file, p.page FROM (SELECT book_id AS file, page_number AS page FROM documents WHERE book_id IS NOT NULL AND page_number IS NOT NULL AND (doc_id % 3 = 0 OR length(coalesce(text, '')) < 100)) p
    WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.book_id = p.file AND d.page_number = p.page AND d.doc_id % 7 = 0)""")
def ocr_plan(spark, sf):
    d = table(spark, sf, "documents").filter("book_id is not null and page_number is not null").select(F.col("book_id").alias("file"), F.col("page_number").alias("page"), "doc_id", "text")
    inspected = d.withColumn("scanned", F.col("doc_id") % 3 == 0)
    extracted = d.withColumn("quality", F.when(F.length(F.coalesce("text", F.lit(""))) < 100, "blank").otherwise("ok"))
    return corpus.plan_ocr(inspected, extracted, d.filter("doc_id % 7 = 0"))


_SAMPLE = "SELECT file, page FROM (SELECT file, page, row_number() OVER (PARTITION BY file ORDER BY page) AS a, row_number() OVER (PARTITION BY file ORDER BY page DESC) AS b FROM (SELECT DISTINCT book_id AS file, page_number AS page FROM documents WHERE book_id IS NOT NULL AND page_number IS NOT NULL)) WHERE a <= 4 OR b <= 4"


@query(_SAMPLE)
def sample_pages(spark, sf):
    pages = table(spark, sf, "documents").filter("book_id is not null and page_number is not null").select(F.col("book_id").alias("file"), F.col("page_number").alias("page")).distinct()
    return corpus.sample_pages(pages)


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "metadata_candidates").distinct()


_RANKED = """SELECT source_file_id, field, id, value, confidence, source, status, row_number() OVER (PARTITION BY source_file_id, field ORDER BY CASE WHEN status = 'approved' THEN 0 ELSE 1 END,
    CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END, -CASE source WHEN 'filename' THEN 1 WHEN 'first_pages' THEN 2 WHEN 'title_page' THEN 3 WHEN 'pdf_metadata' THEN 4 WHEN 'user_provided' THEN 5 ELSE 0 END, created_at, id) AS k
    FROM (SELECT DISTINCT * FROM metadata_candidates) WHERE status <> 'rejected'"""
_BEST = f"(SELECT source_file_id, field, id, value, confidence, source, status FROM ({_RANKED}) WHERE k = 1)"


@query(f"SELECT * FROM {_BEST}")
def metadata_merge(spark, sf):
    return corpus.merge_candidates(_facts(spark, sf))


@query(f"SELECT source_file_id, count(*) AS fields, CASE max(CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END) WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'none' END AS overall FROM {_BEST} GROUP BY source_file_id")
def overall_confidence(spark, sf):
    return corpus.overall_confidence(corpus.merge_candidates(_facts(spark, sf)))


@query(f"""SELECT source_file_id, count(*) FILTER (status IN ('pending', 'review') AND confidence = 'high') AS n_approved,
    CASE WHEN coalesce(bool_or(field = 'title' AND (status NOT IN ('pending', 'review') OR confidence = 'high')), false) THEN 'approved' ELSE 'blocked' END AS verdict FROM {_BEST} GROUP BY source_file_id""")
def review_gate(spark, sf):
    return corpus.review_gate(corpus.merge_candidates(_facts(spark, sf)), auto=True)


@query(f"""WITH w AS (SELECT source_file_id, max(value) FILTER (field = 'title') AS title, max(value) FILTER (field = 'author') AS author, max(value) FILTER (field = 'editor') AS editor, max(value) FILTER (field = 'publisher') AS publisher, max(value) FILTER (field = 'publication_year') AS y, max(value) FILTER (field = 'language') AS l FROM {_BEST} WHERE status = 'approved' GROUP BY source_file_id)
    SELECT source_file_id, title, author, publisher, CASE WHEN l IN ('ar', 'ur', 'en', 'other') THEN l END AS language, CASE WHEN regexp_extract(y, '([0-9]+)', 1) <> '' THEN CAST(regexp_extract(y, '([0-9]+)', 1) AS INTEGER) END AS year,
    nullif(concat_ws(' ', CASE WHEN regexp_extract(y, '([0-9]+)', 1) <> '' AND contains(y, '(AH)') THEN 'publication year as printed (Hijri)' END, 'editor: ' || editor), '') AS notes FROM w WHERE title IS NOT NULL""")
def publish_catalog(spark, sf):
    return corpus.publish(corpus.merge_candidates(_facts(spark, sf))).select("source_file_id", "title", "author", "publisher", "language", "year", "notes")


@query("SELECT field, confidence, source, count(*) AS n FROM (SELECT DISTINCT * FROM metadata_candidates) GROUP BY ALL")
def confidence_histogram(spark, sf):
    return _facts(spark, sf).groupBy("field", "confidence", "source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT sha256(value) AS id, value AS name FROM (SELECT DISTINCT value FROM metadata_candidates WHERE field = 'author' AND value IS NOT NULL)")
def author_dimension(spark, sf):
    names = _facts(spark, sf).filter("field = 'author'").select(F.col("value").alias("name"))
    return corpus.get_or_create(spark.createDataFrame([], "id string, name string"), names)


_MARKERS = {"author": "تأليف|تألیف|تاليف|تالیف|المؤلف|المولف|by", "editor": "تحقيق|تحقیق|المحقق|تصحيح|تصحیح|مصحح|المصحح|edited by", "translator": "ترجمة|ترجمه|مترجم|المترجم|translated by", "publisher": "مطبعة|مطبعه|المطبعة|دار|مكتبة|مکتبة|ناشر|پریس|لرتب|publisher", "edition": "الطبعة|الطبعه"}
_ALL_LINES = f"(SELECT file, page, CAST(i - 1 AS INTEGER) AS pos, list_transform(a, lambda x: {STRIP.format('x')}) AS lines, {STRIP.format('a[i]')} AS line, a[i] AS raw FROM (SELECT file, page, regexp_split_to_array(text, '{LINE_BREAK}') AS a FROM {_PAGES} WHERE text IS NOT NULL), LATERAL (SELECT unnest(range(1, len(a) + 1)) AS i))"


def _clean(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace({c}, '^[{ENDS}\\-–—]+', ''), '[{ENDS}\\-]+$', ''), '[{SPACES}]+', ' ', 'g'))"


def _value(field: str, markers: str) -> str:
    if field == "edition":
        return _clean("line")
    after = f"list_filter(lines[pos + 2 : pos + 4], lambda x: x <> '')[1]"
    rest = _clean(f"regexp_replace(line, '^({markers})', '')")
    return f"coalesce(nullif({rest}, ''), {_clean(after)}, '')"


_MARKED = "(SELECT file, page, pos, line, CASE " + " ".join(f"WHEN regexp_matches(line, '^({m})($|[^\\p{{L}}\\p{{N}}])') AND {_value(f, m)} <> '' THEN '{f}'" for f, m in _MARKERS.items()) + " END AS field, CASE " + " ".join(f"WHEN regexp_matches(line, '^({m})($|[^\\p{{L}}\\p{{N}}])') AND {_value(f, m)} <> '' THEN {_value(f, m)}" for f, m in _MARKERS.items()) + f" END AS value FROM {_ALL_LINES})"


@query(f"SELECT file, page, pos AS \"at\", field, value, 'high' AS confidence FROM {_MARKED} WHERE field IS NOT NULL")
def marked_facts(spark, sf):
    return corpus.marked_facts(_pages(spark, sf))


_ASCII = "translate({0}, '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789')"
_PLAIN = "(^|[^0-9])(1[2-9][0-9][0-9]|2[0-9][0-9][0-9])($|[^0-9])"
_ISBN = f"(?i)ISBN[{SPACES}]*[:：]?[{SPACES}]*([0-9][0-9Xx\\-–—{SPACES}]{{8,16}})"


@query(f"""WITH y AS (SELECT file, page, pos, line, regexp_extract(line, '([0-9]{{3,4}})[{SPACES}]*[هھ]', 1) AS h, regexp_extract(line, '{_PLAIN}', 2) AS p FROM (SELECT file, page, pos, {_ASCII.format('line')} AS line FROM {_ALL_LINES})),
    s AS (SELECT file, page, pos, CASE WHEN h <> '' AND CAST(h AS INTEGER) BETWEEN 100 AND 1699 THEN h || ' (AH)' WHEN p <> '' AND regexp_matches(line, 'هجری|هجري|قمری|قمرے|سنة|سنه|سال|ھ|هـ') THEN p END AS sure, nullif(p, '') AS plain FROM y),
    years AS (SELECT file, arg_min(coalesce(sure, plain), (sure IS NULL, page, pos, coalesce(sure, plain))) AS value, arg_min(CASE WHEN sure IS NOT NULL THEN 'high' ELSE 'medium' END, (sure IS NULL, page, pos, coalesce(sure, plain))) AS confidence FROM s WHERE (sure IS NOT NULL OR plain IS NOT NULL) AND page IS NOT NULL GROUP BY file),
    m AS (SELECT file, page, text, list_filter(list_transform(regexp_split_to_array(text, '{LINE_BREAK}'), lambda x: regexp_replace(regexp_extract(x, '{_ISBN}', 1), '[^0-9Xx]', '', 'g')), lambda v: length(v) IN (10, 13))[1] AS marked, regexp_extract({_ASCII.format('text')}, '(^|[^0-9])(97[89][0-9]{{10}})($|[^0-9])', 2) AS bare FROM {_PAGES}),
    books AS (SELECT file, arg_min(coalesce(marked, nullif(bare, '')), (page, coalesce(marked, nullif(bare, '')))) AS value FROM m WHERE coalesce(marked, nullif(bare, '')) IS NOT NULL AND page IS NOT NULL GROUP BY file),
    titles AS (SELECT file, line AS value FROM (SELECT file, line, row_number() OVER (PARTITION BY file ORDER BY page, length(line) DESC, lower(line) DESC, pos, line DESC) AS k FROM {_MARKED} WHERE field IS NULL AND length(line) BETWEEN 3 AND 250 AND NOT regexp_matches(line, '^[0-9٠-٩۰-۹]{{1,4}}$')
        AND NOT (starts_with(lower(line), 'بسم') OR starts_with(lower(line), 'بِسْم') OR starts_with(lower(line), 'بسملہ') OR lower(line) = 'الرحمن الرحيم' OR contains(lower(line), 'بِسْمِ اللَّهِ')) AND page IS NOT NULL) WHERE k = 1)
    SELECT file, 'publication_year' AS field, value, confidence FROM years UNION ALL SELECT file, 'isbn', value, 'high' FROM books UNION ALL SELECT file, 'title', value, 'medium' FROM titles""")
def page_facts(spark, sf):
    p = _pages(spark, sf).filter("page is not null")
    return corpus.year_facts(p).unionByName(corpus.isbn_facts(p)).unionByName(corpus.title_guess(p))


@query(r"""SELECT file, field, value, confidence FROM (SELECT id AS file, 'edition' AS field, 'Vol. ' || regexp_extract(name, '(?i)(?:^|[-_. ])(vol|volume|juz|juzo)[-_. ]*([0-9]+)(?:[-_. ]*)$', 2) AS value, 'medium' AS confidence FROM (SELECT DISTINCT id, title || '_vol_' || page_count AS name FROM books))
    UNION ALL SELECT id, 'title', trim(regexp_replace(title, '[-_. ]+', ' ', 'g')), 'low' FROM (SELECT DISTINCT id, title FROM books) WHERE length(trim(title)) BETWEEN 3 AND 200""")
def filename_facts(spark, sf):
    files = table(spark, sf, "books").select(F.col("id").alias("file"), F.concat("title", F.lit("_vol_"), F.col("page_count").cast("string"), F.lit(".pdf")).alias("name")).distinct()
    return corpus.filename_facts(files, "file", "name")


@query("""WITH p AS (SELECT DISTINCT content_block_id, book_id, text, updated_at FROM content_chunks), n AS (SELECT book_id, count(*) AS incoming, count(DISTINCT content_block_id) AS known FROM p GROUP BY book_id) SELECT * FROM n""")
def blocks_by_book(spark, sf):
    p = table(spark, sf, "content_chunks").select("content_block_id", "book_id", "text", "updated_at").distinct()
    return p.groupBy("book_id").agg(F.count(F.lit(1)).alias("incoming"), F.countDistinct("content_block_id").alias("known"))


@query("""WITH e AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND doc_id % 2 = 0), i AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN text || '.' ELSE text END AS text FROM documents WHERE text IS NOT NULL)
    SELECT i.doc_id, CASE WHEN e.doc_id IS NULL THEN 'created' WHEN e.text = i.text THEN 'skipped' ELSE 'conflict' END AS action FROM i LEFT JOIN e USING (doc_id)""")
def seed_conflicts(spark, sf):
    docs = table(spark, sf, "documents").filter("text is not null").select("doc_id", "text")
    changed = docs.withColumn("text", F.when(F.col("doc_id") % 6 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")))
    return corpus.seed(docs.filter("doc_id % 2 = 0"), changed, ["doc_id"], "text").select("doc_id", "action")


def _chunks_sql(most: int, overlap: int) -> str:
    """A chunk is a range of paragraphs; the walk keeps where the open one begins."""
    return f"""WITH RECURSIVE l AS (SELECT doc_id, lang, page_number, i, string_split(text, chr(10))[i] AS line FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i) WHERE text IS NOT NULL),
    w AS (SELECT CAST(doc_id AS VARCHAR) AS source, page_number AS page, doc_id || '-' || i AS block_id, CAST(greatest(1, ceil(length(line) / CASE WHEN lang IN ('ar', 'ur') THEN 3.0 ELSE 4.0 END)) AS BIGINT) AS tokens, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM l WHERE trim(line) <> ''),
    u AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY k) AS run, sum(tokens) OVER (PARTITION BY source ORDER BY k) - tokens AS before FROM w),
    s AS (SELECT source, k, CAST(1 AS BIGINT) AS start, CAST(0 AS BIGINT) AS c FROM u WHERE k = 1 UNION ALL
        SELECT x.source, x.k, CASE WHEN NOT x.full THEN x.start WHEN x.tokens > {most} THEN x.k ELSE coalesce(CASE WHEN x.tail IS NOT NULL AND x.run - t.before + 2 * (x.k - t.k) <= {most} THEN t.k END, x.k) END, CASE WHEN x.full THEN x.c + 1 ELSE x.c END
        FROM (SELECT u.source, u.k, u.tokens, u.run, s.start, s.c, (u.tokens > {most} OR u.before - b.before + 2 * (s.k - s.start) + u.tokens + 2 > {most}) AS full, (SELECT min(v.k) FROM u v WHERE v.source = u.source AND v.k >= s.start AND v.k < u.k AND u.before - v.before <= {overlap}) AS tail
            FROM s JOIN u ON u.source = s.source AND u.k = s.k + 1 JOIN u b ON b.source = s.source AND b.k = s.start) x LEFT JOIN u t ON t.source = x.source AND t.k = x.tail),
    r AS (SELECT source, c, min(start) AS start, max(k) AS stop FROM s GROUP BY ALL)
    SELECT r.source, CAST(NULL AS INTEGER) AS chapter_no, CAST(NULL AS INTEGER) AS section_no, min(u.page) AS page_start, max(u.page) AS page_end, CAST(sum(u.tokens) + 2 * (count(*) - 1) AS BIGINT) AS token_count, list(u.block_id ORDER BY u.k) AS block_ids, r.c AS chunk_index,
        sha256(r.source || ':0:0:' || coalesce(min(u.page), 0) || ':' || r.c) AS chunk_id FROM r JOIN u ON u.source = r.source AND u.k BETWEEN r.start AND r.stop GROUP BY r.source, r.c"""


@query(_chunks_sql(256, 0))
def chunk_greedy(spark, sf):
    units = chunking.paragraphs(table(spark, sf, "documents"), source="doc_id", text="text", language="lang", page="page_number")
    return chunking.build_chunks(units, chunking.ChunkConfig(256, 0)).drop("text")


@query(_chunks_sql(256, 64))
def chunk_overlap(spark, sf):
    units = chunking.paragraphs(table(spark, sf, "documents"), source="doc_id", text="text", language="lang", page="page_number")
    return chunking.build_chunks(units, chunking.ChunkConfig(256, 64)).drop("text")


@query(f"""SELECT chunk_id, sha256(concat_ws(':', source_file_id, coalesce(metadata.chapter_no, 0), coalesce(metadata.section_no, 0), coalesce(page_start, 0), sequence)) AS stable_id FROM {CHUNKS}""")
def chunk_ids(spark, sf):
    c = chunks(spark, sf)
    return c.select("chunk_id", chunking.chunk_id(F.col("source_file_id"), F.col("metadata.chapter_no"), F.col("metadata.section_no"), F.col("page_start"), F.col("sequence")).alias("stable_id"))


@query(f"""SELECT book_id, count(*) AS n_chunks, CAST(sum(token_count) AS BIGINT) AS tokens, round(avg(token_count), 1) AS mean_tokens, round(avg(page_end - page_start + 1), 4) AS pages_per_chunk, min(page_start) AS first_page, max(page_end) AS last_page FROM {CHUNKS} GROUP BY book_id""")
def chunk_stats(spark, sf):
    return chunks(spark, sf).groupBy("book_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("token_count").alias("tokens"), F.round(F.avg("token_count"), 1).alias("mean_tokens"), F.round(F.avg(F.col("page_end") - F.col("page_start") + 1), 4).alias("pages_per_chunk"), F.min("page_start").alias("first_page"), F.max("page_end").alias("last_page"))


@query(f"""WITH r AS (SELECT book_id, sequence, chunk_id, metadata.chapter_no AS c, metadata.section_no AS s, lag(metadata.chapter_no) OVER w AS pc, lag(metadata.section_no) OVER w AS ps, row_number() OVER w AS k FROM {CHUNKS} WINDOW w AS (PARTITION BY book_id ORDER BY sequence, chunk_id))
    SELECT book_id, chunk_id, CAST(sum(CASE WHEN k > 1 AND (c IS DISTINCT FROM pc OR s IS DISTINCT FROM ps) THEN 1 ELSE 0 END) OVER (PARTITION BY book_id ORDER BY sequence, chunk_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS section_run FROM r""")
def section_runs(spark, sf):
    w = Window.partitionBy("book_id").orderBy("sequence", "chunk_id")
    here = F.struct("metadata.chapter_no", "metadata.section_no")
    rows = chunks(spark, sf).withColumn("_c", F.when(F.row_number().over(w) > 1, (~here.eqNullSafe(F.lag(here).over(w))).cast("int")).otherwise(0))
    return rows.select("book_id", "chunk_id", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("section_run"))


@query(f"""SELECT r.book_id, r.chunk_count, c.n AS found, r.token_total, c.tokens AS found_tokens, r.token_total IS NOT DISTINCT FROM c.tokens AS fits FROM (SELECT DISTINCT book_id, chunk_count, token_total FROM chunk_results WHERE error IS NULL) r
    LEFT JOIN (SELECT book_id, count(*) AS n, CAST(sum(token_count) AS BIGINT) AS tokens FROM {CHUNKS} GROUP BY book_id) c USING (book_id)""")
def chunk_totals(spark, sf):
    r = table(spark, sf, "chunk_results").filter("error is null").select("book_id", "chunk_count", "token_total").distinct()
    c = chunks(spark, sf).groupBy("book_id").agg(F.count(F.lit(1)).alias("found"), F.sum("token_count").alias("found_tokens"))
    return r.join(c, "book_id", "left").select("book_id", "chunk_count", "found", "token_total", "found_tokens", F.col("token_total").eqNullSafe(F.col("found_tokens")).alias("fits"))


@query("""WITH n AS (SELECT DISTINCT value AS name FROM metadata_candidates WHERE field = 'publisher' AND value IS NOT NULL), e AS (SELECT trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-')[:64] AS code, min(name) AS name FROM n WHERE lower(name) < 'm' GROUP BY 1 HAVING code <> ''),
    w AS (SELECT name, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-')[:64] AS slug FROM n WHERE name NOT IN (SELECT name FROM e)), c AS (SELECT CASE WHEN slug <> '' THEN slug ELSE name END AS code, name FROM w)
    SELECT code, name FROM e UNION ALL SELECT code, min(name) FROM c WHERE code NOT IN (SELECT code FROM e) GROUP BY code""")
def category_dimension(spark, sf):
    names = _facts(spark, sf).filter("field = 'publisher' and value is not null").select(F.col("value").alias("name")).distinct()
    old = names.filter("lower(name) < 'm'").groupBy(tx.slug(F.col("name")).alias("code")).agg(F.min("name").alias("name")).filter("code <> ''")
    return corpus.get_or_create_category(old, names)


@query("""WITH o AS (SELECT DISTINCT id, source_file_id, field, value, uncertain, status, source FROM metadata_candidates), n AS (SELECT id, source_file_id, field, value, false AS uncertain, source FROM o WHERE ascii(right(id, 1)) % 3 <> 0)
    SELECT n.id, n.uncertain OR coalesce(p.uncertain, false) AS uncertain, coalesce(p.status, CASE WHEN n.source = 'user_provided' THEN 'approved' ELSE 'review' END) AS status FROM n LEFT JOIN (SELECT * FROM o WHERE ascii(right(id, 1)) % 2 = 0) p ON n.id = p.id""")
def stale_candidates(spark, sf):
    """A second extraction that misses some facts and finds others anew."""
    rows = table(spark, sf, "metadata_candidates").select("id", "source_file_id", "field", "value", "uncertain", "status", "source").distinct()
    last = F.ascii(F.right("id", F.lit(1)))
    new = rows.filter(last % 3 != 0).drop("status").withColumn("uncertain", F.lit(False))
    return corpus.upsert_candidates(rows.filter(last % 2 == 0), new, ["id"]).select("id", "uncertain", "status")


@query(f"""WITH d AS (SELECT source_file_id, CASE ascii(right(source_file_id, 1)) % 3 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' ELSE 'correct' END AS action FROM (SELECT DISTINCT source_file_id FROM metadata_candidates))
    SELECT b.source_file_id, b.field, CASE WHEN b.field = 'title' AND action = 'correct' THEN 'mended' ELSE b.value END AS value, CASE WHEN b.field <> 'title' THEN b.status WHEN action = 'reject' THEN 'rejected' ELSE 'approved' END AS status FROM {_BEST} b JOIN d USING (source_file_id)""")
def review_decisions(spark, sf):
    best = corpus.merge_candidates(_facts(spark, sf))
    what = F.element_at(F.array(*map(F.lit, ["approve", "reject", "correct"])), (F.ascii(F.right("source_file_id", F.lit(1))) % 3 + 1).cast("int"))
    decisions = best.select("source_file_id").distinct().select("source_file_id", F.lit("title").alias("field"), what.alias("action"), F.lit("mended").alias("new_value"))
    return corpus.apply_decisions(best, decisions).select("source_file_id", "field", "value", "status")


@query("""SELECT id, 'title' AS field, title AS value, 'high' AS confidence FROM (SELECT DISTINCT id, trim(title) AS title FROM books) WHERE title <> '' UNION ALL SELECT id, 'description', subtitle, 'medium' FROM (SELECT DISTINCT id, trim(subtitle) AS subtitle FROM books) WHERE subtitle <> ''""")
def document_info(spark, sf):
    info = table(spark, sf, "books").select("id", "title", F.lit("").alias("author"), F.col("subtitle").alias("subject")).distinct()
    return corpus.unpivot_info(info, "id")


@query("""SELECT doc_id, CAST(sum(c) AS DOUBLE) / count(*) AS confidence FROM (SELECT doc_id, (length(w) * 17) % 101 AS c FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM documents WHERE text IS NOT NULL)) WHERE c >= 0 GROUP BY doc_id""")
def ocr_word_confidence(spark, sf):
    """As if every word had been recognised with a confidence by its length."""
    words = table(spark, sf, "documents").select("doc_id", F.explode(tx.tokens(F.col("text"))).alias("word"))
    return corpus.word_confidence(words.withColumn("confidence", ((F.length("word") * 17) % 101).cast("double")), ["doc_id"])


@query("""WITH p AS (SELECT book_id AS file, CASE WHEN doc_id % 4 = 0 THEN 'failed' WHEN doc_id % 4 = 1 THEN 'review' ELSE 'ok' END AS status, CASE WHEN doc_id % 4 <> 0 THEN CAST(doc_id % 100 AS DOUBLE) END AS confidence FROM documents WHERE book_id IS NOT NULL)
    SELECT file, count(*) FILTER (status = 'ok') AS ocr, count(*) FILTER (status = 'review') AS review, count(*) FILTER (status = 'failed') AS failed, round(avg(confidence), 4) AS mean_confidence FROM p GROUP BY file""")
def ocr_rollup(spark, sf):
    d = F.col("doc_id") % 4
    p = table(spark, sf, "documents").filter("book_id is not null").select(F.col("book_id").alias("file"), F.when(d == 0, "failed").when(d == 1, "review").otherwise("ok").alias("status"), F.when(d != 0, (F.col("doc_id") % 100).cast("double")).alias("confidence"))
    return corpus.ocr_rollup(p)
