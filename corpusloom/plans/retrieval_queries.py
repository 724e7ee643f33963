"""Queries of search, vectors, fusion and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import answering, fulltext, library, operations, vectors
from corpusloom.plans.registry import query
from corpusloom.plans.text_queries import SPACES, TOKENS
from corpusloom.session import table


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The latest row of every chunk_id, of equal times the greater id."""
    rows = table(spark, sf, "content_chunks")
    names = [c for c in rows.columns if c != "chunk_id"]
    last = rows.groupBy("chunk_id").agg(F.max_by(F.struct(*names), F.struct("updated_at", "id")).alias("r"))
    return last.select("chunk_id", "r.*")


CHUNKS = "(SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY updated_at DESC, id DESC) k FROM content_chunks) WHERE k = 1)"


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").filter("text is not null").select("doc_id", "lang", "source", "text")


_DOCS = f"(SELECT doc_id, lang, source, text, {TOKENS.format('text')} AS tokens, ' ' || array_to_string({TOKENS.format('text')}, ' ') || ' ' AS padded FROM documents WHERE text IS NOT NULL)"


def _hit(*words: str) -> str:
    return f"contains(padded, ' {' '.join(words)} ')"


def _tf(*words: str) -> str:
    return f"round(len(list_filter(tokens, lambda t: t IN ({', '.join(repr(w) for w in words)}))) * 0.1, 6)"


def _excerpt_sql(words: list[str], text: str = "text") -> str:
    at = f"coalesce(least({', '.join(f'nullif(instr(lower({text}), {w!r}), 0)' for w in words)}), 1)"
    start = f"greatest(1, {at} - 90)"
    return f"CASE WHEN {start} > 1 THEN '…' ELSE '' END || substring({text}, {start}, 270) || CASE WHEN {start} + 269 < length({text}) THEN '…' ELSE '' END"


@query(f"""SELECT doc_id, lang, source, {_tf('treasurer', 'lamps')} AS rank, {_excerpt_sql(['treasurer', 'lamps'])} AS snippet, source || ' #' || doc_id AS citation
    FROM {_DOCS} WHERE {_hit('treasurer')} OR {_hit('lamps')} ORDER BY rank DESC, doc_id LIMIT 20""")
def fts_any_terms(spark, sf):
    q = fulltext.parse_query("treasurer lamps")
    hits = fulltext.search(_docs(spark, sf), q, text=F.col("text"), keys=["doc_id"])
    return hits.select("doc_id", "lang", "source", "rank", fulltext.excerpt(F.col("text"), ["treasurer", "lamps"]).alias("snippet"), F.concat("source", F.lit(" #"), F.col("doc_id").cast("string")).alias("citation"))


@query(f"SELECT doc_id, {_tf('copyist', 'sealed')} AS rank FROM {_DOCS} WHERE {_hit('copyist')} AND {_hit('sealed')}")
def fts_all_terms(spark, sf):
    q = fulltext.parse_query("copyist sealed", every=True)
    return fulltext.matching(_docs(spark, sf), q, F.col("text")).select("doc_id", F.round(fulltext.term_rank(q), 6).alias("rank"))


@query(f"SELECT doc_id, {_tf('the', 'care', 'of', 'books')} AS rank FROM {_DOCS} WHERE {_hit('the', 'care', 'of', 'books')}")
def fts_phrase(spark, sf):
    q = fulltext.parse_query('"the care of books"')
    return fulltext.matching(_docs(spark, sf), q, F.col("text")).select("doc_id", F.round(fulltext.term_rank(q), 6).alias("rank"))


@query(f"SELECT doc_id FROM {_DOCS} WHERE {_hit('the', 'price', 'of')} AND ({_hit('judge')} OR {_hit('scribe')}) AND NOT {_hit('water')}")
def fts_exclude(spark, sf):
    q = fulltext.parse_query('"the price of" judge scribe -water')
    return fulltext.matching(_docs(spark, sf), q, F.col("text")).select("doc_id")


@query(f"""WITH t AS (SELECT doc_id, u.t AS t, u.i AS i FROM (SELECT doc_id, unnest(list_transform(range(1, len(tokens) + 1), lambda i: {{'t': tokens[i], 'i': i}})) AS u FROM {_DOCS} WHERE {_hit('scribe')} AND {_hit('ledger')})),
    l AS (SELECT doc_id, t, i, max(CASE WHEN t = 'scribe' THEN i END) OVER w AS a, max(CASE WHEN t = 'ledger' THEN i END) OVER w AS b FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
    c AS (SELECT doc_id, least(a, b) AS s, min(i) AS e FROM l WHERE a IS NOT NULL AND b IS NOT NULL AND t IN ('scribe', 'ledger') GROUP BY doc_id, least(a, b)),
    n AS (SELECT c.doc_id, c.s, c.e, count(*) AS words FROM c JOIN t ON t.doc_id = c.doc_id AND t.i BETWEEN c.s AND c.e AND t.t IN ('scribe', 'ledger') GROUP BY ALL)
    SELECT doc_id, round(sum(0.1 / (1 + (e - s) - (words - 1))), 6) AS rank FROM n GROUP BY doc_id""")
def fts_cover_and(spark, sf):
    q = fulltext.parse_query("scribe ledger", every=True)
    return fulltext.matching(_docs(spark, sf), q, F.col("text")).select("doc_id", F.round(fulltext.cover_rank(q), 6).alias("rank"))


@query(f"""SELECT chunk_id, book_id, title, category_id, rank, page FROM (
    SELECT c.chunk_id, c.book_id, b.title, b.category_id, round(len(list_filter({TOKENS.format('c.text')}, lambda t: t IN ('merchant', 'salt'))) * 0.1, 6) AS rank, coalesce(nullif(c.page_start, 0), c.page_end) AS page, ' ' || array_to_string({TOKENS.format('c.text')}, ' ') || ' ' AS padded
    FROM {CHUNKS} c JOIN (SELECT DISTINCT id, title, category_id FROM books) b ON c.book_id = b.id WHERE c.language = 'en')
    WHERE {_hit('merchant')} OR {_hit('salt')} ORDER BY rank DESC, chunk_id LIMIT 50""")
def content_search(spark, sf):
    q = fulltext.parse_query("merchant salt")
    books = table(spark, sf, "books").select(F.col("id").alias("book_id"), "title", "category_id").distinct()
    rows = chunks(spark, sf).filter("language = 'en'")
    hits = fulltext.search(rows, q, text=F.col("text"), keys=["chunk_id"], limit=50)
    return hits.join(books, "book_id").select("chunk_id", "book_id", "title", "category_id", "rank", F.coalesce(F.nullif(F.col("page_start"), F.lit(0)), F.col("page_end")).alias("page"))


@query(f"SELECT doc_id, {_excerpt_sql(['scribe', 'gate'])} AS excerpt, regexp_replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '(scribe|gate)', '<mark>\\1</mark>', 'gi') AS marked FROM {_DOCS} WHERE {_hit('scribe')} OR {_hit('gate')}")
def highlight_terms(spark, sf):
    q = fulltext.parse_query("scribe gate")
    t = F.col("text")
    return fulltext.matching(_docs(spark, sf), q, t).select("doc_id", fulltext.excerpt(t, ["scribe", "gate"]).alias("excerpt"), fulltext.highlight(t, ["scribe", "gate"]).alias("marked"))


def _grams(c: str) -> str:
    words = TOKENS.format(c)
    return f"list_distinct(flatten(list_transform({words}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"


def _similar(a: str, b: str) -> str:
    x, y = _grams(a), _grams(b)
    every = f"len(list_distinct(list_concat({x}, {y})))"
    return f"CASE WHEN {every} > 0 THEN len(list_intersect({x}, {y})) / {every} ELSE 0.0 END"


@query(f"SELECT id, title, round(greatest({_similar('title', repr('care of letters'))}, {_similar('subtitle', repr('care of letters'))}), 6) AS rank FROM (SELECT DISTINCT id, title, subtitle FROM books) WHERE contains(lower(title), 'care of') OR contains(lower(coalesce(subtitle, '')), 'care of')")
def catalog_trigram(spark, sf):
    books = table(spark, sf, "books").select("id", "title", "subtitle").distinct()
    q = F.lit("care of letters")
    rows = books.filter(F.lower("title").contains("care of") | F.lower(F.coalesce("subtitle", F.lit(""))).contains("care of"))
    return rows.select("id", "title", F.round(F.greatest(tx.similarity(F.col("title"), q), tx.similarity(F.col("subtitle"), q)), 6).alias("rank"))


@query(f"""SELECT domain, key, rank FROM (
    (SELECT 'content' AS domain, 0 AS o, CAST(doc_id AS VARCHAR) AS key, {_tf('scribe')} AS rank FROM {_DOCS} WHERE {_hit('scribe')} ORDER BY rank DESC, key LIMIT 10)
    UNION ALL (SELECT 'book', 1, id, round({_similar('title', repr('scribe'))}, 6) AS rank FROM (SELECT DISTINCT id, title FROM books) WHERE contains(lower(title), 'scribe') ORDER BY rank DESC, id LIMIT 10)
    UNION ALL (SELECT 'part', 2, CAST(p_partkey AS VARCHAR), round({_similar('p_name', repr('red'))}, 6) AS rank FROM part WHERE contains(lower(p_name), 'red') ORDER BY rank DESC, CAST(p_partkey AS VARCHAR) LIMIT 10)
    ) ORDER BY rank DESC, o, key LIMIT 15""")
def search_multi_domain(spark, sf):
    q = fulltext.parse_query("scribe")
    docs = _docs(spark, sf).withColumn("key", F.col("doc_id").cast("string"))
    content = fulltext.search(docs, q, text=F.col("text"), keys=["key"], limit=10).select(F.lit("content").alias("domain"), F.lit(0).alias("o"), "key", "rank")

    def catalog(df: DataFrame, domain: str, o: int, key: str, name: str, ask: str) -> DataFrame:
        hits = df.filter(F.lower(name).contains(ask)).select(F.lit(domain).alias("domain"), F.lit(o).alias("o"), F.col(key).cast("string").alias("key"), F.round(tx.similarity(F.col(name), F.lit(ask)), 6).alias("rank"))
        return hits.orderBy(F.desc("rank"), "key").limit(10)

    books = catalog(table(spark, sf, "books").select("id", "title").distinct(), "book", 1, "id", "title", "scribe")
    parts = catalog(table(spark, sf, "part"), "part", 2, "p_partkey", "p_name", "red")
    return content.unionByName(books).unionByName(parts).orderBy(F.desc("rank"), "o", "key").limit(15).drop("o")


@query("""SELECT hit_id, domain, rank FROM (SELECT DISTINCT hit_id, domain, rank, language, author, category, source_file_id FROM search_hits)
    WHERE category = 'fiqh' AND lower(coalesce(language, '')) IN ('en', 'eng', 'english') AND author ILIKE '%al-%' AND starts_with(source_file_id, 'sf-000000')""")
def scope_filters(spark, sf):
    hits = table(spark, sf, "search_hits").select("hit_id", "domain", "rank", "language", "author", "category", "source_file_id").distinct()
    return library.scope(hits, language="en", alias=True, category="fiqh", author="al-", sha="sf-000000", columns={"sha": "source_file_id"}).select("hit_id", "domain", "rank")


@query("""SELECT query_id, domain, hit_id, rank, position FROM (SELECT query_id, domain, hit_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC, domain, hit_id) AS position FROM (SELECT DISTINCT query_id, domain, hit_id, rank FROM search_hits)) WHERE position <= 3""")
def merged_hits(spark, sf):
    return library.merged_hits(table(spark, sf, "search_hits").select("query_id", "domain", "hit_id", "rank").distinct(), "query_id", 3)


def _asked(spark: SparkSession, sf: str) -> list[float]:
    return table(spark, sf, "embeddings").filter("vec_id = 0").select("embedding").first()[0]


_KNN = "SELECT e.vec_id, e.label, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"


@query(f"SELECT vec_id, score FROM ({_KNN}) ORDER BY score DESC, vec_id LIMIT 10")
def knn_cosine(spark, sf):
    return vectors.nearest(table(spark, sf, "embeddings"), _asked(spark, sf), column="embedding", key="vec_id", k=10).select("vec_id", "score")


@query(f"SELECT vec_id, score FROM ({_KNN}) WHERE label = 3 ORDER BY score DESC, vec_id LIMIT 10")
def knn_filtered(spark, sf):
    return vectors.nearest(table(spark, sf, "embeddings").filter("label = 3"), _asked(spark, sf), column="embedding", key="vec_id", k=10).select("vec_id", "score")


@query(f"SELECT vec_id, score FROM (SELECT * FROM ({_KNN}) ORDER BY score DESC, vec_id LIMIT 10) WHERE score >= 0.3")
def knn_min_score_after_limit(spark, sf):
    return vectors.nearest(table(spark, sf, "embeddings"), _asked(spark, sf), column="embedding", key="vec_id", k=10, min_score=0.3).select("vec_id", "score")


@query("""WITH t AS (SELECT item_id, lower(text) AS t FROM eval_items), g AS (SELECT item_id, sha256(substring(t, i, 3)) AS h FROM t, LATERAL (SELECT unnest(range(1, length(t) - 1)) AS i)),
    b AS (SELECT item_id, CAST(('0x' || substring(h, 1, 16))::UBIGINT % 64 AS INTEGER) AS bucket, CASE WHEN ('0x' || substring(h, 17, 2))::INTEGER % 2 = 1 THEN 1 ELSE -1 END AS s FROM g),
    v AS (SELECT item_id, bucket, sum(s) AS x FROM b GROUP BY ALL), n AS (SELECT item_id, sqrt(sum(x * x)) AS n FROM v GROUP BY item_id)
    SELECT v.item_id, bucket, round(x / n, 5) AS x FROM v JOIN n USING (item_id) WHERE x <> 0""")
def hash_embed(spark, sf):
    made = vectors.embed(table(spark, sf, "eval_items").select("item_id", "text"), text="text")
    cells = made.select("item_id", F.posexplode("vector").alias("bucket", "x"))
    return cells.filter("x <> 0").select("item_id", "bucket", F.round(F.col("x").cast("double"), 5).alias("x"))


_FUSE = """WITH h AS (SELECT query_id, chunk_id, max(fts_score) AS f, max(vector_score) AS v FROM hybrid_hits GROUP BY ALL), k AS (SELECT *, max(f) OVER (PARTITION BY query_id) AS most FROM h)
    SELECT query_id, chunk_id, round(CASE WHEN most > 0 THEN f / most WHEN f IS NOT NULL THEN 0 END, 6) AS fts, round(v, 6) AS vec, round({wf} * coalesce(CASE WHEN most > 0 THEN f / most END, 0) + {wv} * coalesce(v, 0), 9) AS score,
    concat_ws('+', CASE WHEN f IS NOT NULL THEN 'fts' END, CASE WHEN v IS NOT NULL THEN 'vector' END) AS retrievers FROM k WHERE f IS NOT NULL OR v IS NOT NULL"""


def _fused(spark: SparkSession, sf: str, wf: float, wv: float) -> DataFrame:
    h = table(spark, sf, "hybrid_hits")
    return vectors.fuse(h.filter("fts_score is not null").withColumn("rank", F.col("fts_score")), h.filter("vector_score is not null").drop("score").withColumnRenamed("vector_score", "score"), on=["query_id", "chunk_id"], weight_fts=wf, weight_vector=wv)


@query(f"""SELECT query_id, chunk_id, score, retrievers, book_id, language, page FROM (SELECT f.*, p.book_id, p.language, p.page, row_number() OVER (PARTITION BY f.query_id ORDER BY score DESC, f.chunk_id) AS k FROM ({_FUSE.format(wf=0.5, wv=0.5)}) f
    JOIN (SELECT query_id, chunk_id, max(book_id) AS book_id, max(language) AS language, max(page) AS page FROM hybrid_hits GROUP BY ALL) p ON f.query_id = p.query_id AND f.chunk_id = p.chunk_id WHERE score >= 0.2) WHERE k <= 20""")
def hybrid_top(spark, sf):
    """The best twenty of each query with where they stand, from whichever path knows it."""
    h = table(spark, sf, "hybrid_hits").withColumn("rank", F.col("fts_score"))
    near = h.drop("score", "rank").withColumnRenamed("vector_score", "score").filter("score is not null")
    top = vectors.fuse(h.drop("score").filter("rank is not null"), near, on=["query_id", "chunk_id"], k=20, min_score=0.2, fields=("book_id", "language", "page"))
    return top.select("query_id", "chunk_id", "score", "retrievers", "book_id", "language", "page")


@query(_FUSE.format(wf=0.5, wv=0.5))
def hybrid_fuse(spark, sf):
    return _fused(spark, sf, 0.5, 0.5)


@query("WITH h AS (SELECT query_id, chunk_id, max(fts_score) AS f FROM hybrid_hits WHERE fts_score IS NOT NULL GROUP BY ALL), k AS (SELECT *, max(f) OVER (PARTITION BY query_id) AS most FROM h) SELECT query_id, chunk_id, round(CASE WHEN most > 0 THEN f / most ELSE 0 END, 6) AS fts, CAST(NULL AS DOUBLE) AS vec, round(CASE WHEN most > 0 THEN f / most ELSE 0 END, 9) AS score, 'fts' AS retrievers FROM k")
def hybrid_keyword_only(spark, sf):
    return _fused(spark, sf, 1.0, 0.0)


@query("""WITH m AS (SELECT chunk_id, content_hash, row_number() OVER (PARTITION BY chunk_id ORDER BY updated_at DESC, id DESC) AS k FROM chunk_vectors WHERE model_name = 'hash-grams')
    SELECT c.chunk_id, substring(c.chunk_id, 1, 16) AS content_hash, CASE WHEN m.chunk_id IS NULL THEN 'new' WHEN m.content_hash = substring(c.chunk_id, 1, 16) THEN 'reused' ELSE 'updated' END AS action
    FROM (SELECT DISTINCT chunk_id FROM content_chunks) c LEFT JOIN m ON c.chunk_id = m.chunk_id AND m.k = 1""")
def embed_incremental_plan(spark, sf):
    old = table(spark, sf, "chunk_vectors").filter("model_name = 'hash-grams'").groupBy("chunk_id").agg(F.max_by("content_hash", F.struct("updated_at", "id")).alias("content_hash"))
    now = table(spark, sf, "content_chunks").select("chunk_id").distinct().withColumn("content_hash", F.substring("chunk_id", 1, 16))
    return vectors.embedding_plan(now, old)


@query("SELECT model_name, max(model_version) AS model_version FROM chunk_vectors GROUP BY model_name")
def latest_model(spark, sf):
    return vectors.latest_version(table(spark, sf, "chunk_vectors"), model="model_name", version="model_version")


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    h = table(spark, sf, "hybrid_hits").groupBy("query_id", "chunk_id").agg(F.max("vector_score").alias("score"), F.max("text").alias("text"))
    return answering.retrieve(h.filter("score is not null"), answering.AnswerConfig(k=6, min_score=0.4), ["query_id"])


_SOURCES = "SELECT * FROM (SELECT query_id, chunk_id, score, text, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS source_no FROM (SELECT query_id, chunk_id, max(vector_score) AS score, max(text) AS text FROM hybrid_hits GROUP BY ALL) WHERE score >= 0.4 AND trim(coalesce(text, '')) <> '') WHERE source_no <= 6"


@query(f"SELECT query_id, chunk_id, round(score, 6) AS score, source_no FROM ({_SOURCES})")
def rag_retrieve(spark, sf):
    return _sources(spark, sf).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "source_no")


_SQUEEZED = "trim(regexp_replace(CASE WHEN length(text) > 2000 THEN left(text, 2000) || '…' ELSE text END, '[" + SPACES + "]+', ' ', 'g'))"


@query(f"""SELECT query_id, string_agg('[S' || source_no || '] ' || {_SQUEEZED}, chr(10) ORDER BY source_no) || chr(10) || chr(10) || 'The above excerpts (from ' || string_agg('[S' || source_no || ']', ', ' ORDER BY source_no) || ') are the retrieved support for the question.' AS answer
    FROM ({_SOURCES}) WHERE source_no <= 3 GROUP BY query_id""")
def extractive_answer(spark, sf):
    return answering.extractive_answer(_sources(spark, sf), ["query_id"])


_MARKS = r"list_transform(regexp_extract_all(answer, '\[S(\d+)\]', 1), lambda m: CAST(m AS INTEGER))"
_SENTENCES = r"list_filter(string_split(regexp_replace(answer, '([.!?。「」])[" + SPACES + r"]+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_matches(s, '[^" + SPACES + "]'))"


@query(f"""WITH a AS (SELECT query_id, string_agg('[S' || source_no || '] ' || {_SQUEEZED}, chr(10) ORDER BY source_no) || chr(10) || chr(10) || 'The above excerpts (from ' || string_agg('[S' || source_no || ']', ', ' ORDER BY source_no) || ') are the retrieved support for the question.' AS answer
    FROM ({_SOURCES}) WHERE source_no <= 3 GROUP BY query_id),
    g AS (SELECT query_id, {_MARKS} AS marks, {_SENTENCES} AS sentences FROM a),
    n AS (SELECT query_id, len(marks) AS n, list_sort(list_distinct(list_filter(marks, lambda m: m <= 0 OR m > 2))) AS outside, len(sentences) AS every, len(list_filter(sentences, lambda s: regexp_matches(s, '\\[S[0-9]+\\]'))) AS marked FROM g),
    t AS (SELECT query_id, CASE WHEN n = 0 THEN 'answer cites no sources' ELSE coalesce(nullif(concat_ws('; ', CASE WHEN len(outside) > 0 THEN 'markers out of range: [' || array_to_string(outside, ', ') || ']' END,
        CASE WHEN every > 0 AND marked / every < 0.6 THEN 'only ' || marked || '/' || every || ' sentences carry a citation' END), ''), 'all claims are cited') END AS note FROM n)
    SELECT query_id, note = 'all claims are cited' AS grounded, note FROM t""")
def grounding_verdict(spark, sf):
    """As if two sources had been given, so that a third mark is out of range."""
    answers = answering.extractive_answer(_sources(spark, sf), ["query_id"])
    return answers.select("query_id", answering.grounding(F.col("answer"), F.lit(2)).alias("g")).select("query_id", "g.grounded", "g.note")


@query("""SELECT DISTINCT hit_id, CASE WHEN domain = 'quran' THEN coalesce(nullif(title, ''), '?') || ':' || coalesce(CAST(page AS VARCHAR), '?') || CASE WHEN coalesce(language, '') <> '' THEN ' (' || language || ' by ' || coalesce(nullif(author, ''), '?') || ')' ELSE '' END
    WHEN domain = 'hadith' THEN concat_ws(' ', coalesce(nullif(title, ''), 'collection'), '#' || page, nullif(category, ''))
    ELSE concat_ws(', ', coalesce(nullif(title, ''), book_id), 'ch. ' || nullif(category, ''), 'p. ' || page, nullif(chunk_id, '')) END AS reference FROM search_hits""")
def citations(spark, sf):
    """References of hits; the table has no verse, chapter or collection, so other columns stand in for these."""
    h = table(spark, sf, "search_hits")
    c = F.col
    ref = tx.citation(c("domain"), surah_name=c("title"), verse=c("page"), language=c("language"), translator=c("author"), collection=c("title"), number=c("page"), book=c("category"), title=c("title"), book_id=c("book_id"), chapter=c("category"), page=c("page"), chunk_id=c("chunk_id"))
    return h.select("hit_id", ref.alias("reference")).distinct()


@query(r"""SELECT DISTINCT hit_id, CASE WHEN regexp_matches(citation, '^[0-9]+:[0-9]+') THEN 'verse' WHEN regexp_matches(citation, '^.+ #[0-9]+$') THEN 'item' WHEN regexp_matches(citation, '^.+, p\. [0-9]+$') THEN 'page' END AS kind,
    CASE WHEN regexp_matches(citation, '^[0-9]+:[0-9]+') THEN regexp_extract(citation, '^([0-9]+):([0-9]+)', 1) WHEN regexp_matches(citation, '^.+ #[0-9]+$') THEN regexp_extract(citation, '^(.+) #([0-9]+)$', 1) WHEN regexp_matches(citation, '^.+, p\. [0-9]+$') THEN regexp_extract(citation, '^(.+), p\. ([0-9]+)$', 1) END AS first,
    CAST(CASE WHEN regexp_matches(citation, '^[0-9]+:[0-9]+') THEN regexp_extract(citation, '^([0-9]+):([0-9]+)', 2) WHEN regexp_matches(citation, '^.+ #[0-9]+$') THEN regexp_extract(citation, '^(.+) #([0-9]+)$', 2) WHEN regexp_matches(citation, '^.+, p\. [0-9]+$') THEN regexp_extract(citation, '^(.+), p\. ([0-9]+)$', 2) END AS INTEGER) AS second
    FROM search_hits WHERE citation IS NOT NULL""")
def citation_links(spark, sf):
    rows = table(spark, sf, "search_hits").filter("citation is not null").withColumn("c", answering.parse_citation(F.col("citation")))
    return rows.select("hit_id", "c.kind", "c.first", "c.second").distinct()


@query("""SELECT h.hit_id, coalesce(b.title, h.title) AS title, coalesce(b.category_id, h.category) AS category, h.page, h.book_id FROM (SELECT DISTINCT hit_id, title, category, page, book_id FROM search_hits) h LEFT JOIN (SELECT DISTINCT id, title, category_id FROM books) b ON h.book_id = b.id""")
def citation_rehydrate(spark, sf):
    h = table(spark, sf, "search_hits").select("hit_id", "title", "category", "page", "book_id").distinct()
    b = table(spark, sf, "books").select(F.col("id").alias("book_id"), "title", F.col("category_id").alias("category")).distinct()
    return answering.rehydrate(h, b, "book_id", ["title", "category"])


@query("""SELECT *, total > 20 AS has_more FROM (SELECT id, title, row_number() OVER (ORDER BY lower(title), id) AS position, (SELECT count(*) FROM (SELECT DISTINCT id, title FROM books WHERE language = 'en')) AS total FROM (SELECT DISTINCT id, title FROM books WHERE language = 'en')) WHERE position BETWEEN 11 AND 20""")
def browse_page(spark, sf):
    books = operations.browse(table(spark, sf, "books"), language="en", text=["title", "subtitle"]).select("id", "title").distinct()
    return operations.page_of(books, [F.lower("title"), F.col("id")], 2, 10).select("id", "title", F.col("position").cast("long").alias("position"), "total", "has_more")


@query("SELECT id, title FROM (SELECT DISTINCT id, title, subtitle, category_id FROM books) WHERE category_id = 'fiqh' AND contains(lower(concat_ws(' ', title, subtitle)), 'of')")
def browse_text(spark, sf):
    books = table(spark, sf, "books").withColumn("category", F.col("category_id"))
    return operations.browse(books, category="fiqh", contains="Of", text=["title", "subtitle"]).select("id", "title").distinct()


@query("""SELECT id, CASE WHEN contains(lower(title), 'the') OR contains(lower(title), 'of') THEN 30 ELSE 0 END + CASE WHEN contains(coalesce(lower(author), ''), 'the') THEN 20 ELSE 0 END + CASE WHEN contains(coalesce(lower(subtitle), ''), 'the') THEN 10 ELSE 0 END + 2 AS score
    FROM (SELECT b.id, b.title, b.subtitle, a.author FROM (SELECT DISTINCT id, title, subtitle, source_file_id FROM books) b LEFT JOIN (SELECT source_file_id, min(value) AS author FROM metadata_candidates WHERE field = 'author' GROUP BY 1) a USING (source_file_id))
    WHERE contains(lower(concat_ws(' ', title, author, subtitle)), 'the') AND contains(lower(concat_ws(' ', title, author, subtitle)), 'of')""")
def demo_scoring(spark, sf):
    terms = library.terms_of("The  of the")
    authors = table(spark, sf, "metadata_candidates").filter("field = 'author'").groupBy("source_file_id").agg(F.min("value").alias("author"))
    books = table(spark, sf, "books").select("id", "title", "subtitle", "source_file_id").distinct().join(authors, "source_file_id", "left")
    c = F.col
    return books.filter(library.all_terms(F.concat_ws(" ", "title", "author", "subtitle"), terms)).select("id", library.book_score(c("title"), c("author"), c("subtitle"), terms).alias("score"))


@query(f"""SELECT chunk_id, CASE WHEN coalesce(nullif(page_start, 0), page_end) <= 2 THEN 7 ELSE 6 END AS score FROM {CHUNKS} WHERE contains(lower(text), 'salt') AND contains(lower(text), 'well')""")
def demo_pages(spark, sf):
    rows = chunks(spark, sf).filter(library.all_terms(F.col("text"), library.terms_of("Salt well")))
    return rows.select("chunk_id", library.page_score(F.coalesce(F.nullif(F.col("page_start"), F.lit(0)), F.col("page_end"))).alias("score"))
