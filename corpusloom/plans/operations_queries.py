"""Queries of the ledger, dashboards, audits, review and export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import corpus, library, operations
from corpusloom.plans.registry import query
from corpusloom.plans.retrieval_queries import CHUNKS, chunks
from corpusloom.session import table

_TABLES = ["books", "content_chunks", "normalized_texts", "chunk_vectors", "metadata_candidates", "search_hits", "documents", "events"]


@query(" UNION ALL ".join(f"SELECT '{t}' AS entity, count(*) AS n FROM {t}" for t in _TABLES))
def dashboard_counts(spark, sf):
    return operations.counts({t: table(spark, sf, t) for t in _TABLES})


def _jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a ledger: who is the source, what the job, how high the value its outcome."""
    stage = F.element_at(F.array(*map(F.lit, operations.STAGES)), (F.col("event_id") % 10 + 1).cast("int"))
    status = F.when(F.col("value") < 10, "failed").when(F.col("value") < 20, "pending").when(F.col("value") < 30, "skipped").otherwise("succeeded")
    return table(spark, sf, "events").select(F.col("user_id").alias("source"), stage.alias("job_type"), status.alias("status"), F.col("event_id").alias("version"))


_JOBS = "(SELECT user_id AS source, list_extract(['" + "','".join(operations.STAGES) + "'], CAST(event_id % 10 + 1 AS INTEGER)) AS job_type, CASE WHEN value < 10 THEN 'failed' WHEN value < 20 THEN 'pending' WHEN value < 30 THEN 'skipped' ELSE 'succeeded' END AS status, event_id AS version FROM events)"
_LAST = f"(SELECT source, job_type, arg_max(status, version) AS status, max(version) AS version FROM {_JOBS} GROUP BY ALL)"


@query(f"SELECT status, count(*) AS n FROM {_JOBS} GROUP BY status")
def jobs_by_status(spark, sf):
    return _jobs(spark, sf).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT job_type, count(*) AS n FROM {_JOBS} WHERE status = 'succeeded' GROUP BY job_type")
def succeeded_by_type(spark, sf):
    return _jobs(spark, sf).filter("status = 'succeeded'").groupBy("job_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT source, job_type, status, version FROM {_LAST}")
def ledger_upsert(spark, sf):
    j = _jobs(spark, sf)
    return operations.upsert_ledger(j.filter("version % 2 = 0"), j.filter("version % 2 = 1"), ["source", "job_type"], "version")


@query(f"SELECT c_custkey AS source FROM customer c LEFT JOIN (SELECT source, bool_or(status IN ('failed', 'pending')) AS open FROM {_LAST} GROUP BY source) j ON c.c_custkey = j.source WHERE coalesce(open, true)")
def pending_sources(spark, sf):
    sources = table(spark, sf, "customer").select(F.col("c_custkey").alias("source"))
    none = _jobs(spark, sf).limit(0)
    return operations.pending(sources, operations.upsert_ledger(none, _jobs(spark, sf), ["source", "job_type"], "version"), "source")


_STATUS = f"(SELECT s.source, CAST(p.position AS INTEGER) AS position, p.stage, coalesce(l.status, 'pending') AS status FROM (SELECT DISTINCT source FROM {_JOBS}) s CROSS JOIN (SELECT unnest(range(0, 10)) AS position, unnest(['" + "','".join(operations.STAGES) + f"']) AS stage) p LEFT JOIN {_LAST} l ON l.source = s.source AND l.job_type = p.stage)"


@query(f"SELECT * FROM {_STATUS}")
def stage_status(spark, sf):
    return operations.stage_status(_jobs(spark, sf), "source")


@query(f"SELECT source, bool_and(status IN ('succeeded', 'skipped')) AS ok FROM {_STATUS} GROUP BY source")
def pipeline_verdict(spark, sf):
    return operations.verdict(operations.stage_status(_jobs(spark, sf), "source"), "source")


@query(f"SELECT source, arg_min(stage, position) AS next_stage FROM {_STATUS} WHERE status NOT IN ('succeeded', 'skipped') GROUP BY source")
def next_stage(spark, sf):
    return operations.runnable(operations.stage_status(_jobs(spark, sf), "source"), "source")


@query("SELECT c.category_id, count(b.id) AS n_books FROM (SELECT DISTINCT category_id FROM books) c LEFT JOIN (SELECT DISTINCT id, category_id FROM books) b ON c.category_id IS NOT DISTINCT FROM b.category_id GROUP BY c.category_id")
def category_stats(spark, sf):
    return table(spark, sf, "books").select("id", "category_id").distinct().groupBy("category_id").agg(F.count("id").alias("n_books"))


@query(f"SELECT language, status, count(*) AS n, CAST(sum(token_count) AS BIGINT) AS tokens, round(avg(token_count), 1) AS mean_tokens FROM {CHUNKS} GROUP BY ALL")
def token_stats(spark, sf):
    return chunks(spark, sf).groupBy("language", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("token_count").alias("tokens"), F.round(F.avg("token_count"), 1).alias("mean_tokens"))


def _audited(spark: SparkSession, sf: str) -> DataFrame:
    every = table(spark, sf, "content_chunks").select("book_id", "chunk_id")
    return operations.audit_books(table(spark, sf, "books").select(F.col("id").alias("book_id")), {"blocks": every, "chunks": every, "documents": table(spark, sf, "documents").filter("text is not null and book_id is not null"), "embeddings": table(spark, sf, "chunk_vectors").filter("model_name = 'dense-leaf'"), "normalized": table(spark, sf, "normalized_texts")})


@query("""WITH b AS (SELECT DISTINCT id AS book_id FROM books), k AS (SELECT book_id, (SELECT count(*) FROM content_chunks c WHERE c.book_id = b.book_id) AS c, (SELECT count(*) FROM documents d WHERE d.book_id = b.book_id AND d.text IS NOT NULL) AS d,
    (SELECT count(*) FROM chunk_vectors v WHERE v.book_id = b.book_id AND v.model_name = 'dense-leaf') AS v, (SELECT count(*) FROM normalized_texts n WHERE n.book_id = b.book_id) AS n FROM b),
    r AS (SELECT book_id, 'no_blocks' AS rule, 'critical' AS severity FROM k WHERE c = 0 UNION ALL SELECT book_id, 'no_chunks', 'critical' FROM k WHERE c = 0 UNION ALL SELECT book_id, 'not_indexed', 'warning' FROM k WHERE c > 0 AND d = 0
    UNION ALL SELECT book_id, 'not_embedded', 'warning' FROM k WHERE c > 0 AND v = 0 UNION ALL SELECT book_id, 'not_normalized', 'info' FROM k WHERE c > 0 AND n = 0)
    SELECT * FROM r UNION ALL SELECT NULL, 'all', 'ok' WHERE (SELECT count(*) FROM r) = 0""")
def audit_severity(spark, sf):
    return _audited(spark, sf)


@query("SELECT DISTINCT v.id, v.chunk_id FROM chunk_vectors v WHERE NOT EXISTS (SELECT 1 FROM content_chunks c WHERE c.chunk_id = v.chunk_id AND c.status = 'published')")
def audit_orphans(spark, sf):
    v = table(spark, sf, "chunk_vectors").select("id", "chunk_id").distinct()
    return operations.orphans(v, table(spark, sf, "content_chunks").filter("status = 'published'"), "chunk_id")


@query("SELECT chunk_id, count(*) AS n FROM content_chunks GROUP BY chunk_id HAVING count(*) > 1")
def audit_duplicates(spark, sf):
    return operations.duplicate_keys(table(spark, sf, "content_chunks"), ["chunk_id"])


@query("SELECT DISTINCT id FROM normalized_texts WHERE sha256(original_text) IS DISTINCT FROM original_sha256")
def audit_hashes(spark, sf):
    return operations.stale_hashes(table(spark, sf, "normalized_texts"), "original_text", "original_sha256").select("id").distinct()


@query(f"SELECT book_id, count(*) AS n_chunks FROM {CHUNKS} GROUP BY book_id")
def export_books(spark, sf):
    return operations.export_books(chunks(spark, sf)).groupBy("book_id").agg(F.count(F.lit(1)).alias("n_chunks"))


@query(f"SELECT book_id, sequence, chunk_id, text FROM {CHUNKS}")
def export_book_chunks(spark, sf):
    """The export itself, of which ``export_books`` is the count."""
    return operations.export_books(chunks(spark, sf))


@query("SELECT user_id, item, last_at, position FROM (SELECT user_id, item, last_at, row_number() OVER (PARTITION BY user_id ORDER BY last_at DESC, item) AS position FROM (SELECT user_id, lower(trim(event_type)) AS item, max(ts) AS last_at FROM events GROUP BY ALL)) WHERE position <= 8")
def history_dedupe(spark, sf):
    return operations.recent_distinct(table(spark, sf, "events"), "user_id", F.lower(F.trim("event_type")), "ts", 8).select("user_id", "item", "last_at", F.col("position").cast("long").alias("position"))


@query("SELECT user_id, arg_max(value, (ts, event_id)) AS value, max(ts) AS ts FROM events GROUP BY user_id ORDER BY ts DESC, user_id LIMIT 50")
def progress_latest(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.max("ts").alias("ts"))
    return e.orderBy(F.desc("ts"), "user_id").limit(50)


@query("SELECT status, review_note, count(*) AS n FROM (SELECT DISTINCT id, status, review_note FROM metadata_candidates WHERE status <> 'approved') GROUP BY ALL")
def review_queue(spark, sf):
    rows = table(spark, sf, "metadata_candidates").filter("status <> 'approved'").select("id", "status", "review_note").distinct()
    return rows.groupBy("status", "review_note").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT category_id, language, count(*) AS n FROM (SELECT DISTINCT id, category_id, language FROM books WHERE category_id IS NOT NULL AND language IS NOT NULL) GROUP BY CUBE (category_id, language)")
def books_cube(spark, sf):
    rows = table(spark, sf, "books").filter("category_id is not null and language is not null").select("id", "category_id", "language").distinct()
    return rows.cube("category_id", "language").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT book_id, title, book_id || '/' || coalesce(nullif(left(replace(title, ' ', '_'), 60), ''), left(book_id, 12)) || '.json' AS path FROM (SELECT DISTINCT id AS book_id, title FROM books)")
def export_paths(spark, sf):
    return operations.export_paths(table(spark, sf, "books").select(F.col("id").alias("book_id"), "title").distinct())


@query("SELECT id FROM (SELECT DISTINCT id, created_at FROM books) ORDER BY created_at, id LIMIT 25")
def batch_limit(spark, sf):
    return corpus.batch(table(spark, sf, "books").select("id", "created_at").distinct(), 25).select("id")


@query("SELECT o.o_orderkey AS id FROM orders o WHERE o.o_orderkey % 5 = 0 OR o.o_orderkey % 3 <> 0")
def text_layer(spark, sf):
    """Orders as files: those divisible by 5 were never inspected, of the others those divisible by 3 have no text."""
    files = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    jobs = files.filter("id % 5 <> 0").select("id", F.concat(F.lit('{"text_pages": '), F.when(F.col("id") % 3 == 0, "0").otherwise("4"), F.lit("}")).alias("manifest"))
    return library.text_layer(files, jobs, "id")


@query("SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS recent FROM events")
def calls_in_last_minute(spark, sf):
    return operations.recent_calls(table(spark, sf, "events"), "event_type").select("event_id", "recent")
