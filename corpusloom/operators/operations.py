"""Ledger, pending work, audits, statistics, review and catalog pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STAGES = ["inspect", "extract", "ocr", "metadata", "publish", "structure", "normalize", "chunk", "index", "embed"]


def upsert_ledger(ledger: DataFrame, events: DataFrame, key: list[str], version: str) -> DataFrame:
    """One row for each key, the one with the greatest version of both; equal versions: the new one."""
    rows = ledger.withColumn("_new", F.lit(0)).unionByName(events.withColumn("_new", F.lit(1)))
    names = [c for c in ledger.columns if c not in key]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*names), F.struct(version, "_new")).alias("_r"))
    return last.select(*key, *[F.col(f"_r.{c}").alias(c) for c in names])


def pending(sources: DataFrame, jobs: DataFrame, key: str) -> DataFrame:
    """Sources without any job, or with one that failed or waits."""
    state = jobs.groupBy(F.col(key).alias("_k")).agg(F.bool_or(F.col("status").isin("failed", "pending")).alias("_open"))
    return sources.join(state, sources[key] == F.col("_k"), "left").filter(F.coalesce("_open", F.lit(True))).drop("_k", "_open")


def stage_status(jobs: DataFrame, key: str) -> DataFrame:
    """Every source crossed with the plan of stages, and the state of each; missing ones are pending."""
    plan = F.explode(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(s).alias("stage")) for i, s in enumerate(STAGES)]))
    every = jobs.select(key).distinct().select(key, plan.alias("p")).select(key, "p.*")
    have = jobs.groupBy(F.col(key).alias("_k"), F.col("job_type").alias("_t")).agg(F.max_by("status", "version").alias("status"))
    out = every.join(have, (F.col(key) == F.col("_k")) & (F.col("stage") == F.col("_t")), "left")
    return out.select(key, "position", "stage", F.coalesce("status", F.lit("pending")).alias("status"))


def verdict(status: DataFrame, key: str) -> DataFrame:
    """Whether all stages of a source succeeded or were skipped."""
    return status.groupBy(key).agg(F.bool_and(F.col("status").isin("succeeded", "skipped")).alias("ok"))


def runnable(status: DataFrame, key: str, force: bool = False) -> DataFrame:
    """The next stage of each source: its first one not done; with ``force`` the first of all."""
    todo = status if force else status.filter(~F.col("status").isin("succeeded", "skipped"))
    return todo.groupBy(key).agg(F.min_by("stage", "position").alias("next_stage"))


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def orphans(child: DataFrame, parent: DataFrame, on: str, parent_key: str | None = None) -> DataFrame:
    keys = parent.select(F.col(parent_key or on).alias("_p")).distinct()
    return child.join(keys, child[on] == F.col("_p"), "left_anti")


def audit_books(books: DataFrame, counts: dict[str, DataFrame], key: str = "book_id") -> DataFrame:
    """``(key, rule, severity)``: what is missing for each book; a single ok row if nothing is.

    ``counts`` maps blocks, chunks, documents, embeddings and normalized to frames with a row per item.
    Each is aggregated by book before the join, so a book with a tenth of all rows costs one row.
    """
    out = books.select(key).distinct()
    for name, df in counts.items():
        n = df.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias(f"n_{name}"))
        out = out.join(n, out[key] == F.col("_k"), "left").drop("_k").fillna(0, [f"n_{name}"])

    def rule(name: str, severity: str, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity")))

    b, c = F.col("n_blocks"), F.col("n_chunks")
    rules = F.array_compact(F.array(rule("no_blocks", "critical", b == 0), rule("no_chunks", "critical", c == 0), rule("not_indexed", "warning", (b > 0) & (F.col("n_documents") == 0)), rule("not_embedded", "warning", (c > 0) & (F.col("n_embeddings") == 0)), rule("not_normalized", "info", (b > 0) & (F.col("n_normalized") == 0))))
    found = out.select(key, F.explode(rules).alias("r")).select(key, "r.*")
    fine = found.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(F.lit(None).cast("string").alias(key), F.lit("all").alias("rule"), F.lit("ok").alias("severity"))
    return found.unionByName(fine)


def stale_hashes(df: DataFrame, text: str, digest: str) -> DataFrame:
    """Rows whose stored digest is not the one of their text."""
    return df.filter(~F.sha2(F.col(text), 256).eqNullSafe(F.col(digest)))


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``(entity, n)`` of each table."""
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("entity"), "n") for name, df in tables.items()])


def page_of(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """One page of an ordered list, with the total and whether more follow.

    Only the rows up to the page's end are ordered globally (a top-k), the total is a separate count.
    """
    last = page * size
    top = df.orderBy(*order).limit(last)
    numbered = top.withColumn("position", F.row_number().over(Window.orderBy(*order)))  # at most page * size rows
    shown = numbered.filter(F.col("position") > last - size).withColumn("total", df.agg(F.count(F.lit(1))).scalar())
    return shown.withColumn("has_more", F.col("total") > last)


def browse(df: DataFrame, *, category: str = "all", language: str = "all", contains: str = "", text: list[str]) -> DataFrame:
    out = df if category == "all" else df.filter(F.col("category") == category)
    out = out if language == "all" else out.filter(F.col("language") == language)
    if contains:
        out = out.filter(F.lower(F.concat_ws(" ", *text)).contains(contains.lower()))
    return out


def recent_distinct(df: DataFrame, user: str, item: Column, at: str, most: int) -> DataFrame:
    """Per user the latest distinct items, at most so many."""
    last = df.groupBy(user, item.alias("item")).agg(F.max(at).alias("last_at"))
    w = Window.partitionBy(user).orderBy(F.desc("last_at"), "item")
    return last.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= most)


def replace_by_key(df: DataFrame, path: str, key: str) -> None:
    """Writes the partitions of the keys that occur in ``df`` anew and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def export_books(chunks: DataFrame) -> DataFrame:
    """``(book_id, sequence, chunk_id, text)``: the chunks of all books in order, a row each.

    Parts are ranges of book and sequence, so that a large book spreads over several and none is gathered.
    """
    order = ["book_id", "sequence", "chunk_id"]
    return chunks.select(*order, "text").repartitionByRange(*order).sortWithinPartitions(*order)


def export_paths(books: DataFrame) -> DataFrame:
    """``(book_id, title, path)``: where the export of a book goes, by its title with blanks as ``_``, 60 characters at
    most, in a folder of its id, so that equal titles do not overwrite each other."""
    stem = F.coalesce(F.nullif(F.left(F.translate("title", " ", "_"), F.lit(60)), F.lit("")), F.left("book_id", F.lit(12)))
    return books.select("book_id", "title", F.concat("book_id", F.lit("/"), stem, F.lit(".json")).alias("path"))


def recent_calls(events: DataFrame, by: str, at: str = "ts", seconds: int = 60) -> DataFrame:
    """Adds ``recent``: how many calls of the same caller, itself included, came in the last so many seconds, those
    exactly so long ago not counted. A caller's calls are one partition, sorted, of which a window is held."""
    now = F.unix_micros(F.col(at).cast("timestamp"))
    w = Window.partitionBy(by).orderBy(now).rangeBetween(-seconds * 1_000_000 + 1, Window.currentRow)
    return events.withColumn("recent", F.count(F.lit(1)).over(w))
