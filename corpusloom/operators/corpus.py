"""From files to a corpus: routing, page inspection, OCR planning, metadata facts and seeds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as tx

# Fixed values.
FORMATS = {"pdf": ["pdf"], "epub": ["epub"], "docx": ["docx"], "txt": ["txt", "md"], "html": ["html", "htm"], "json": ["json"]}
CONFIDENCE = {"high": 0, "medium": 1, "low": 2}
SOURCE_PRIORITY = {"filename": 1, "first_pages": 2, "title_page": 3, "pdf_metadata": 4, "user_provided": 5}
FIELD_ALIASES = {"year": "publication_year", "publication year": "publication_year", "page count": "page_count"}
MARKERS = {
    "author": ["تأليف", "تألیف", "تاليف", "تالیف", "المؤلف", "المولف", "by"],
    "editor": ["تحقيق", "تحقیق", "المحقق", "تصحيح", "تصحیح", "مصحح", "المصحح", "edited by"],
    "translator": ["ترجمة", "ترجمه", "مترجم", "المترجم", "translated by"],
    "publisher": ["مطبعة", "مطبعه", "المطبعة", "دار", "مكتبة", "مکتبة", "ناشر", "پریس", "لرتب", "publisher"],
    "edition": ["الطبعة", "الطبعه"],
}
YEAR_WORDS = ["هجری", "هجري", "قمری", "قمرے", "سنة", "سنه", "سال", "ھ", "هـ"]
HIJRI_YEAR, PLAIN_YEAR = f"([0-9]{{3,4}})[{tx.BLANK_CLASS}]*[هھ]", "(?<![0-9])(1[2-9][0-9]{2}|2[0-9]{3})(?![0-9])"
MARKED_ISBN, BARE_ISBN = f"(?i)ISBN[{tx.BLANK_CLASS}]*[:：]?[{tx.BLANK_CLASS}]*([0-9][0-9Xx\\-–—{tx.BLANK_CLASS}]{{8,16}})", "(?<![0-9])97[89][0-9]{10}(?![0-9])"
VOLUME = "(?i)(?:^|[-_. ])(vol|volume|juz|juz'|juzo)[-_. ]*(\\d+)(?:[-_. ]*)$"
GENERIC_STEMS = ["book", "book1", "book2", "book3", "kitab", "كتاب", "document", "document1", "file", "scan", "scanned", "pdf", "image", "islam", "islamic", "slam", "untitled", "readme", "index", "notes", "license", "copying", "changelog", "تحریر"]


def file_format(path: Column) -> Column:
    """By the lower-cased extension; null for others."""
    ext = F.lower(F.regexp_extract(path, "\\.([^./]+)$", 1))
    out = F.lit(None).cast("string")
    for name, exts in FORMATS.items():
        out = F.when(ext.isin(exts), name).otherwise(out)
    return out


def storage_path(category: Column, sha: Column, name: Column) -> Column:
    return F.concat_ws("/", F.lit("raw"), category, F.substring(sha, 1, 2), F.substring(sha, 3, 2), sha, name)


def ingest(files: DataFrame, registered: DataFrame | None = None) -> DataFrame:
    """``(path, category, size, sha256)`` with status, reason and target: registered, duplicate, quarantined.

    The first path of a content wins, unless it is known already; unknown formats and empty files are set
    aside with a reason, under ``quarantine/`` by their name, with -1, -2 and so on before the extension where
    several have one name. A registered target whose name stands for another content is a collision.

    The first path of a digest is a minimum with partial sums, so a content with a third of all files costs
    no more than others; only set-aside files of one name are ranked together.
    """
    reason = F.when(file_format(F.col("path")).isNull(), "unsupported format").when(F.col("size") == 0, "empty file")
    name = F.regexp_extract("path", "([^/]+)$", 1)
    out = files.withColumn("reason", reason).withColumn("_name", name)
    good = out.filter("reason is null")
    first = good.groupBy(F.col("sha256").alias("_sha")).agg(F.min("path").alias("_first"))
    good = good.join(first, F.col("sha256").eqNullSafe(F.col("_sha")))
    if registered is not None:
        known = registered.select(F.col("sha256").alias("_known")).distinct()
        good = good.join(known, F.col("sha256") == F.col("_known"), "left")
    else:
        good = good.withColumn("_known", F.lit(None).cast("string"))
    is_new = F.col("_known").isNull() & (F.col("path") == F.col("_first"))
    good = good.withColumn("status", F.when(is_new, "registered").otherwise("duplicate")).withColumn("target", storage_path(F.col("category"), F.col("sha256"), F.col("_name")))
    bad = out.filter("reason is not null").withColumn("_n", F.row_number().over(Window.partitionBy("_name").orderBy("path")) - 1)
    stem, ext = F.regexp_extract("_name", "^(.*?)(\\.[^.]*)?$", 1), F.regexp_extract("_name", "^(.*?)(\\.[^.]*)?$", 2)
    aside = F.concat(F.lit("quarantine/"), F.when(F.col("_n") == 0, F.col("_name")).otherwise(F.concat(stem, F.lit("-"), F.col("_n").cast("string"), ext)))
    bad = bad.withColumn("status", F.lit("quarantined")).withColumn("target", aside)
    names = [*files.columns, "reason", "status", "target"]
    return good.select(*names).unionByName(bad.select(*names))


def collisions(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Targets that hold another content already: ``(target, sha256, stored_sha256)``."""
    there = stored.select("target", F.col("sha256").alias("stored_sha256"))
    return wanted.join(there, "target").filter(~F.col("sha256").eqNullSafe(F.col("stored_sha256"))).select("target", "sha256", "stored_sha256")


def inspect_pages(pages: DataFrame, file: str = "file") -> DataFrame:
    """Per file the rollup of its pages ``(file, page, text, has_images[, error])`` and its class.

    A page of 30 characters has text; of the others those with images are scanned, and those without any
    character or image blank. A page with an error is none of these. Invalid: no page at all, or over half
    and over five unreadable. Scanned: 80 % scanned or none with text. Text: 95 % with text and at most 2 %
    scanned. Mixed: the rest.
    """
    bad = F.col("error").isNotNull() if "error" in pages.columns else F.lit(False)
    images = F.coalesce("has_images", F.lit(False))
    p = pages.withColumn("_chars", F.when(~bad, F.length(F.coalesce("text", F.lit("")))).otherwise(0)).withColumn("_bad", bad)
    has_text = F.col("_chars") >= 30
    scanned = ~has_text & images & ~F.col("_bad")
    out = p.groupBy(file).agg(F.count(F.lit(1)).alias("pages"), F.count_if(has_text).alias("text_pages"), F.count_if(scanned).alias("scanned_pages"), F.count_if((F.col("_chars") == 0) & ~images & ~F.col("_bad")).alias("blank_pages"), F.count_if("_bad").alias("unreadable_pages"), F.sum("_chars").alias("chars"))
    n = F.col("pages")
    kind = F.when((F.col("unreadable_pages") > 5) & (F.col("unreadable_pages") > 0.5 * n), "invalid").when((F.col("scanned_pages") >= 0.8 * n) | (F.col("text_pages") == 0), "scanned").when((F.col("text_pages") >= 0.95 * n) & (F.col("scanned_pages") <= 0.02 * n), "text").otherwise("mixed")
    return out.withColumn("kind", kind)


def sample_pages(pages: DataFrame, n: int = 8, file: str = "file", page: str = "page") -> DataFrame:
    """The first and the last half of n pages of each file."""
    up, down = Window.partitionBy(file).orderBy(page), Window.partitionBy(file).orderBy(F.desc(page))
    half = n // 2
    return pages.withColumn("_a", F.row_number().over(up)).withColumn("_b", F.row_number().over(down)).filter((F.col("_a") <= half) | (F.col("_b") <= half)).drop("_a", "_b")


def plan_ocr(inspected: DataFrame, extracted: DataFrame, done: DataFrame) -> DataFrame:
    """Distinct ``(file, page)`` still to be recognised: scanned by inspection or without extracted text."""
    wanted = inspected.filter("scanned").select("file", "page").unionByName(extracted.filter("quality <> 'ok'").select("file", "page"))
    return wanted.distinct().join(done.select("file", "page"), ["file", "page"], "left_anti")


def recognise(pages: DataFrame, engine: Callable[[], Callable[[str, int], tuple[str, float]]], recycle: int = 50) -> DataFrame:
    """Runs an engine over ``(file, page)``; a failing page becomes a failed row, the engine is renewed
    every ``recycle`` pages."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        used, call = 0, None
        for rows in batches:
            out = []
            for f, p in zip(rows["file"], rows["page"]):
                if call is None or used >= recycle:
                    call, used = engine(), 0
                used += 1
                try:
                    text, confidence = call(f, int(p))
                    out.append((f, int(p), text, confidence, None))
                except Exception as e:
                    out.append((f, int(p), None, None, str(e)))
            yield pd.DataFrame(out, columns=["file", "page", "text", "confidence", "error"])

    done = pages.select("file", "page").mapInPandas(run, "file string, page int, text string, confidence double, error string")
    notes = tx.ocr_notes(F.coalesce("text", F.lit("")), F.col("confidence"))
    status = F.when(F.col("error").isNotNull(), "failed").when(F.size(notes) > 0, "review").otherwise("ok")
    return done.withColumn("status", status).withColumn("notes", F.when(F.col("error").isNull(), F.concat_ws("; ", notes)))


def word_confidence(words: DataFrame, key: list[str]) -> DataFrame:
    """Mean confidence of the words ``(word, confidence)`` of each key that say something: blank words and negative
    confidences do not count, and a key without any other has none."""
    good = (tx.strip(F.coalesce("word", F.lit(""))) != "") & (F.col("confidence") >= 0)
    return words.groupBy(*key).agg(F.avg(F.when(good, F.col("confidence"))).alias("confidence"))


def batch(df: DataFrame, limit: int | None, by: str = "created_at", key: str = "id") -> DataFrame:
    """The oldest ``limit`` sources, or all."""
    return df if limit is None else df.orderBy(by, key).limit(limit)


def ocr_rollup(pages: DataFrame) -> DataFrame:
    return pages.groupBy("file").agg(F.count_if(F.col("status") == "ok").alias("ocr"), F.count_if(F.col("status") == "review").alias("review"), F.count_if(F.col("status") == "failed").alias("failed"), F.round(F.avg("confidence"), 4).alias("mean_confidence"))


def _rank(c: Column, ranks: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for k, v in ranks.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def candidate_order() -> Column:
    """Approved first, then confidence, source priority, age and id: the least comes first."""
    return F.struct((F.col("status") != "approved").cast("int").alias("a"), _rank(F.col("confidence"), CONFIDENCE, 3).alias("b"), (-_rank(F.col("source"), SOURCE_PRIORITY, 0)).alias("c"), F.col("created_at").alias("d"), F.col("id").alias("e"))


def merge_candidates(candidates: DataFrame) -> DataFrame:
    """The best fact of each file and field that is not rejected, by a map-side minimum."""
    live = candidates.filter("status <> 'rejected'")
    best = F.min_by(F.struct("id", "value", "confidence", "source", "status"), candidate_order()).alias("best")
    return live.groupBy("source_file_id", "field").agg(best).select("source_file_id", "field", "best.*")


def overall_confidence(best: DataFrame) -> DataFrame:
    """Per file the weakest confidence among its best facts."""
    worst = F.max(_rank(F.col("confidence"), CONFIDENCE, 3)).alias("_w")
    return best.groupBy("source_file_id").agg(worst, F.count(F.lit(1)).alias("fields")).select("source_file_id", "fields", F.element_at(F.array(*[F.lit(c) for c in (*CONFIDENCE, "none")]), F.col("_w") + 1).alias("overall"))


def review_gate(best: DataFrame, auto: bool) -> DataFrame:
    """Per file: waiting without automatic review. With it the open facts (pending or in review) that are high
    are approved; an open title that is not high blocks the file, as does a file without a title."""
    is_open, high, title = F.col("status").isin("pending", "review"), F.col("confidence") == "high", F.col("field") == "title"
    fine = F.max(F.when(title, ~is_open | high))  # a title that was approved before stays so
    out = best.groupBy("source_file_id").agg(fine.alias("_t"), F.count_if(is_open & high).alias("_a"))
    verdict = F.when(F.lit(not auto), "waiting").when(F.coalesce("_t", F.lit(False)), "approved").otherwise("blocked")
    return out.select("source_file_id", F.when(F.lit(auto), F.col("_a")).otherwise(0).alias("n_approved"), verdict.alias("verdict"))


def publish(best: DataFrame) -> DataFrame:
    """One catalog row for each file with an approved title; its other approved fields beside it.

    A language counts only as one of the four codes; a Hijri year is kept as printed and noted, as is an editor.
    """
    ok = best.filter("status = 'approved'")
    fields = ["title", "subtitle", "author", "translator", "editor", "publisher", "publication_year", "isbn", "language", "category"]
    wide = ok.groupBy("source_file_id").pivot("field", fields).agg(F.first("value")).filter("title is not null")
    year = F.regexp_extract("publication_year", "([0-9]+)", 1)
    hijri = (year != "") & F.contains("publication_year", F.lit("(AH)"))
    notes = F.concat_ws(" ", F.when(hijri, "publication year as printed (Hijri)"), F.when(F.col("editor").isNotNull(), F.concat(F.lit("editor: "), F.col("editor"))))
    return wide.withColumn("year", F.when(year != "", year).cast("int")).withColumn("isbn", F.right(F.regexp_replace("isbn", "[^0-9Xx]", ""), F.lit(13))).withColumn("language", F.when(F.col("language").isin("ar", "ur", "en", "other"), F.col("language"))).withColumn("notes", F.nullif(notes, F.lit("")))


def upsert_candidates(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Facts of both by key: what is not found again is dropped, doubt once raised stays."""
    o = old.select(*key, F.col("uncertain").alias("_u"), F.col("status").alias("_s"))
    out = new.join(o, key, "left")
    return out.withColumn("uncertain", F.col("uncertain") | F.coalesce("_u", F.lit(False))).withColumn("status", F.coalesce("_s", F.when(F.col("source") == "user_provided", "approved").otherwise("review"))).drop("_u", "_s")


def apply_decisions(best: DataFrame, decisions: DataFrame) -> DataFrame:
    """Approve, reject or correct the best fact of a field: ``decisions(source_file_id, field, action, new_value)``."""
    out = best.join(decisions, ["source_file_id", "field"], "left")
    status = F.when(F.col("action").isin("approve", "correct"), "approved").when(F.col("action") == "reject", "rejected").otherwise(F.col("status"))
    return out.withColumn("status", status).withColumn("value", F.when(F.col("action") == "correct", F.col("new_value")).otherwise(F.col("value"))).drop("action", "new_value")


def get_or_create(existing: DataFrame, names: DataFrame, column: str = "name") -> DataFrame:
    """The dimension with the new names, ids derived from the names."""
    new = names.select(column).filter(F.col(column).isNotNull()).distinct().join(existing.select(column), column, "left_anti")
    return existing.select("id", column).unionByName(new.select(F.sha2(column, 256).alias("id"), column))


def get_or_create_category(existing: DataFrame, names: DataFrame) -> DataFrame:
    """Categories ``(code, name)`` with the new names. A name that is there stays; one whose code is there is taken as
    that category; the code of a new one is its slug, or the name where nothing of it is left."""
    slug = tx.slug(F.col("name"))
    new = names.select("name").filter(F.col("name").isNotNull()).distinct().join(existing.select("name"), "name", "left_anti").withColumn("code", F.when(slug != "", slug).otherwise(F.col("name")))
    new = new.join(existing.select("code"), "code", "left_anti").groupBy("code").agg(F.min("name").alias("name"))  # of new names with one code the first
    return existing.select("code", "name").unionByName(new)


def unpivot_info(df: DataFrame, key: str) -> DataFrame:
    """Facts of a document's own info: title and author high, subject a medium description."""
    rows = df.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), tx.clean_value(F.col(c)).alias("value"), F.lit(conf).alias("confidence")) for c, f, conf in (("title", "title", "high"), ("author", "author", "high"), ("subject", "description", "medium"))])).alias("f"))
    return rows.select(key, "f.*").filter("value <> ''")


def filename_facts(df: DataFrame, key: str, name: str) -> DataFrame:
    """Of each file name a volume as medium edition and the cleaned stem as low title, if it says something."""
    stem = F.trim(F.regexp_replace(F.col(name), "\\.[^.]*$", ""))
    no = F.regexp_extract(stem, VOLUME, 2)
    title = F.trim(F.regexp_replace(F.regexp_replace(stem, VOLUME, " "), "[-_. ]+", " "))
    good = (F.length(title) >= 3) & (F.length(title) <= 200) & ~F.lower(title).isin(GENERIC_STEMS) & ~title.rlike("^[0-9]+$")
    facts = F.array_compact(F.array(F.when(no != "", F.struct(F.lit("edition").alias("field"), F.concat(F.lit("Vol. "), no).alias("value"), F.lit("medium").alias("confidence"))), F.when(good, F.struct(F.lit("title").alias("field"), title.alias("value"), F.lit("low").alias("confidence")))))
    return df.select(key, F.explode(facts).alias("f")).select(key, "f.*")


def _marked_lines(pages: DataFrame, key: str) -> DataFrame:
    """(key, page, at, line, field, value): every line of the pages; field and value where a marker opens it."""
    rows = pages.select(key, "page", F.transform(tx.lines_of(F.col("text")), tx.strip).alias("_lines")).select(key, "page", "_lines", F.posexplode("_lines").alias("at", "line"))
    after = tx.clean_value(F.get(F.filter(F.slice("_lines", F.col("at") + 2, F.lit(3)), lambda x: x != ""), F.lit(0)))
    field, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, markers in reversed(MARKERS.items()):
        pattern = "^(?:" + "|".join(sorted(markers, key=lambda m: -len(m))) + ")(?![\\p{L}\\p{N}])"
        rest = tx.clean_value(F.col("line") if name == "edition" else F.regexp_replace("line", pattern, ""))
        told = rest if name == "edition" else F.coalesce(F.nullif(rest, F.lit("")), after, F.lit(""))
        hit = F.col("line").rlike(pattern) & (told != "")
        field, value = F.when(hit, name).otherwise(field), F.when(hit, told).otherwise(value)
    return rows.select(key, "page", "at", "line", field.alias("field"), value.alias("value"))


def marked_facts(pages: DataFrame, key: str = "file") -> DataFrame:
    """Facts that lines of ``(file, page, text)`` announce by a marker at their start.

    The value is the rest of the line, or else the next line with text within three. The first marker kind
    that gives a value counts.
    """
    return _marked_lines(pages, key).filter("field is not null").select(key, "page", "at", "field", "value", F.lit("high").alias("confidence"))


def year_facts(pages: DataFrame, key: str = "file") -> DataFrame:
    """Per file the publication year: the first Hijri year or year with a keyword, else the first plain one."""
    line = F.col("line")
    rows = pages.select(key, "page", F.posexplode(tx.lines_of(F.col("text"))).alias("at", "raw")).withColumn("line", tx.fold_digits(tx.strip(F.col("raw"))))
    hijri = F.regexp_extract(line, HIJRI_YEAR, 1)
    plain = F.regexp_extract(line, PLAIN_YEAR, 1)
    is_hijri = (hijri != "") & hijri.try_cast("int").between(100, 1699)
    sure = F.when(is_hijri, F.concat(hijri, F.lit(" (AH)"))).when((plain != "") & line.rlike("|".join(YEAR_WORDS)), plain)
    rows = rows.withColumn("_sure", sure).withColumn("_plain", F.when(plain != "", plain)).filter("_sure is not null or _plain is not null")
    best = F.min_by(F.struct(F.coalesce("_sure", "_plain").alias("value"), F.when(F.col("_sure").isNotNull(), "high").otherwise("medium").alias("confidence")), F.struct(F.col("_sure").isNull(), "page", "at", F.coalesce("_sure", "_plain")))
    return rows.groupBy(key).agg(best.alias("b")).select(key, F.lit("publication_year").alias("field"), "b.*")


def isbn_facts(pages: DataFrame, key: str = "file") -> DataFrame:
    """Per file the first ISBN: on each page a marked one of 10 or 13 digits, or else bare 13 digits from 978 or 979."""
    marked = F.filter(F.transform(tx.lines_of(F.col("text")), lambda x: F.regexp_replace(F.regexp_extract(x, MARKED_ISBN, 1), "[^0-9Xx]", "")), lambda x: F.length(x).isin(10, 13))
    bare = F.regexp_extract(tx.fold_digits(F.col("text")), BARE_ISBN, 0)
    rows = pages.select(key, "page", F.coalesce(F.get(marked, F.lit(0)), F.nullif(bare, F.lit(""))).alias("value")).filter("value is not null")
    return rows.groupBy(key).agg(F.min_by("value", F.struct("page", "value")).alias("value")).select(key, F.lit("isbn").alias("field"), "value", F.lit("high").alias("confidence"))


def title_guess(pages: DataFrame, key: str = "file") -> DataFrame:
    """Per file the longest line of 3 to 250 characters of the first page that has one; no page number, no
    basmala, no line that a marker has used. Of equal lengths the last in lower case, then the first."""
    rows = _marked_lines(pages, key).filter(F.length("line").between(3, 250) & F.col("field").isNull() & ~tx.is_page_number(F.col("line")) & ~tx.is_basmala(F.col("line")))
    best = F.max_by("line", F.struct(-F.col("page"), F.length("line"), F.lower("line"), -F.col("at"), "line"))
    return rows.groupBy(key).agg(best.alias("value")).select(key, F.lit("title").alias("field"), "value", F.lit("medium").alias("confidence"))


def seed(existing: DataFrame, incoming: DataFrame, key: list[str], text: str) -> DataFrame:
    """Rows with an action: created, skipped (there already, same text) or conflict (another text)."""
    old = existing.select(*key, F.col(text).alias("_old"), F.lit(True).alias("_there"))
    joined = incoming.join(old, key, "left")
    return joined.withColumn("action", F.when(F.col("_there").isNull(), "created").when(F.col("_old").eqNullSafe(F.col(text)), "skipped").otherwise("conflict")).drop("_old", "_there")


def refuse_conflicts(seeded: DataFrame) -> DataFrame:
    """The created rows; a conflict anywhere ends the job."""
    checked = seeded.withColumn("action", F.when(F.col("action") == "conflict", F.raise_error(F.lit("the stored text differs"))).otherwise(F.col("action")))
    return checked.filter("action = 'created'")
