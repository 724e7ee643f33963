"""Queries over the scalar text functions: normalisation, folds, estimates, qualities, parses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import structure
from corpusloom.plans.registry import query
from corpusloom.session import table

BLANK = r"[ \t\n\r\f\x0b]"
LAYOUT = r"regexp_replace(regexp_replace({0}, '\r\n|\r|\f', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
COLLAPSE = r"regexp_replace(regexp_replace({0}, '[ \t\x0b\f\x{{A0}}]+', ' ', 'g'), '(?m)[ \t]+$', '', 'g')"
TOKENS = r"regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}]+')"
SPACE = r"\t-\r\x1c- \x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}"
VISIBLE = "length(regexp_replace({0}, '[" + SPACE + "]', '', 'g'))"
SPACES = SPACE.format()
STRIP = "regexp_replace(regexp_replace({0}, '^[" + SPACE + "]+', ''), '[" + SPACE + "]+$', '')"


def count(c: str, cls: str) -> str:
    """SQL that counts the characters of a class."""
    return f"(length({c}) - length(regexp_replace({c}, '{cls}', '', 'g')))"


LETTERS = count("{0}", r"\p{{L}}")


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "normalized_texts").select("content_block_id", "language", "original_text", "normalized_text", "config_name", "protected", "original_sha256", "book_id", "stats").distinct()


BLOCKS = "(SELECT DISTINCT content_block_id, language, original_text, normalized_text, config_name, protected, original_sha256, book_id, stats FROM normalized_texts)"


@query(f"SELECT doc_id, {LAYOUT.format('text')} AS unified, CAST((length(text) - length(replace(text, chr(13), ''))) AS BIGINT) AS n_returns FROM documents WHERE text IS NOT NULL")
def normalize_layout(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").filter(t.isNotNull()).select("doc_id", tx.unify_breaks(t).alias("unified"), (F.length(t) - F.length(F.replace(t, F.lit("\r"), F.lit("")))).cast("long").alias("n_returns"))


@query(f"SELECT content_block_id, nfc_normalize(original_text) AS nfc FROM {BLOCKS}")
def unicode_nfc(spark, sf):
    return _texts(spark, sf).select("content_block_id", tx.unicode_form(F.col("original_text")).alias("nfc"))


@query(f"SELECT content_block_id, {COLLAPSE.format('original_text')} AS collapsed, replace(original_text, 'ـ', '') AS without_tatweel FROM {BLOCKS}")
def collapse_blanks(spark, sf):
    t = F.col("original_text")
    return _texts(spark, sf).select("content_block_id", tx.collapse_blanks(t).alias("collapsed"), F.translate(t, tx.TATWEEL, "").alias("without_tatweel"))


@query(f"""SELECT content_block_id, translate(original_text, 'أؤإآ', 'اواا') AS hamza, translate(original_text, 'ةى', 'هي') AS full_fold, translate(original_text, 'ھی', 'ہے') AS urdu,
    translate(original_text, '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789') AS digits FROM {BLOCKS}""")
def letter_folds(spark, sf):
    t = F.col("original_text")
    return _texts(spark, sf).select("content_block_id", tx.fold_letters(t, hamza=True).alias("hamza"), tx.fold_letters(t, full=True).alias("full_fold"), tx.fold_letters(t, urdu=True).alias("urdu"), tx.fold_digits(t).alias("digits"))


_PROTECTED = " OR ".join(f"contains(original_text, '{m}')" for m in ["\ufdf2", "\ufd3f", "\ufd3e", "\ufdfa", "\ufdfb", "بسم الله", "قال رسول الله", "رواه"])
_CODE = "CASE WHEN lower(trim(language)) IN ('ar','ara','arabic') THEN 'ar' WHEN lower(trim(language)) IN ('ur','urd','urdu') THEN 'ur' WHEN lower(trim(language)) IN ('en','eng','english') THEN 'en' ELSE 'other' END"
_BASE = f"replace({COLLAPSE.format('nfc_normalize(' + LAYOUT.format('original_text') + ')')}, 'ـ', '')"


_HAMZA = "translate(translate(base, 'أؤإآ', 'اواا'), '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789')"


@query(f"""WITH b AS (SELECT content_block_id, {_CODE} AS code, {_BASE} AS base, ({_PROTECTED}) AS guarded FROM {BLOCKS})
    SELECT content_block_id, code, guarded, CASE WHEN guarded THEN base WHEN code = 'ar' THEN {_HAMZA} WHEN code = 'ur' THEN translate(base, '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789') ELSE base END AS auto_text,
    CASE WHEN guarded THEN base ELSE {_HAMZA} END AS search_text FROM b""")
def normalize_texts(spark, sf):
    t = F.col("original_text")
    rows = _texts(spark, sf).withColumn("code", F.coalesce(tx.language_code(F.col("language")), F.lit("other")))
    return rows.select("content_block_id", "code", tx.is_protected(t).alias("guarded"), tx.normalize_text(t, F.col("code")).alias("auto_text"), tx.normalize_text(t, F.col("code"), "search").alias("search_text"))


@query(f"""SELECT book_id, count(*) AS blocks, CAST(sum(CASE WHEN normalized_text <> original_text THEN 1 ELSE 0 END) AS BIGINT) AS changed, CAST(sum(CASE WHEN protected THEN 1 ELSE 0 END) AS BIGINT) AS protected_blocks,
    CAST(sum(stats.chars_before) AS BIGINT) AS chars_before, CAST(sum(stats.chars_after) AS BIGINT) AS chars_after FROM {BLOCKS} GROUP BY book_id""")
def normalize_stats(spark, sf):
    return _texts(spark, sf).groupBy("book_id").agg(F.count(F.lit(1)).alias("blocks"), F.count_if(F.col("normalized_text") != F.col("original_text")).alias("changed"), F.count_if("protected").alias("protected_blocks"), F.sum("stats.chars_before").alias("chars_before"), F.sum("stats.chars_after").alias("chars_after"))


@query(f"SELECT content_block_id, translate(nfc_normalize(regexp_replace(original_text, '[ـً-ٰٟ]', '', 'g')), 'ٱآأإى', 'ااااي') AS folded FROM {BLOCKS}")
def arabic_search_fold(spark, sf):
    return _texts(spark, sf).select("content_block_id", tx.search_fold(F.col("original_text")).alias("folded"))


@query("SELECT doc_id, CAST(greatest(1, ceil(length(text) / CASE WHEN lang IN ('ar','ur') THEN 3.0 ELSE 4.0 END)) AS BIGINT) AS tokens FROM documents WHERE text IS NOT NULL")
def token_estimate(spark, sf):
    return table(spark, sf, "documents").filter("text is not null").select("doc_id", tx.token_estimate(F.col("text"), F.col("lang")).alias("tokens"))


_AR = count("text", r"[\x{600}-\x{6FF}\x{750}-\x{77F}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]")
_UR = count("text", r"[\x{6BE}\x{6BA}\x{6D2}\x{6CC}\x{679}\x{688}\x{6AF}\x{6C1}]")


@query(f"SELECT doc_id, CASE WHEN {_AR} > 0 THEN CASE WHEN {_UR} >= greatest(3, {_AR} // 20) THEN 'ur' ELSE 'ar' END WHEN regexp_matches(text, '[A-Za-z]') THEN 'en' END AS script FROM documents WHERE text IS NOT NULL")
def script_hint(spark, sf):
    return table(spark, sf, "documents").filter("text is not null").select("doc_id", tx.script_hint(F.col("text")).alias("script"))


_V, _L = VISIBLE.format("text"), LETTERS.format("text")


@query(f"""SELECT doc_id, CASE WHEN text IS NULL OR {_V} = 0 THEN 'blank' WHEN {_L} < 0.5 * {_V} OR length(text) - length(replace(text, '?', '')) > 0.3 * {_V} THEN 'garbled' ELSE 'ok' END AS quality,
    CASE WHEN n_chars = 0 THEN 'none' WHEN n_chars <= 200 THEN 'low' WHEN n_chars <= 1200 THEN 'medium' ELSE 'high' END AS density, CAST({_L} AS BIGINT) AS n_letters FROM documents WHERE n_chars IS NOT NULL""")
def text_quality(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").filter("n_chars is not null").select("doc_id", tx.extract_quality(t).alias("quality"), tx.density_band(F.col("n_chars")).alias("density"), tx.letters(t).cast("long").alias("n_letters"))


@query(f"""SELECT doc_id, CASE WHEN {_V} = 0 THEN 'no_text' ELSE concat_ws('; ', CASE WHEN n_chars % 100 < 50 THEN 'low_confidence=' || printf('%.1f', CAST(n_chars % 100 AS DOUBLE)) END, CASE WHEN {_V} < 30 THEN 'very_short_text=' || {_V} END,
    CASE WHEN {_L} / {_V} < 0.5 THEN 'low_alpha_ratio=' || printf('%.2f', CAST({_L} / {_V} AS DOUBLE)) END) END AS notes FROM documents WHERE text IS NOT NULL""")
def ocr_quality(spark, sf):
    return table(spark, sf, "documents").filter("text is not null").select("doc_id", F.concat_ws("; ", tx.ocr_notes(F.col("text"), (F.col("n_chars") % 100).cast("double"))).alias("notes"))


LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_LINES = f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, {STRIP.format('l[i]')} AS line FROM (SELECT doc_id, regexp_split_to_array(text, '{LINE_BREAK}') AS l FROM documents WHERE text IS NOT NULL), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i) WHERE {STRIP.format('l[i]')} <> ''"
_IS_NUMBER = "regexp_matches(line, '^[0-9٠-٩۰-۹]{1,4}$')"
_IS_TOC = r"(length(line) <= 140 AND ((length(line) - length(regexp_replace(line, '[.\x{2026}\x{92}\x{B7}\x{2024}]', '', 'g'))) >= 3 OR regexp_matches(line, '[0-9٠-٩۰-۹]$')))"
_IS_NOTE = f"(regexp_matches(line, '^[(（\\[{{]?[{SPACES}]*[0-9٠-٩۰-۹]{{1,3}}[)）\\]}}]?[{SPACES}]*[:\u200f\u200e]?[{SPACES}]*[^{SPACES}.0-9٠-٩۰-۹]') OR regexp_matches(line, '^\\*{{1,3}}[{SPACES}]*[^{SPACES}]') OR regexp_matches(line, '^[_\\-\u2500\u2014]{{3,}}$'))"


@query(f"SELECT doc_id, line_no, CASE WHEN {_IS_NUMBER} THEN 'page_number' WHEN {_IS_TOC} THEN 'toc_line' WHEN {_IS_NOTE} THEN 'footnote' ELSE 'text' END AS kind FROM ({_LINES})")
def line_classes(spark, sf):
    pages = table(spark, sf, "documents").select("doc_id", F.lit(1).alias("page"), "text")
    return structure.line_classes(pages, "doc_id").drop("page")


@query(f"SELECT doc_id, 1 AS page FROM ({_LINES}) WHERE NOT {_IS_NUMBER} GROUP BY doc_id HAVING count(*) >= 3 AND sum(CASE WHEN {_IS_TOC} THEN 1 ELSE 0 END) >= 3 AND sum(CASE WHEN {_IS_TOC} THEN 1 ELSE 0 END) >= 0.6 * count(*)")
def toc_pages(spark, sf):
    return structure.toc_pages(table(spark, sf, "documents").select("doc_id", F.lit(1).alias("page"), "text"), "doc_id")


_HEADINGS = [
    ("appendix", 1, "الملحق|ملحق|المستدرك|ضميمہ|ضميمه|ضمیمہ|appendix|annexe|annex"),
    ("references", 1, "المراجع|المصادر|الفهارس|المصادر والمراجع|فهرست المراجع|فهرست|bibliography|references|حوالہ جات|حوالي|ذخائر"),
    ("chapter", 1, "الباب|باب|الكتاب|كتاب|المجلد|الجزء|جزء|القسم|بخش|part|chapter"),
    ("section", 2, "الفصل|فصل|مطلب|مبحث|عنوان|section|سبق"),
    ("subsection", 3, "المسألة|المسئلة|مسألة|مسئلة|مسئله|مسئلہ|الفرع|فرع|subsection|ذيل"),
]
_STRUCTURAL = "lower(translate(regexp_replace(nfc_normalize({0}), '[\u0640\u064b-\u065f\u0670\u06d6-\u06ed]', '', 'g'), 'أإآٱةۀیئؤکھہۃ', 'ااااههييوكههه'))"


def _opens(words: str) -> str:
    return f"regexp_matches({_STRUCTURAL.format('line')}, '^(' || {_STRUCTURAL.format(repr(words))} || ')($|[^\\p{{L}}\\p{{N}}])')"


_DOTTED = "regexp_extract(translate(line, '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789'), '^[0-9]+([.][ ]*[0-9]+)+')"
_KIND = "CASE " + " ".join(f"WHEN {_opens(w)} THEN '{k}'" for k, _, w in _HEADINGS) + f" WHEN {_DOTTED} <> '' THEN 'numbered' END"
_LEVEL = "CASE " + " ".join(f"WHEN {_opens(w)} THEN {n}" for _, n, w in _HEADINGS) + f" WHEN {_DOTTED} <> '' THEN CASE WHEN length({_DOTTED}) - length(replace({_DOTTED}, '.', '')) >= 2 THEN 3 ELSE 2 END END"


@query(f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, line_no, level, kind FROM (SELECT doc_id, line_no, {_KIND} AS kind, {_LEVEL} AS level FROM ({_LINES}) WHERE length(line) <= 500) WHERE kind IS NOT NULL")
def heading_lines(spark, sf):
    """Which lines are headings, of what kind and level."""
    return structure.headings(table(spark, sf, "documents"), "doc_id", "text").select("doc_id", "line_no", "level", "kind")


@query(f"""WITH l AS (SELECT d.book_id, l.line, {_KIND} AS kind FROM ({_LINES}) l JOIN documents d ON d.doc_id = l.doc_id WHERE d.book_id IS NOT NULL)
    SELECT book_id, count(*) AS lines, sum(length(line)) AS chars FROM l WHERE NOT {_IS_NUMBER} AND book_id NOT IN (SELECT book_id FROM l WHERE kind IS NOT NULL AND length(line) <= 500) GROUP BY book_id""")
def structure_lines(spark, sf):
    """Every line of a book's pages is in one of its blocks, but for page numbers; of books without headings, whose
    titles cannot be left out as repeated."""
    docs = table(spark, sf, "documents").filter("book_id is not null")
    titled = structure.headings(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    books = docs.join(titled, "doc_id", "left_semi").select("book_id").distinct()
    pages = docs.select("book_id", F.coalesce("page_number", F.lit(0)).alias("page"), "text").join(books, "book_id", "left_anti")
    lines = structure.structure_books(pages).select("book_id", F.explode(tx.lines_of(F.col("text"))).alias("line")).select("book_id", tx.strip(F.col("line")).alias("line"))
    return lines.groupBy("book_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("chars"))


@query()
def document_headings(spark, sf):
    return structure.headings(table(spark, sf, "documents"), "doc_id", "text")


@query()
def structure_blocks(spark, sf):
    pages = table(spark, sf, "documents").filter("book_id is not null").select("book_id", F.coalesce("page_number", F.lit(0)).alias("page"), "text")
    return structure.structure_books(pages)


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def slugs(spark, sf):
    return table(spark, sf, "part").select("p_partkey", tx.slug(F.col("p_name")).alias("slug"))


ENDS = f"{SPACES}؛،:;\u200e\u200f"


@query(f"""WITH m AS (SELECT DISTINCT id, field, value FROM metadata_candidates WHERE value IS NOT NULL)
    SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(value, '^[{ENDS}\\-–—]+', ''), '[{ENDS}\\-]+$', ''), '[{SPACES}]+', ' ', 'g')) AS cleaned,
    regexp_matches(trim(value), '^[0-9٠-٩۰-۹]{{1,4}}$') AS is_number, CASE WHEN field = 'publication_year' AND regexp_extract(value, '([0-9]+)', 1) <> '' THEN CAST(regexp_extract(value, '([0-9]+)', 1) AS INTEGER) END AS year,
    CASE WHEN field = 'isbn' THEN right(regexp_replace(value, '[^0-9Xx]', '', 'g'), 13) END AS isbn FROM m""")
def clean_values(spark, sf):
    rows = table(spark, sf, "metadata_candidates").select("id", "field", "value").filter("value is not null").distinct()
    v = F.col("value")
    year = F.regexp_extract(v, "([0-9]+)", 1)
    return rows.select("id", tx.clean_value(v).alias("cleaned"), tx.is_page_number(v).alias("is_number"), F.when((F.col("field") == "publication_year") & (year != ""), year.cast("int")).alias("year"), F.when(F.col("field") == "isbn", F.right(F.regexp_replace(v, "[^0-9Xx]", ""), F.lit(13))).alias("isbn"))


@query(f"SELECT label, code, count(*) AS n FROM (SELECT language AS label, {_CODE} AS code FROM search_hits) GROUP BY ALL")
def language_aliases(spark, sf):
    rows = table(spark, sf, "search_hits").select(F.col("language").alias("label"), F.coalesce(tx.language_code(F.col("language")), F.lit("other")).alias("code"))
    return rows.groupBy("label", "code").count().withColumnRenamed("count", "n")


@query("SELECT label, CASE lower(label) WHEN 'ar' THEN 'arabic' WHEN 'en' THEN 'english' ELSE 'simple' END AS config, count(*) AS n FROM (SELECT language AS label FROM search_hits) GROUP BY ALL")
def search_configs(spark, sf):
    return table(spark, sf, "search_hits").groupBy(F.col("language").alias("label"), tx.search_config(F.col("language")).alias("config")).agg(F.count(F.lit(1)).alias("n"))
