"""Readers for directories, page folders and JSON data sets, and writers beside them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_directory(spark: SparkSession, path: str, category: str = "general", pattern: str = "*") -> DataFrame:
    """``(path, category, size, sha256)`` of all files below, hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.lit(category).alias("category"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def read_texts(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """``(path, text)``, a row for each file."""
    return spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def html_text(c):
    """The visible text of HTML: no scripts, tags to blanks, the usual entities resolved."""
    out = F.regexp_replace(c, "(?is)<(script|style)[^>]*>.*?</\\1>|<!--.*?-->", " ")
    out = F.regexp_replace(F.regexp_replace(out, "(?i)<(br|/p|/div|/li|/tr|/h[1-6])[^>]*>", "\n"), "<[^>]+>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.btrim(F.regexp_replace(out, "[ \t]+", " "), F.lit(" \n"))


def read_page_folder(spark: SparkSession, path: str) -> DataFrame:
    """``(page, text, quality)`` of an extracted book: by its index.json, so that blank pages stay, as ''; without one
    the pages that are there, by the numbers of their files, of unknown quality."""
    texts = read_texts(spark, f"{path}/pages").select(F.regexp_extract("path", "([0-9]+)\\.txt$", 1).try_cast("int").alias("page"), "text").filter("page is not null")
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/index.json")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return texts.withColumn("quality", F.lit(None).cast("string"))
    index = spark.read.option("multiLine", "true").json(f"{path}/index.json").select(F.explode("page_files").alias("p")).select(F.col("p.page").cast("int").alias("page"), F.col("p.quality").alias("quality"))
    return index.join(texts, "page", "left").select("page", F.coalesce("text", F.lit("")).alias("text"), "quality")


VERSES = "translator string, language string, surahs array<struct<number int, name_arabic string, name_en string, name_transliteration string, ayah_count int, revelation_place string, ayahs array<struct<number int, text string, translation string, juz int, page int>>>>"
REPORTS = "collection string, title string, author string, description string, hadiths array<struct<number int, text string, text_arabic string, book string, chapter string, narrator string, grade string>>"


def read_verses(spark: SparkSession, path: str) -> DataFrame:
    """A row for each verse of a nested data set, valid chapter and verse numbers only."""
    rows = spark.read.schema(VERSES).option("multiLine", "true").json(path)
    chapters = rows.select("translator", "language", F.explode("surahs").alias("s"))
    verses = chapters.select("translator", "language", F.col("s.number").alias("chapter"), "s.name_arabic", "s.name_en", F.explode("s.ayahs").alias("a"))
    return verses.select("translator", "language", "chapter", "name_arabic", "name_en", F.col("a.number").alias("verse"), "a.text", "a.translation", "a.juz", "a.page").filter(F.col("chapter").between(1, 114) & (F.col("verse") > 0) & (F.trim("text") != ""))


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(REPORTS).option("multiLine", "true").json(path)
    return rows.select("collection", "title", "author", F.explode("hadiths").alias("h")).select("collection", "title", "author", "h.*").filter("number > 0 and trim(text) <> ''")


def user_facts(df: DataFrame, column: str, key: str) -> DataFrame:
    """Facts a user gave as a JSON object, or as a list of field and value."""
    one, many = F.from_json(column, "map<string,string>"), F.from_json(column, "array<struct<field string, value string>>")
    is_list = F.ltrim(F.col(column)).startswith("[")
    pairs = F.when(is_list, many).otherwise(F.transform(F.map_entries(one), lambda e: F.struct(e["key"].alias("field"), e["value"].alias("value"))))
    return df.select(key, F.explode(pairs).alias("p")).select(key, F.lower(F.trim("p.field")).alias("field"), F.trim("p.value").alias("value"), F.lit("user_provided").alias("source"))


def parse_documents(files: DataFrame, parser: Callable[[bytes], list[str]]) -> DataFrame:
    """``(path, page, text, error)`` of binary files through any page parser; a failure is a row."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for path, content in zip(rows["path"], rows["content"]):
                try:
                    out += [(path, i + 1, t, None) for i, t in enumerate(parser(bytes(content)))]
                except Exception as e:
                    out.append((path, None, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "page", "text", "error"]).astype({"page": "Int32"})

    return files.select("path", "content").mapInPandas(run, "path string, page int, text string, error string")


def write_pages(pages: DataFrame, path: str) -> None:
    """Good pages as Parquet by book, and an index of all with their sizes and quality."""
    pages.filter("quality = 'ok'").write.mode("overwrite").partitionBy("book_id").parquet(f"{path}/pages")
    pages.select("book_id", "page", F.length("text").alias("chars"), "quality").write.mode("overwrite").parquet(f"{path}/index")


def render_pages(files: DataFrame, render: Callable[[bytes, int], bytes], pages: DataFrame) -> DataFrame:
    """``(path, page, image, error)`` of the pages asked for, ``(path, page)``, through any renderer of a file's content
    and a page number; a failure is a row. The pages of a file are rendered where its content is."""
    wanted = pages.groupBy("path").agg(F.sort_array(F.collect_set("page")).alias("pages"))  # numbers only

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for path, content, asked in zip(rows["path"], rows["content"], rows["pages"]):
                for page in asked:
                    try:
                        out.append((path, int(page), render(bytes(content), int(page)), None))
                    except Exception as e:
                        out.append((path, int(page), None, str(e)))
            yield pd.DataFrame(out, columns=["path", "page", "image", "error"])

    return files.join(wanted, "path").select("path", "content", "pages").mapInPandas(run, "path string, page int, image binary, error string")
