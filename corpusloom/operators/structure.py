"""Structure of page texts: lines, headings, segments and the chapter and section plan of each book."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as tx

# Words that open a heading, by what they open, in the order they are tried.
HEADING_WORDS = {
    "appendix": ["الملحق", "ملحق", "المستدرك", "ضميمہ", "ضميمه", "ضمیمہ", "appendix", "annexe", "annex"],
    "references": ["المراجع", "المصادر", "الفهارس", "المصادر والمراجع", "فهرست المراجع", "فهرست", "bibliography", "references", "حوالہ جات", "حوالي", "ذخائر"],
    "chapter": ["الباب", "باب", "الكتاب", "كتاب", "المجلد", "الجزء", "جزء", "القسم", "بخش", "part", "chapter"],
    "section": ["الفصل", "فصل", "مطلب", "مبحث", "عنوان", "section", "سبق"],
    "subsection": ["المسألة", "المسئلة", "مسألة", "مسئلة", "مسئله", "مسئلہ", "الفرع", "فرع", "subsection", "ذيل"],
}
LEVEL = {"appendix": 1, "references": 1, "chapter": 1, "section": 2, "subsection": 3}
# Ordinals, and the tens that a unit can be joined to.
ORDINALS = {
    "الحادي": 11, "الحادى": 11, "الثاني عشر": 12, "الثانى عشر": 12, "الثالث عشر": 13, "الرابع عشر": 14, "الخامس عشر": 15,
    "السادس عشر": 16, "السابع عشر": 17, "الثامن عشر": 18, "التاسع عشر": 19, "العشرون": 20, "الثلاثون": 30, "الأربعون": 40,
    "اربعون": 40, "الخمسون": 50, "الستون": 60, "السبعون": 70, "الثمانون": 80, "التسعون": 90,
    "التاسع": 9, "الثامن": 8, "السابع": 7, "السادس": 6, "الخامس": 5, "الرابع": 4, "الثالث": 3, "الثاني": 2, "الثانى": 2,
    "الأول": 1, "الاول": 1, "أول": 1, "اول": 1, "اولى": 1, "الأولى": 1,
    "دهم": 10, "بيستم": 20, "چهارم": 4, "پنجم": 5, "پانجم": 5, "ششم": 6, "هفتم": 7, "هشتم": 8, "نهم": 9, "دوم": 2, "سوم": 3,
}
TENS = {"العشرون": 20, "الثلاثون": 30, "الاربعون": 40, "الخمسون": 50, "الستون": 60, "السبعون": 70, "الثمانون": 80, "التسعون": 90}
# Letters and what they are compared as.
LETTERS, LETTERS_AS = "أإآٱةۀیئؤکھہۃ", "ااااههييوكههه"
SENTENCE_ENDS = "،؛:.؟!?—۔"
_EDGES = " .:-–—‎‏"
_DIGITS = str.maketrans(tx.ARABIC_DIGITS + tx.EXTENDED_DIGITS, tx.ASCII_DIGITS * 2)
_LETTERS = str.maketrans(LETTERS, LETTERS_AS)


def structural_fold(text: str) -> str:
    """Compatibility form, no marks, unified letters, lower case: what markers are compared in."""
    out = unicodedata.normalize("NFKC", text)
    return re.sub("[ـً-ٰٟۖ-ۭ]", "", out).translate(_LETTERS).lower()


@cache
def _tables() -> tuple[list[tuple[str, str]], dict[str, int], dict[str, int]]:
    words = [(kind, structural_fold(w)) for kind, ws in HEADING_WORDS.items() for w in ws]
    return words, {structural_fold(k): v for k, v in ORDINALS.items()}, {structural_fold(k): v for k, v in TENS.items()}


def ordinal(text: str) -> int | None:
    """An ordinal word, or a unit and a ten joined by wa."""
    _, known, tens = _tables()
    word = structural_fold(text.translate(_DIGITS)).strip()
    unit, joined, ten = re.sub(r"\s*و\s*(?=ال)", "\0", word).partition("\0")
    if joined and ten in tens and unit in known:
        return tens[ten] + known[unit] % 10
    return known.get(word)


def split_number(text: str) -> tuple[int | None, str]:
    """A number or ordinal at the beginning, and what follows it."""
    text = text.strip()
    head, _, rest = text.partition(" ")
    for n_words in (2, 1):
        parts = text.split(None, n_words)
        lead = " ".join(parts[:n_words]).rstrip(".:-–—")
        if len(parts) >= n_words and (value := ordinal(lead)) is not None:
            return value, parts[n_words].lstrip(_EDGES) if len(parts) > n_words else ""
    digits = head.rstrip(".:-–—").translate(_DIGITS)
    if digits.isascii() and digits.isdigit():
        return int(digits), rest.lstrip(_EDGES)
    return None, text


def _behind(line: str, n: int) -> str:
    """What follows in the line after characters that fold to n."""
    seen = 0
    for i, c in enumerate(line):
        seen += len(structural_fold(c))
        if seen >= n:
            return line[i + 1 :]
    return ""


def heading(line: str) -> dict | None:
    """level, title, number and kind of a line that surely is a heading: by its marker or dotted number."""
    text = line.strip()
    if not text or len(text) > 500:
        return None
    folded = structural_fold(text)
    for kind, word in _tables()[0]:
        if folded.startswith(word) and not folded[len(word) : len(word) + 1].isalnum():
            number, title = split_number(_behind(text, len(word)))
            return {"level": LEVEL[kind], "title": title.strip(_EDGES) or text, "number": number, "kind": kind}
    if m := re.match(r"\d+(?:\.\s*\d+)+", text.translate(_DIGITS)):
        depth = m.group().count(".") + 1
        return {"level": 3 if depth >= 3 else 2, "title": text[m.end() :].strip(_EDGES) or text, "number": None, "kind": "numbered"}
    return None


def candidate_heading(line: str, before: str | None, after: str | None) -> dict | None:
    """A short isolated line without a sentence end: possibly a heading, to be reviewed."""
    text = line.strip()
    alone = before is not None and after is not None and not before.strip() and not after.strip()
    if alone and 2 <= len(text.split()) <= 14 and len(text) <= 90 and text[-1] not in SENTENCE_ENDS:
        return {"level": 0, "title": text, "number": None, "kind": "candidate"}
    return None


_NUMBER = re.compile(r"\d{1,4}")
_FOOTNOTE = re.compile(r"[(（\[{]?\s*\d{1,3}[)）\]}]?\s*[:‎‏]?\s*[^\s.\d]|\*{1,3}\s*\S|[_\-─—]{3,}\s*$")


def _page_number(line: str) -> bool:
    return bool(_NUMBER.fullmatch(line.strip().translate(_DIGITS)))


def _footnote(line: str) -> bool:
    text = line.strip()
    return bool(text) and not _page_number(text) and bool(_FOOTNOTE.match(text.translate(_DIGITS)))


def _basmala(line: str) -> bool:
    low = line.lower()
    return low.startswith(tuple(tx.BASMALA)) or low == tx.BASMALA_LINE or tx.BASMALA_INSIDE in low


def segment(text: str, is_toc: bool) -> tuple[list[dict], int]:
    """Elements of one page in order, and how many page numbers were dropped."""
    lines, out, dropped = text.splitlines(), [], 0
    open_kind: str | None = None
    for i, raw in enumerate(lines):
        line = raw.strip()
        if not line:
            open_kind = None
        elif _page_number(line):
            dropped += 1
        elif is_toc:
            out.append({"type": "toc_entry", "text": raw})
        elif open_kind == "footnote":
            out[-1]["text"] += "\n" + raw
        elif _footnote(line):
            out.append({"type": "footnote", "text": raw})
            open_kind = "footnote"
        elif found := heading(raw):
            out.append({"type": "heading", "text": raw, **found})
            open_kind = None
        elif open_kind == "paragraph":
            out[-1]["text"] += "\n" + raw
        elif (found := candidate_heading(raw, lines[i - 1] if i else "", lines[i + 1] if i + 1 < len(lines) else "")) and not _basmala(line):
            out.append({"type": "heading", "text": raw, **found})
        else:
            out.append({"type": "paragraph", "text": raw})
            open_kind = "paragraph"
    return out, dropped


def line_classes(pages: DataFrame, key: str = "book_id") -> DataFrame:
    """``(key, page, line_no, kind)`` of each line that is not blank, by built-in expressions only."""
    rows = pages.select(key, "page", F.posexplode(tx.lines_of(F.col("text"))).alias("line_no", "line")).filter(tx.strip(F.col("line")) != "")
    c = F.col("line")
    kind = F.when(tx.is_page_number(c), "page_number").when(tx.is_toc_line(c), "toc_line").when(tx.is_footnote_start(c), "footnote").otherwise("text")
    return rows.select(key, "page", "line_no", kind.alias("kind"))


def toc_pages(pages: DataFrame, key: str = "book_id", first: int = 8, ratio: float = 0.6) -> DataFrame:
    """``(key, page)`` among the first pages whose lines mostly read like a table of contents."""
    rows = pages.filter(F.col("page") <= first).select(key, "page", F.explode(tx.lines_of(F.col("text"))).alias("line")).filter(tx.strip(F.col("line")) != "")
    body = rows.filter(~tx.is_page_number(F.col("line"))).groupBy(key, "page").agg(F.count(F.lit(1)).alias("n"), F.count_if(tx.is_toc_line(F.col("line"))).alias("toc"))
    return body.filter((F.col("n") >= 3) & (F.col("toc") >= 3) & (F.col("toc") >= ratio * F.col("n"))).select(key, "page")


class Plan:
    """Numbers of chapter, section and subsection along the elements of one book, in order.

    Chapter -1 is the table of contents, 0 what comes before the first chapter. A heading that repeats the
    open title on a later page is a running header and left out. An explicit number wins and raises the
    counter; sections count anew in each chapter. Paragraphs under a references heading are references.
    """

    def __init__(self) -> None:
        self.at = {1: 0, 2: 0, 3: 0}
        self.opened: dict[int, tuple[str, int]] = {}
        self.references = False

    def add(self, page: int, is_toc: bool, e: dict) -> dict | None:
        at, opened, review = self.at, self.opened, False
        if e["type"] == "heading" and e["level"]:
            level, folded = e["level"], structural_fold(e["title"])
            if level in opened and opened[level] == (folded, opened[level][1]) and opened[level][1] < page:
                return None
            review = level > 1 and at[level - 1] == 0
            at[level] = e["number"] if e.get("number") is not None else at[level] + 1
            for lower in range(level + 1, 4):
                at[lower] = 0
                opened.pop(lower, None)
            opened[level] = (folded, page)
            if level == 1:
                self.references = e["kind"] == "references"
        elif e["type"] == "heading":
            review = True
        kind = "reference" if e["type"] == "paragraph" and self.references else e["type"]
        return {"page": page, "type": kind, "text": e["text"], "chapter_no": -1 if is_toc else at[1], "section_no": None if is_toc else at[2] or None, "subsection_no": None if is_toc else at[3] or None, "review": review}


def structure_books(pages: DataFrame, key: str = "book_id") -> DataFrame:
    """Blocks of every book from ``(key, page, text)``: type, text, place in the plan, sequence within the page.

    Pages are cut into elements wherever they are; only then the elements of a book meet, in order, and a task
    walks along its books holding nothing but the open titles, so that no book has to fit in memory. Pages of one
    number follow each other by the digest of their texts.
    """
    toc = toc_pages(pages, key).withColumn("_toc", F.lit(True))
    rows = pages.join(toc, [key, "page"], "left").select(F.col(key).cast("string").alias("book"), F.col("page").cast("int").alias("page"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("_toc", F.lit(False)).alias("toc"))
    found = "book string, page int, toc boolean, digest string, nth int, type string, text string, level int, title string, number int, kind string"
    names = [c.split()[0] for c in found.split(", ")]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            out = []
            for book, page, text, is_toc, digest in zip(g["book"], g["page"], g["text"], g["toc"], g["digest"]):
                for i, e in enumerate(segment(text, is_toc)[0]):
                    out.append((book, page, is_toc, digest, i, e["type"], e["text"], e.get("level"), e.get("title"), e.get("number"), e.get("kind")))
            yield pd.DataFrame(out, columns=names).astype({"page": "Int32", "level": "Int32", "number": "Int32"})

    schema = "book string, page int, sequence int, type string, text string, chapter_no int, section_no int, subsection_no int, review boolean"
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    arrow = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, page, sequence, plan = object(), None, 0, Plan()
        for batch in batches:
            out = []
            for e in batch.to_pylist():
                if e["book"] != book:
                    book, page, plan = e["book"], None, Plan()
                if e["page"] != page:
                    page, sequence = e["page"], 0
                if (block := plan.add(e["page"] or 0, e["toc"], e)) is not None:
                    sequence += 1
                    out.append(block | {"book": book, "page": e["page"], "sequence": sequence})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    elements = rows.withColumn("digest", F.sha2("text", 256)).mapInPandas(cut, found)
    ordered = elements.repartition("book").sortWithinPartitions("book", F.asc_nulls_first("page"), "digest", "nth")
    return ordered.mapInArrow(walk, schema).withColumnRenamed("book", key)


def tables(blocks: DataFrame, key: str = "book_id") -> dict[str, DataFrame]:
    """What a structured book is stored as: chapters, sections, subsections, pages, paragraphs and blocks, with ids
    from the natural keys, so that a second run writes the same."""
    def named(kind: str, *keys: str) -> DataFrame:
        rows = blocks.filter(" and ".join(f"{k} is not null" for k in keys if k != key) or "true")
        title = F.min_by(F.when(F.col("type") == "heading", F.col("text")), F.struct((F.col("type") != "heading"), "page", "sequence"))
        out = rows.groupBy(*keys).agg(title.alias("title"), F.min("page").alias("first_page"), F.max("page").alias("last_page"))
        return out.withColumn("id", F.sha2(F.concat_ws(":", F.lit(kind), *keys), 256))

    numbered = blocks.withColumn("id", F.sha2(F.concat_ws(":", F.lit("block"), key, "page", "sequence"), 256))
    return {
        "chapters": named("chapter", key, "chapter_no"),
        "sections": named("section", key, "chapter_no", "section_no"),
        "subsections": named("subsection", key, "chapter_no", "section_no", "subsection_no"),
        "pages": blocks.groupBy(key, "page").agg(F.count(F.lit(1)).alias("blocks")),
        "paragraphs": numbered.filter("type = 'paragraph'").select("id", key, "page", "sequence", "text"),
        "blocks": numbered,
    }


def headings(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, line_no, level, title, number, kind)`` of all sure headings, in one Arrow pass."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for k, t in zip(rows["_k"], rows["_t"]):
                for i, line in enumerate((t or "").splitlines()):
                    if h := heading(line):
                        out.append((k, i, h["level"], h["title"], h["number"], h["kind"]))
            yield pd.DataFrame(out, columns=["key", "line_no", "level", "title", "number", "kind"]).astype({"number": "Int64"})

    got = df.select(F.col(key).cast("string").alias("_k"), F.col(text).alias("_t")).mapInPandas(run, "key string, line_no int, level int, title string, number int, kind string")
    return got.withColumnRenamed("key", key)
