"""Text normalisation, estimates and tests as Column expressions (Unicode forms through one Arrow UDF)."""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
ARABIC_DIGITS, EXTENDED_DIGITS, ASCII_DIGITS = "٠١٢٣٤٥٦٧٨٩", "۰۱۲۳۴۵۶۷۸۹", "0123456789"
TATWEEL = "ـ"
PROTECTED_MARKS = ["\ufdf2", "\ufd3f", "\ufd3e", "\ufdfa", "\ufdfb", "بسم الله", "قال رسول الله", "رواه"]
HAMZA_FOLD = ("أؤإآ", "اواا")
FULL_FOLD = ("ةى", "هي")
URDU_FOLD = ("ھی", "ہے")
URDU_QUERY_LETTERS = "ٹڈڑںہےئ"
URDU_PAGE_LETTERS = "\u06be\u06ba\u06d2\u06cc\u0679\u0688\u06af\u06c1"
ARABIC_RANGES = "\u0600-\u06ff\u0750-\u077f\ufb50-\ufdff\ufe70-\ufeff"
LEADERS = ".\u2026\u0092\u00b7\u2024"
BASMALA = ["بسم", "بِسْم", "بسملہ"]
BASMALA_LINE, BASMALA_INSIDE = "الرحمن الرحيم", "بِسْمِ اللَّهِ"

#: White space as a set of characters and as the inside of a character class.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
BLANK_CLASS = r"\t-\r\x1c- \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Where a text is cut into lines.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))


@cache
def _unstable(form: str) -> str:
    """A character class of all that the form may change: marks, joining vowels, what has another form; rounded up
    to few ranges, but for the scripts up to U+0780, as a class costs the more the more ranges it has."""
    def may(c: int) -> bool:
        ch = chr(c)
        return unicodedata.category(ch)[0] == "M" or 0x1160 <= c < 0x1200 or unicodedata.normalize(form, ch) != ch

    ranges: list[list[int]] = []
    for c in range(0x80, 0x30000):
        if not 0xD800 <= c < 0xE000 and may(c):
            if ranges and c - ranges[-1][1] <= (1 if c < 0x780 else 0x200):
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "\\x{E0100}-\\x{E01EF}]"


def unicode_form(c: Column, form: str = "NFC") -> Column:
    """The text in that form; ``none`` leaves it. Spark has no built-in for it, so that texts with a character
    the form may change go through Python, and only these."""
    if form == "none":
        return c
    first = {"NFC": "[^\\x00-\\x{2ff}]", "NFKC": "[^\\x00-\\x7f]"}[form]  # quick to rule out
    there = F.when(c.rlike(first), c.rlike(_unstable(form))).otherwise(F.lit(False))
    return F.coalesce({"NFC": _nfc, "NFKC": _nfkc}[form](F.when(there, c)), c)


def strip(c: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.btrim(c, F.lit(BLANKS))


def lines_of(c: Column) -> Column:
    """The lines of a text, cut at line breaks of every kind."""
    return F.split(c, LINE_BREAK)


def unify_breaks(c: Column) -> Column:
    """CRLF, CR and form feed become line feeds, three or more of them two."""
    return F.regexp_replace(F.regexp_replace(c, "\r\n|\r|\f", "\n"), "\n{3,}", "\n\n")


def collapse_blanks(c: Column) -> Column:
    """Runs of blanks, tabs and no-break spaces become one blank; none stays at the end of a line."""
    return F.regexp_replace(F.regexp_replace(c, "[ \t\x0b\f ]+", " "), "(?m)[ \t]+$", "")


def fold_digits(c: Column) -> Column:
    return F.translate(c, ARABIC_DIGITS + EXTENDED_DIGITS, ASCII_DIGITS * 2)


def is_protected(c: Column) -> Column:
    """Whether a mark is there that no fold may touch."""
    out = F.lit(False)
    for mark in PROTECTED_MARKS:
        out = out | c.contains(mark)
    return out


def fold_letters(c: Column, *, hamza: bool = False, full: bool = False, urdu: bool = False, digits: bool = False) -> Column:
    for wanted, (a, b) in ((hamza, HAMZA_FOLD), (full, FULL_FOLD), (urdu, URDU_FOLD)):
        c = F.translate(c, a, b) if wanted else c
    return fold_digits(c) if digits else c


def normalize_text(c: Column, language: Column, config: str = "auto", form: str = "NFC") -> Column:
    """Layout, Unicode form, blanks, tatweel; then folds, unless the original is protected.

    ``conservative`` folds nothing, ``search`` hamza and digits, ``full`` teh marbuta and alef maqsura besides,
    ``auto`` is ``search`` for Arabic, digits only for Urdu and ``conservative`` for the rest.
    """
    base = F.translate(collapse_blanks(unicode_form(unify_breaks(c), form)), TATWEEL, "")
    if config == "conservative":
        return base
    folded = fold_letters(base, hamza=True, full=config == "full", digits=True)
    if config == "auto":
        folded = F.when(language == "ar", folded).when(language == "ur", fold_digits(base)).otherwise(base)
    return F.when(is_protected(c), base).otherwise(folded)


def search_fold(c: Column) -> Column:
    """What Arabic text is indexed and asked as: no marks, unified alef and yeh."""
    bare = F.regexp_replace(c, "[ـً-ٰٟ]", "")
    return F.translate(unicode_form(bare), "ٱآأإى", "ااااي")


def language_code(c: Column) -> Column:
    """The code of a language label by its usual names; ``other`` for the rest."""
    name = F.lower(F.trim(c))
    return F.when(name.isin("ar", "ara", "arabic"), "ar").when(name.isin("ur", "urd", "urdu"), "ur").when(name.isin("en", "eng", "english"), "en").otherwise("other")


def search_config(language: Column) -> Column:
    """The analyser of a language code: arabic, english or simple. All three cut words alike here; stemming, which
    tells them apart elsewhere, is a plug-in."""
    code = F.lower(language)
    return F.when(code == "ar", "arabic").when(code == "en", "english").otherwise("simple")


def token_estimate(c: Column, language: Column) -> Column:
    """At least 1: code points over 3 for Arabic and Urdu, over 4 else, rounded up."""
    return F.greatest(F.lit(1), F.ceil(F.length(c) / F.when(language.isin("ar", "ur"), 3).otherwise(4))).cast("long")


def script_hint(c: Column) -> Column:
    """ur, ar or en by the letters; null without any. One Arabic letter decides against en; Urdu needs 3 own
    letters, or one for each 20 Arabic ones if that is more."""
    arabic = F.regexp_count(c, F.lit(f"[{ARABIC_RANGES}]"))
    urdu = F.regexp_count(c, F.lit(f"[{URDU_PAGE_LETTERS}]"))
    is_urdu = urdu >= F.greatest(F.lit(3), F.floor(arabic / 20))
    return F.when(arabic > 0, F.when(is_urdu, "ur").otherwise("ar")).when(c.rlike("[A-Za-z]"), "en")


def letters(c: Column) -> Column:
    return F.regexp_count(c, F.lit("\\p{L}"))


def visible(c: Column) -> Column:
    """Characters that are no white space."""
    return F.length(F.translate(c, BLANKS, ""))


def extract_quality(c: Column) -> Column:
    """blank; garbled with under half letters or over 30 % question marks; else ok."""
    n = visible(c)
    garbled = (letters(c) < 0.5 * n) | (F.length(c) - F.length(F.replace(c, F.lit("?"), F.lit(""))) > 0.3 * n)
    return F.when(c.isNull() | (n == 0), "blank").when(garbled, "garbled").otherwise("ok")


def density_band(chars: Column) -> Column:
    return F.when(chars == 0, "none").when(chars <= 200, "low").when(chars <= 1200, "medium").otherwise("high")


def ocr_notes(c: Column, confidence: Column) -> Column:
    """Why a recognised page needs review: an array, empty if it does not. An empty page has one reason only."""
    n, share = visible(c), letters(c) / visible(c)
    return F.when(n == 0, F.array(F.lit("no_text"))).otherwise(
        F.array_compact(
            F.array(
                F.when(confidence < 50, F.concat(F.lit("low_confidence="), F.format_number(confidence, 1))),
                F.when(n < 30, F.concat(F.lit("very_short_text="), n.cast("string"))),
                F.when(share < 0.5, F.concat(F.lit("low_alpha_ratio="), F.format_number(share, 2))),
            )
        )
    )


def is_basmala(c: Column) -> Column:
    line = F.lower(strip(c))
    out = (line == BASMALA_LINE) | line.contains(BASMALA_INSIDE)
    for start in BASMALA:
        out = out | line.startswith(start)
    return out


def squeeze(c: Column) -> Column:
    """White space of any kind single, and none at the ends."""
    return F.trim(F.regexp_replace(c, f"[{BLANK_CLASS}]+", " "))


def clean_value(c: Column) -> Column:
    """A field value without marks and blanks at its ends (dashes of any kind before, hyphens behind), inner
    blanks single."""
    marks = BLANK_CLASS + "؛،:;\u200e\u200f"
    return squeeze(F.regexp_replace(F.regexp_replace(c, f"^[{marks}\\-–—]+", ""), f"[{marks}\\-]+$", ""))


def slug(c: Column, most: int = 64) -> Column:
    return F.left(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(most))


def is_page_number(c: Column) -> Column:
    return strip(c).rlike("^[0-9٠-٩۰-۹]{1,4}$")


def is_toc_line(c: Column) -> Column:
    """A short line with three leader dots or ending in a number after them."""
    line = strip(c)
    leaders = F.length(line) - F.length(F.translate(line, LEADERS, ""))
    return (F.length(line) > 0) & (F.length(line) <= 140) & ((leaders >= 3) | line.rlike("[0-9٠-٩۰-۹]$"))


def is_footnote_start(c: Column) -> Column:
    line = strip(c)
    gap = f"[{BLANK_CLASS}]*"
    marker = line.rlike(f"^[(（\\[{{]?{gap}[0-9٠-٩۰-۹]{{1,3}}[)）\\]}}]?{gap}[:\u200f\u200e]?{gap}[^{BLANK_CLASS}.0-9٠-٩۰-۹]")
    return ~is_page_number(c) & (marker | line.rlike(f"^\\*{{1,3}}{gap}[^{BLANK_CLASS}]") | line.rlike("^[_\\-\u2500\u2014]{3,}$"))


def is_roman(c: Column) -> Column:
    return F.trim(c).rlike("^(?=[MDCLXVI])M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$")


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def trigrams(c: Column) -> Column:
    """Distinct trigrams of the words, each with two blanks before and one behind."""
    padded = F.transform(tokens(c), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams; 0 if there are none."""
    x, y = trigrams(a), trigrams(b)
    every = F.size(F.array_union(x, y))
    return F.when(every > 0, F.size(F.array_intersect(x, y)) / every).otherwise(F.lit(0.0))


def citation(source_type: Column, **at: Column) -> Column:
    """The reference of a hit, of the columns given by name; a missing one is left out.

    ``quran``: surah_name or surah, verse, language, translator. ``hadith``: collection, number, book.
    Others: title or book_id, chapter, section, page, chunk_id.
    """
    null = F.lit(None).cast("string")

    def of(name: str, before: str = "", after: str = "") -> Column:
        c = at.get(name, null).cast("string")
        return F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(before), c, F.lit(after)))

    verse = F.concat(F.coalesce(of("surah_name"), of("surah"), F.lit("?")), F.lit(":"), F.coalesce(of("verse"), F.lit("?")))
    told = F.when(of("language").isNotNull(), F.concat(F.lit(" ("), of("language"), F.lit(" by "), F.coalesce(of("translator"), F.lit("?")), F.lit(")")))
    report = F.concat_ws(" ", F.coalesce(of("collection"), F.lit("collection")), of("number", "#"), of("book"))
    passage = F.concat_ws(", ", F.coalesce(of("title"), of("book_id"), F.lit("book")), of("chapter", "ch. "), of("section"), of("page", "p. "), of("chunk_id"))
    return F.when(source_type == "quran", F.concat(verse, F.coalesce(told, F.lit("")))).when(source_type == "hadith", report).otherwise(passage)
