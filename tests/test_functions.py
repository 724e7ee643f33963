import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as tx


def one(spark, expr, **cols):
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in cols.items()) or "x int"
    return spark.createDataFrame([tuple(cols.values()) or (1,)], schema).select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize("text,lang,n", [("abcd", "en", 1), ("abcde", "en", 2), ("ا" * 7, "ar", 3), ("", "en", 1), ("abcdef", "ur", 2)])
def test_token_estimate(spark, text, lang, n):
    assert one(spark, tx.token_estimate(F.col("t"), F.col("l")), t=text, l=lang) == n


@pytest.mark.parametrize("text,hint", [("نص عربي", "ar"), ("یہ ایک کتاب ہے گچپ", "ur"), ("mostly Latin with one ب", "ar"), ("ﻛﺘﺎب", "ar"), ("plain text", "en"), ("123 !", None)])
def test_script_hint(spark, text, hint):
    assert one(spark, tx.script_hint(F.col("t")), t=text) == hint


def test_layout(spark):
    assert one(spark, tx.unify_breaks(F.col("t")), t="a\r\nb\rc\f\n\n\nd") == "a\nb\nc\n\nd"
    assert one(spark, tx.collapse_blanks(F.col("t")), t="a \t  b  \n c ") == "a b\n c"


def test_folds_leave_protected_text(spark):
    assert one(spark, tx.normalize_text(F.col("t"), F.lit("ar")), t="أحمد إلى") == "احمد الى"
    assert one(spark, tx.normalize_text(F.col("t"), F.lit("ar")), t="أحمد ﷺ") == "أحمد ﷺ"
    assert one(spark, tx.normalize_text(F.col("t"), F.lit("ar")), t="رواه أحمد ١") == "رواه أحمد ١"
    assert one(spark, tx.normalize_text(F.col("t"), F.lit("ar")), t="ٱمرأة ١ى") == "ٱمراة 1ى"
    assert one(spark, tx.normalize_text(F.col("t"), F.lit("ar"), "full"), t="امرأة ١ى") == "امراه 1ي"
    assert one(spark, tx.normalize_text(F.col("t"), F.lit("ur")), t="أھی ۱") == "أھی 1"
    assert one(spark, tx.fold_letters(F.col("t"), urdu=True), t="ھی") == "ہے"
    assert one(spark, tx.normalize_text(F.col("t"), F.lit("en"), "conservative"), t="کتـاب") == "کتاب"


@pytest.mark.parametrize("form", ["NFC", "NFKC"])
def test_forms_reach_every_text_they_change(spark, form):
    import unicodedata

    texts = [chr(c) for c in range(0x80, 0x30000, 7) if not 0xD800 <= c < 0xE000] + ["e\u0301", "\u1100\u1161\u11a8", "ا\u0653", "ascii", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.unicode_form(F.col("t"), form).alias("f"))
    assert all(unicodedata.normalize(form, r["t"]) == r["f"] for r in df.collect())


def test_search_fold_drops_vowel_signs(spark):
    assert one(spark, tx.search_fold(F.col("t")), t="بِسْمِ ٱللَّهِ إلى") == "بسم الله الي"


@pytest.mark.parametrize("text,quality", [(None, "blank"), ("  \n", "blank"), ("good words here", "ok"), ("1234 5678 99", "garbled"), ("a???b", "garbled")])
def test_extract_quality(spark, text, quality):
    assert one(spark, tx.extract_quality(F.col("t")), t=text) == quality


@pytest.mark.parametrize("text,conf,notes", [("a good long text that is quite all right", 90.0, []), ("", 90.0, ["no_text"]), ("short", 20.0, ["low_confidence=20.0", "very_short_text=5"]), ("1234567890 1234567890 1234567890 12", 90.0, ["low_alpha_ratio=0.00"]), ("", 10.0, ["no_text"])])
def test_ocr_notes(spark, text, conf, notes):
    assert one(spark, tx.ocr_notes(F.col("t"), F.col("c")), t=text, c=conf) == notes


@pytest.mark.parametrize("line,kind", [("12", "number"), ("١٢٣", "number"), ("12345", None), ("Chapter one ..... 7", "toc"), ("plain line", None)])
def test_line_tests(spark, line, kind):
    assert one(spark, tx.is_page_number(F.col("t")), t=line) == (kind == "number")
    if kind == "toc":
        assert one(spark, tx.is_toc_line(F.col("t")), t=line)


@pytest.mark.parametrize("text,ok", [("XIV", True), ("IIII", False), ("MMXX", True), ("ABC", False)])
def test_roman(spark, text, ok):
    assert one(spark, tx.is_roman(F.col("t")), t=text) == ok


def test_trigram_similarity(spark):
    assert one(spark, tx.similarity(F.col("a"), F.col("b")), a="word", b="word") == 1.0
    assert one(spark, tx.similarity(F.col("a"), F.col("b")), a="word", b="two words") == pytest.approx(4 / 11)
    assert one(spark, tx.similarity(F.col("a"), F.col("b")), a="", b=None) == 0.0


def test_values(spark):
    assert one(spark, tx.clean_value(F.col("t")), t=" – : A  value ؛") == "A value"
    assert one(spark, tx.clean_value(F.col("t")), t="- A value –") == "A value –"
    refs = {"quran": "Baqarah:2 (en by T)", "hadith": "C #2 B", "book": "T, ch. X, p. 2, k"}
    for kind, ref in refs.items():
        c = F.lit
        assert one(spark, tx.citation(F.col("t"), surah_name=c("Baqarah"), verse=c(2), language=c("en"), translator=c("T"), collection=c("C"), number=c(2), book=c("B"), title=c("T"), chapter=c("X"), section=c(None), page=c(2), chunk_id=c("k")), t=kind) == ref
    assert one(spark, tx.slug(F.col("t")), t="  Some Title: 2nd! ") == "some-title-2nd"
    assert one(spark, tx.squeeze(F.col("t")), t=" a \n b ") == "a b"
