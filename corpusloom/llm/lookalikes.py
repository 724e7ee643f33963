"""Texts that look the same though their characters differ: one form by a confusables skeleton."""

from __future__ import annotations

import hashlib
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.textblocks import WHITE_SPACE
from corpusloom.session import field, materialize

# Letters of one script drawn like a letter of another, each with its prototype.
GREEK = {"Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j"}
CYRILLIC = {"А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ԛ": "Q", "Ԝ": "W", "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ѵ": "v"}
ARMENIAN = {"Տ": "S", "Օ": "O", "Ս": "U", "օ": "o", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "յ": "j"}
COPTIC = {"Ⲁ": "A", "Ⲃ": "B", "Ⲉ": "E", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "ⲟ": "o", "Ⲣ": "P", "ⲣ": "p", "Ⲥ": "C", "ⲥ": "c", "Ⲧ": "T", "Ⲩ": "Y", "Ⲭ": "X"}
CHEROKEE = {"Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z"}
LISU = {"ꓮ": "A", "ꓐ": "B", "ꓚ": "C", "ꓓ": "D", "ꓰ": "E", "ꓝ": "F", "ꓖ": "G", "ꓧ": "H", "ꓲ": "I", "ꓙ": "J", "ꓗ": "K", "ꓡ": "L", "ꓟ": "M", "ꓠ": "N", "ꓳ": "O", "ꓑ": "P", "ꓣ": "R", "ꓢ": "S", "ꓔ": "T", "ꓴ": "U", "ꓦ": "V", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓜ": "Z"}
LATIN = {"ı": "i", "ɑ": "a", "ɡ": "g", "ſ": "f"}
ARABIC = {"ك": "ک", "ي": "ی", "ى": "ی", "ه": "ہ", "ھ": "ہ", "ە": "ہ"}
DIGITS = {"۰": "٠", "۱": "١", "۲": "٢", "۳": "٣", "۷": "٧", "۸": "٨", "۹": "٩"}

#: Tags of compatibility decompositions that keep the look but for width, weight, slant, ligature or joining form.
SAME_LOOK = {"<font>", "<wide>", "<narrow>", "<compat>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>"}
#: Characters without a look of their own, besides those of category Cf: fillers and variation selectors.
UNSEEN = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0x180B, 0x180E)]


@cache
def prototypes() -> dict[int, str]:
    """str.translate table: look-alikes, width and joining forms by rule, blanks to one, unseen to none."""
    table: dict[int, str] = {}
    for c in range(0x80, 0x110000):
        if 0xD800 <= c < 0xE000 or 0x3400 <= c < 0xA000 or 0xAC00 <= c < 0xD7A4 or 0x20000 <= c < 0xE0000:
            continue
        ch = chr(c)
        parts = unicodedata.decomposition(ch).split()
        if parts and parts[0] in SAME_LOOK:
            table[c] = "".join(chr(int(x, 16)) for x in parts[1:])
        if unicodedata.category(ch) == "Cf":
            table[c] = ""
    for c in (*range(0x20), 0x7F, *UNSEEN):
        table[c] = ""
    for c in WHITE_SPACE:
        table[c] = " "
    for pairs in (GREEK, CYRILLIC, ARMENIAN, COPTIC, CHEROKEE, LISU, LATIN, ARABIC, DIGITS):
        table |= {ord(a): b for a, b in pairs.items()}
    for c in list(table):  # to the end of chains, e.g. a presentation form of a letter with a prototype
        while (new := unicodedata.normalize("NFD", table[c]).translate(table)) != table[c]:
            table[c] = new
    return table


def skeleton(text: str) -> str:
    """Decompose, replace every character by its prototype, decompose again; blanks become one, ends none.

    Equal skeletons mean equal looks: width, kind and number of blanks and invisible characters do not
    count, letter case, accents, vowel signs, hamza, values of digits, punctuation and words do; so that l, I
    and 1 stay apart, which are two letters and a digit.
    """
    out = text if text.isascii() else unicodedata.normalize("NFD", text)
    out = out.translate(prototypes())
    return " ".join((out if out.isascii() else unicodedata.normalize("NFD", out)).split())


def one_form(text: str) -> str:
    """The skeleton, composed: what every text of this look is written as."""
    return unicodedata.normalize("NFC", skeleton(text))


@F.pandas_udf(T.StringType())
def _skeleton_key(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else hashlib.md5(skeleton(t).encode("utf-8", "surrogatepass")).hexdigest())


@F.pandas_udf(T.StringType())
def _one_form(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else one_form(t))


def normalized(df: DataFrame, *, key: str = "content_block_id", text: str = "original_text") -> DataFrame:
    """``(key, normalized_text)`` of each row: texts of equal look get equal strings, null stays null. Repeated
    rows come out repeatedly; no text is shuffled."""
    return df.select(field(key).alias(key), _one_form(field(text).cast("string")).alias("normalized_text"))


def look_classes(df: DataFrame, *, key: str = "content_block_id", text: str = "original_text") -> DataFrame:
    """``(key, look, spelling)`` for each distinct key and text: digests of the skeleton and of the text.

    Equal ``look`` is the class of texts that look the same; null texts are in no class and left out.
    Only digests are shuffled, never texts.
    """
    t = field(text).cast("string")
    rows = df.filter(t.isNotNull()).select(field(key).alias(key), _skeleton_key(t).alias("look"), F.md5(t).alias("spelling"))
    return rows.distinct()


def look_alike_pairs(df: DataFrame, *, key: str = "content_block_id", text: str = "original_text", expand: int | None = None) -> DataFrame:
    """``(key_a, key_b)``, the smaller first: keys whose texts look the same but are different strings.

    Every pair comes out, so masses of copies of two spellings multiply; ``look_classes`` says the same in a
    row for each key. With ``expand``, a spelling that more keys share is represented by the smallest. Empty texts and texts of blanks only
    look alike. A key with two spellings is not paired with itself.
    """
    rows = materialize(look_classes(df, key=key, text=text).select(field(key).cast("string").alias("_key"), "look", "spelling").filter(F.col("_key").isNotNull()))  # digests
    several = rows.groupBy("look").agg(F.min("spelling").alias("_first"), F.max("spelling").alias("_last")).filter("_first <> _last").select("look")
    shown = rows.join(several, "look", "left_semi")
    if expand is not None:
        size = shown.groupBy("look", "spelling").agg(F.min("_key").alias("_rep"), F.count(F.lit(1)).alias("_n"))
        shown = shown.join(size, ["look", "spelling"]).filter((F.col("_n") <= expand) | (F.col("_key") == F.col("_rep"))).select("look", "spelling", "_key")
    a = shown.select("look", F.col("spelling").alias("_sa"), F.col("_key").alias("_a"))
    b = shown.select("look", F.col("spelling").alias("_sb"), F.col("_key").alias("_b"))
    pairs = a.join(b, "look").filter((F.col("_sa") != F.col("_sb")) & (F.col("_a") < F.col("_b")))
    return pairs.select(F.col("_a").alias("key_a"), F.col("_b").alias("key_b")).distinct()
