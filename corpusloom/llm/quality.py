"""Statistics of each text's form, and a classifier that tells running prose from other matter."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusloom.llm.textblocks import Block, blocks, folding, major_class, prefix_sums, slice_hash, text_hash
from corpusloom.session import field

# Frequent words of running text, by language.
COMMON_WORDS = {
    "en": "the of and a to in is was that it for on with as he she they at by from this had not are but have an his her which or we you were been one all their there when who will more no if out so up said what about into than them can only other time some could these two may then do its first any my now such like our over me even most made after also did many before must through back years where much your way well down should because each just those people how too little good very make still own see men work long get here between both life being under never day same another know while last might us great old year off come since against go came right used take three without once",
    "fr": "le la les de du des un une et en est que qui dans il elle pour pas ne sur se au aux ce cette ces par plus avec son sa ses on nous vous ils elles mais ou comme si leur sans fait tout tous a ont été être avoir l d n s c qu lui y dont même après avant avait sont ni quand où deux bien très peu encore",
    "id": "yang dan di ke dari pada untuk dengan itu ini tidak ada oleh akan dalam adalah atau juga saya kami mereka dia ia telah sudah bahwa sebagai karena para seorang satu sebelum sesudah setelah ketika jika maka tentang lebih tanpa setiap sang hanya pernah harus lalu kembali sejak sampai meskipun antara daripada milik",
    "ar": "في من على عن إلى أن إن لا ما هذا هذه ذلك الذي التي كان قد لم لن ثم أو حتى عند مع بعد قبل كل هو هي وهو وهي وما ولا ومن وفي وقد مما فيه منه عليه به له ومعه إلا بما بين أمام غير يكون كانت وكان فقد فإن وحين ولما حين لما وهذا ولم كما وحده ومنه",
    "ur": "کے کی کا کو میں سے نے ہے اور پر یہ وہ اس ہیں تھا تھی تھے کر کہ جو تو ہی بھی نہیں ایک گیا گئی لیے ساتھ تک کیا ہم اسے اپنے جب پھر بعد پہلے دوران اگرچہ لیکن مل دو کچھ بارے والے ہو رہا ان انھیں متعلق معلوم پاس اب لیا دیا کوئی",
}

STATISTICS = ["chars", "words", "mean_word_length", "letter_ratio", "digit_ratio", "symbol_ratio", "space_ratio", "control_ratio", "upper_ratio", "lines", "mean_line_chars", "punctuated_lines", "numbered_lines", "short_lines", "listed_lines", "repeated_lines", "common_words", "prose_line_share", "distinct_words", "top_word_share", "sentence_ends", "commas", "brackets", "long_words", "char_repeats", "common_gap", "word_repeats"]
_AT = {name: i for i, name in enumerate(STATISTICS)}


@cache
def _tables() -> dict[str, np.ndarray]:
    major = major_class()

    def those(chars: str) -> np.ndarray:
        out = np.zeros(0x110000, bool)
        out[[ord(c) for c in chars]] = True
        return out

    upper = np.zeros(0x110000, bool)
    upper[[c for c in range(0x500) if chr(c).isupper()]] = True
    words = np.unique(text_hash([w for text in COMMON_WORDS.values() for w in text.split()]))
    return {"major": major, "upper": upper, "end": those(".!?؟۔…"), "comma": those(",،;؛"), "bracket": those("<>{}[]|\\=_#*&%$@~^`/"), "close": those("\"'”»’)]"), "bullet": those("-*•·–—+>#"), "words": words}


def _per_line(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(values))
    return total[first[1:]] - total[first[:-1]]


def measure(b: Block) -> np.ndarray:
    """One row of STATISTICS for each text of the block."""
    t, n = _tables(), len(b.texts)
    out = np.zeros((n, len(STATISTICS)))
    cp = b.cp
    if not len(cp):
        return out
    chars = np.maximum(np.diff(b.start), 1).astype(float)
    major = t["major"][cp]
    letter, digit, space, mark = major == 76, major == 78, major == 87, major == 77
    symbol, control = (major == 83) | (major == 80), major == 67
    for name, flag in (("letter_ratio", letter | mark), ("digit_ratio", digit), ("symbol_ratio", symbol), ("space_ratio", space), ("control_ratio", control | (cp == 0xFFFD)), ("upper_ratio", t["upper"][cp]), ("sentence_ends", t["end"][cp]), ("commas", t["comma"][cp]), ("brackets", t["bracket"][cp])):
        out[:, _AT[name]] = b.sums(flag) / chars
    same = np.zeros(len(cp), bool)
    same[1:] = (cp[1:] == cp[:-1]) & ~letter[1:]
    out[:, _AT["char_repeats"]] = b.sums(same) / chars

    # lines: cut after each line break and at each text
    stop = np.zeros(len(cp) + 1, bool)
    stop[1:][(cp == 10) | (cp == 0x2028) | (cp == 0x2029) | ((cp == 13) & (np.append(cp[1:], 0) != 10))] = True
    stop[b.start] = True
    stop[0] = True
    line = np.flatnonzero(stop[:-1])
    edges = np.append(line, len(cp))
    owner = np.searchsorted(b.start, line, "right") - 1
    seen = _per_line(~space, edges)
    keep = seen > 0

    # words: runs of letters and marks in folded text, without characters that fold to nothing
    folded = folding()[cp]
    shown = np.flatnonzero(folded > 0)
    f, text = folded[shown], b.text_of_char()[shown]
    wordy = letter[shown] | mark[shown] | (f == 0x27) & False
    new_text = np.append(True, text[1:] != text[:-1])
    begin = np.flatnonzero(wordy & (np.append(True, ~wordy[:-1]) | new_text))
    finish = np.flatnonzero(wordy & np.append(~wordy[1:] | new_text[1:], True)) + 1
    length = (finish - begin).astype(float)
    h = slice_hash(prefix_sums(f), begin, finish)
    common = np.isin(h, t["words"])
    of, at = text[begin], shown[begin]
    words = np.bincount(of, minlength=n).astype(float)
    some = np.maximum(words, 1)
    out[:, _AT["chars"]], out[:, _AT["words"]] = np.diff(b.start), words
    out[:, _AT["mean_word_length"]] = np.bincount(of, length, n) / some
    out[:, _AT["common_words"]] = np.bincount(of, common, n) / some
    out[:, _AT["long_words"]] = np.bincount(of, np.where(length > 20, length, 0), n) / chars
    order = np.lexsort((h, of))
    ho, oo = h[order], of[order]
    fresh = np.append(True, (ho[1:] != ho[:-1]) | (oo[1:] != oo[:-1])) if len(ho) else np.zeros(0, bool)
    out[:, _AT["distinct_words"]] = np.bincount(oo, fresh, n) / some
    if len(ho):
        first = np.flatnonzero(fresh)
        size = np.diff(np.append(first, len(ho)))
        rare = ~np.isin(ho[first], t["words"])
        np.maximum.at(out[:, _AT["top_word_share"]], oo[first][rare], (size[rare] / some[oo[first][rare]]))
        # longest stretch without a common word, as a share of the words; repeats of a word or of one two before
        back = np.append(0, np.cumsum(common))
        where = np.arange(len(h))
        last = np.maximum.accumulate(np.where(common | np.append(True, of[1:] != of[:-1]), where, 0))
        gap = (where - last).astype(float)
        np.maximum.at(out[:, _AT["common_gap"]], of, gap / some[of])
        again = np.zeros(len(h), bool)
        again[1:] |= (h[1:] == h[:-1]) & (of[1:] == of[:-1])
        again[2:] |= (h[2:] == h[:-2]) & (of[2:] == of[:-2])
        out[:, _AT["word_repeats"]] = np.bincount(of, again, n) / some
        del back

    per = np.searchsorted(at, edges)  # words by line
    n_words, n_common = np.diff(per).astype(float), _per_line(common, per)
    digits, breaks, ends = _per_line(digit, edges), _per_line(t["bracket"][cp] | (cp == 9), edges), _per_line(t["end"][cp], edges)
    solid = np.flatnonzero(~space)
    lastc = solid[np.maximum(np.searchsorted(solid, edges[1:]) - 1, 0)] if len(solid) else np.zeros(len(line), int)
    firstc = solid[np.minimum(np.searchsorted(solid, line), len(solid) - 1)] if len(solid) else np.zeros(len(line), int)
    closing = t["close"][cp[lastc]] & (lastc > line)
    lastc = np.where(closing, lastc - 1, lastc)
    ended = t["end"][cp[lastc]] | (cp[lastc] == 0x3A)
    prose = (n_common >= 0.14 * n_words) & (n_words >= 4) & (digits <= 0.12 * seen) & (breaks <= 0.06 * seen)
    lines = np.maximum(np.bincount(owner, keep, n), 1)
    weight = np.bincount(owner, seen, n)
    for name, flag in (("punctuated_lines", ended), ("numbered_lines", digits > 0), ("short_lines", n_words <= 4), ("listed_lines", t["bullet"][cp[firstc]] | digit[firstc])):
        out[:, _AT[name]] = np.bincount(owner, flag & keep, n) / lines
    out[:, _AT["lines"]], out[:, _AT["mean_line_chars"]] = lines, weight / lines
    out[:, _AT["prose_line_share"]] = np.bincount(owner, prose * seen, n) / np.maximum(weight, 1)
    lh = slice_hash(prefix_sums(cp), line, edges[1:])
    order = np.lexsort((lh, owner))
    lo, oo = lh[order], owner[order]
    twice = np.append(False, (lo[1:] == lo[:-1]) & (oo[1:] == oo[:-1])) & keep[order]
    out[:, _AT["repeated_lines"]] = np.bincount(oo, twice, n) / lines
    return out


def statistics(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the STATISTICS of every row, in one pass without a shuffle.

    Ratios are per character, shares per word or per non-blank line; words are runs of letters. Null,
    empty and blank texts have 0 in all of them. Repeated rows come out repeatedly.
    """
    src = df.select(field(key).alias("_key"), field(text).cast("string").alias("_text"))
    schema = T.StructType([T.StructField(key, src.schema["_key"].dataType), *[T.StructField(s, T.DoubleType()) for s in STATISTICS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(1)):
                m = np.round(measure(b), 6)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(int(b.rows[0]), len(b.rows)), *[pa.array(m[:, i]) for i in range(m.shape[1])]], names=[key, *STATISTICS])

    return src.mapInArrow(run, schema)
