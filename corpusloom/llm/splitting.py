"""Oversized texts cut into pieces under a limit, at natural boundaries, by dynamic programming."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.textblocks import WHITE_SPACE
from corpusloom.session import field

#: Cut penalty by kind of boundary: paragraph, line, sentence, clause, word, inside a word.
PENALTY = {"paragraph": 0.0, "line": 0.4, "sentence": 0.6, "clause": 2.0, "word": 4.0, "inside": 12.0}
#: What every piece costs, and the weight of its squared relative deviation from the even size.
PIECE, UNEVEN = 1.0, 4.0
#: Characters a token stands for, by language; all other languages have DEFAULT_CHARS.
CHARS_PER_TOKEN = {"ar": 3, "ur": 3}
DEFAULT_CHARS = 4

#: Marks, joiners and variation selectors belong to the character before them.
_STAYS = [*range(0x300, 0x370), *range(0x610, 0x61B), *range(0x64B, 0x660), 0x670, *range(0x6D6, 0x6EE), 0x200C, 0x200D, *range(0xFE00, 0xFE10)]
_SPACE, _BREAK, _END, _CLAUSE, _CLOSE, _BULLET, _STAY = (1 << i for i in range(7))


@cache
def _classes() -> np.ndarray:
    """Bits by code point: what decides about the kind of a boundary."""
    table = np.zeros(0x110000, np.uint8)
    for bit, chars in ((_SPACE, WHITE_SPACE), (_BREAK, map(ord, "\n\r\u2029")), (_END, map(ord, ".!?؟۔…．。！？")), (_CLAUSE, map(ord, ",;:،؛—–|")), (_CLOSE, map(ord, "\"'”»)]")), (_BULLET, map(ord, "-*•0123456789٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹")), (_STAY, _STAYS)):
        table[list(chars)] |= bit
    return table


def tokens(text: Column, language: Column) -> Column:
    """Token estimate: code points over 3 (Arabic, Urdu) or 4, rounded up; null text has none."""
    per = F.when(language.isin(*CHARS_PER_TOKEN), F.lit(3)).otherwise(F.lit(DEFAULT_CHARS))
    return F.ceil(F.length(text) / per).cast("long")


def boundaries(text: str, step: int) -> tuple[np.ndarray, np.ndarray]:
    """All places where the text can be cut, ascending, with their penalties; the first is 0, the last the end.

    Every run of white space is a boundary behind it. A word, and any other stretch without blanks, can be cut
    inside only where it is longer than ``step``, then at every ``step`` characters, before no mark.
    """
    n = len(text)
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _classes()[cp]
    space = (kind & _SPACE) > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], space, [False]]).astype(np.int8)))
    start, at = edge[::2], edge[1::2]
    keep = (start > 0) & (at < n)
    start, at = start[keep], at[keep]
    breaks = (kind & _BREAK) > 0
    breaks[:-1] &= ~((cp[:-1] == 13) & (cp[1:] == 10))  # CR LF is one
    total = np.append(0, np.cumsum(breaks))
    lines = total[at] - total[start]
    before = start - 1
    while len(shut := np.flatnonzero(((kind[before] & _CLOSE) > 0) & (before > 0))):
        before[shut] -= 1
    ends, clause, listed = (kind[before] & _END) > 0, (kind[before] & _CLAUSE) > 0, (kind[at] & _BULLET) > 0 if len(at) else np.zeros(0, bool)
    cost = np.select([lines > 1, (lines == 1) & (ends | listed), ends, clause | (lines == 1)], [PENALTY[k] for k in ("paragraph", "line", "sentence", "clause")], PENALTY["word"])
    at, cost = np.concatenate([[0], at, [n]]), np.concatenate([[0.0], cost, [0.0]])
    wide = np.flatnonzero(np.diff(at) > step)
    if len(wide):
        more: list[int] = []
        for i in wide:
            pos, end = int(at[i]), int(at[i + 1])
            while end - pos > step:
                cut_at = pos + step
                while cut_at > pos + 1 and kind[cut_at] & _STAY:
                    cut_at -= 1
                pos = cut_at if cut_at > pos + 1 else pos + step
                more.append(pos)
        at, cost = np.append(at, more), np.append(cost, np.full(len(more), PENALTY["inside"]))
        order = np.argsort(at, kind="stable")
        at, cost = at[order], cost[order]
    return at, cost


def starts(at: np.ndarray, cost: np.ndarray, overlap: int) -> np.ndarray:
    """Where the piece after a cut at each place begins: between the whole and half of the overlap before it, at
    the place of the least penalty, the earliest of equal ones. Never decreasing."""
    if overlap <= 0:
        return at.copy()
    lo, hi = at - overlap, at - (overlap + 1) // 2
    out = np.full(len(at), -1)
    for price in sorted(set(PENALTY.values())):
        places = at[1:-1][cost[1:-1] == price]
        if len(places):
            k = np.searchsorted(places, lo)
            found = places[np.minimum(k, len(places) - 1)]
            out = np.where((out < 0) & (k < len(places)) & (found <= hi), found, out)
    # where no place is there (the text's beginning, or marks that would be torn off): the first one behind
    k = np.searchsorted(at, np.maximum(lo, 1))
    out = np.where(out < 0, np.minimum(at[np.minimum(k, len(at) - 1)], at), out)
    return np.maximum.accumulate(out)


def best_cuts(at: np.ndarray, cost: np.ndarray, start: np.ndarray, most: int, even: float) -> list[int]:
    """Indices of the cuts of least total cost, the first place and the last included.

    The cost of a piece is convex in its length and a length above the limit is out of the question, so that of
    two cuts before it the later one, once better, stays better: a queue of the cuts that are best somewhere
    gives every optimum in constant time, over all places.
    """
    places, prices, begins = at.tolist(), cost.tolist(), start.tolist()
    last = len(places) - 1
    best, back = [0.0] * (last + 1), [0] * (last + 1)
    scale, curve = UNEVEN / (even * even), even * even / (2 * UNEVEN)
    queue, until, front = [0], [float("inf")], 0  # until[k]: the last place at which queue[k] is best
    begins[0] = 0
    for j in range(1, last + 1):
        x = places[j]
        while until[front] < x:
            front += 1
        i = queue[front]
        off = x - begins[i] - even
        best[j] = now = best[i] + scale * off * off + prices[j] + PIECE
        back[j] = i
        s = begins[j]
        while True:
            i = queue[-1]
            t = begins[i]
            if t == s:
                cross = float("inf") if best[i] <= now else float("-inf")
            else:
                cross = even + (s + t) / 2 - (best[i] - now) * curve / (s - t)
            cross = min(cross, t + most)
            if len(queue) - 1 > front and cross <= until[-2]:
                queue.pop()
                until.pop()
            else:
                break
        until[-1] = cross
        queue.append(j)
        until.append(float("inf"))
    ends = [last]
    while ends[-1]:
        ends.append(back[ends[-1]])
    return ends[::-1]


def cut(text: str, most: int, overlap: int) -> list[tuple[int, int]]:
    """``(start, end)`` of the pieces: each at most ``most`` characters, together the whole text.

    A piece begins between half and the whole of ``overlap`` characters before the end of the one before it, at
    the best boundary there; an unbroken word is repeated from inside. The cuts minimise, over all boundaries,
    the sum of penalties, pieces and squared relative deviations from the even size.
    """
    n = len(text)
    if n <= most:
        return [(0, n)]
    if not 0 <= overlap < most // 2:
        raise ValueError("the overlap must be less than half of the limit")
    at, cost = boundaries(text, max(1, overlap // 2 or most // 4))
    start = starts(at, cost, overlap)
    keep = (at == 0) | (at > overlap)  # the first piece has room for the overlap
    at, cost, start = at[keep], cost[keep], start[keep]
    pieces = max(2, -(-(n - overlap) // (most - overlap)))
    even = min(most, (n + (pieces - 1) * overlap) / pieces)
    ends = best_cuts(at, cost, start, most, even)
    return [(int(start[a]) if a else 0, int(at[b])) for a, b in zip(ends, ends[1:])]


def split_oversized(df: DataFrame, *, key: str = "chunk_id", text: str = "text", language: str = "language", limit: int = 512, overlap: int = 64, keep_small: bool = False) -> DataFrame:
    """Pieces ``(key, piece, n_pieces, start, end, tokens, text)`` of the texts of more than ``limit`` tokens.

    ``start`` and ``end`` are code-point offsets; leaving out the overlaps, the pieces joined give back
    the text exactly. Each piece has at most ``limit`` tokens and shares between half of ``overlap`` tokens and
    all with its neighbour. ``keep_small`` adds the other texts as their own single piece; null texts have none,
    an empty text is one empty piece. Repeated rows are cut repeatedly, a null key stays null.

    Rows are cut one by one and never meet, so there is no shuffle; only oversized texts go to Python.
    """
    src = df.select(field(key).alias("_key"), field(text).cast("string").alias("_text"), field(language).cast("string").alias("_lang")).filter(F.col("_text").isNotNull())
    size = tokens(F.col("_text"), F.col("_lang"))
    per = F.when(F.col("_lang").isin(*CHARS_PER_TOKEN), F.lit(3)).otherwise(F.lit(DEFAULT_CHARS))
    schema = T.StructType([T.StructField(key, src.schema["_key"].dataType), *[T.StructField(c, T.IntegerType()) for c in ("piece", "n_pieces", "start", "end")], T.StructField("tokens", T.LongType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for k, t, chars in zip(rows["_key"], rows["_text"], rows["_per"]):
                parts = cut(t, limit * chars, overlap * chars)
                out += [(k, i + 1, len(parts), a, b, -(-(b - a) // chars), t[a:b]) for i, (a, b) in enumerate(parts)]
            yield pd.DataFrame(out, columns=schema.names)

    large = src.filter(size > limit).select("_key", "_text", per.alias("_per")).mapInPandas(run, schema)
    if not keep_small:
        return large
    small = src.filter(size <= limit)
    one = F.lit(1)
    return large.unionByName(small.select(F.col("_key").alias(key), one.alias("piece"), one.alias("n_pieces"), F.lit(0).alias("start"), F.length("_text").alias("end"), size.alias("tokens"), F.col("_text").alias("text")))


def latest_oversized(df: DataFrame, *, key: str = "chunk_id", text: str = "text", language: str = "language", version: str = "updated_at", limit: int = 512) -> DataFrame:
    """``(key, text, language)`` of each key whose latest row has more than ``limit`` tokens.

    The text travels only where it is oversized: all other rows are shuffled as key and version. Equal
    versions are decided by the larger text, null versions are the oldest.
    """
    t, lang = field(text).cast("string"), field(language).cast("string")
    big = F.coalesce(tokens(t, lang) > limit, F.lit(False))
    row = F.struct(F.when(big, t).alias("text"), F.when(big, lang).alias("language"))
    last = df.groupBy(field(key).alias(key)).agg(F.max(F.struct(field(version).alias("v"), row.alias("r"))).alias("_m"))
    return last.filter(F.col("_m.r.text").isNotNull()).select(field(key), F.col("_m.r.text").alias("text"), F.col("_m.r.language").alias("language"))
