"""Passages of held-out items inside corpus documents.

A q-gram lemma filter: character q-grams that a document shares with an item are counted in overlapping
bands of diagonals; a region with fewer than an occurrence within the edit budget must share is dropped.
The others are verified by an alignment within the band.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.textblocks import Block, blocks, folding, major_class, prefix_sums, slice_hash
from corpusloom.session import field

#: Characters of several letters, which folding one code point to one would shorten.
_JOINED = re.compile("[Ĳĳŉǆǉǌﬀ-ﬆﬓ-ﬗﷲﷺﻵ-ﻼ…]")
_SLOT = 16  # diagonals to a slot; a band is two neighbouring slots, so bands overlap by half
_REACH = 24  # how far an alignment may leave the middle of its band
_SLACK = 4  # words that an alignment of whole words can miss of a passage within the edit budget
_PART = 8  # shared q-grams from which a second stretch counts
_FINE = 4  # letters to a q-gram where longer ones say too little
_WORDS = 128  # words to a part of an item; parts overlap by two windows
_NEVER = np.int32(2**31 - 1)


def _whole(text: str | None) -> str:
    import unicodedata

    return _JOINED.sub(lambda m: unicodedata.normalize("NFKC", m.group()), text) if text and not text.isascii() else text or ""


@cache
def _kept() -> np.ndarray:
    """Folded code point for letters and digits, 0 for all that an altered copy may change freely."""
    fold, major = folding(), major_class()
    return np.where((major[fold] == ord("L")) | (major[fold] == ord("N")), fold, 0).astype(np.uint32)


@cache
def _digit() -> np.ndarray:
    return major_class() == ord("N")


@dataclass
class Stream:
    """The letters and digits of a block's texts, each text from ``start`` on."""

    cp: np.ndarray
    owner: np.ndarray
    start: np.ndarray
    at: np.ndarray  # place of each in the block's own characters
    sums: np.ndarray


def _stream(b: Block) -> Stream:
    folded = _kept()[b.cp]
    at = np.flatnonzero(folded)
    owner = b.text_of_char()[at]
    return Stream(folded[at], owner, np.searchsorted(owner, np.arange(len(b.texts) + 1)), at, prefix_sums(folded[at]))


def _begins(b: Block, s: Stream) -> np.ndarray:
    """For each letter whether a word begins with it: only a blank or a mark of punctuation parts words."""
    parting = (_kept()[b.cp] == 0) & (folding()[b.cp] != 0)
    gap = np.append(0, np.cumsum(parting))
    return np.append(True, (s.owner[1:] != s.owner[:-1]) | (gap[s.at[1:]] != gap[s.at[:-1]])) if len(s.cp) else np.zeros(0, bool)


def _ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... size[0] of them, then the same of the next."""
    return np.repeat(first - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(int(size.sum()))


def _grams(s: Stream, q: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(s.cp) - q + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(s.owner[:n] == s.owner[q - 1 :])
    return at, slice_hash(s.sums, at, at + q)


@dataclass
class Table:
    """The q-grams of all parts, sorted by hash, and the filter's bound for each window of words."""

    q: int
    gram: np.ndarray
    part: np.ndarray
    at: np.ndarray
    need: np.ndarray  # (parts, windows): q-grams that an occurrence of the window shares at least
    span: np.ndarray  # (2, parts, windows): where the window's q-grams begin and end
    bitmap: np.ndarray


@dataclass
class Index:
    """Item texts in parts of at most ``_WORDS`` words, as words and as q-grams."""

    ids: list  # of each part the ids of the items that have it
    window: int
    hits: int
    tables: list[Table]
    letters: np.ndarray  # of all parts, one after the other
    first: np.ndarray  # where each part begins there
    longest: int  # letters, rounded up to whole slots
    word_hash: np.ndarray  # (parts, most words), 0 beyond the last
    word_at: np.ndarray
    word_size: np.ndarray
    n_words: np.ndarray
    tiny: dict[int, tuple[np.ndarray, np.ndarray]]  # by length: hash and part of texts of one word or too short for a q-gram


def _table(s: Stream, q: int, start: np.ndarray, size: np.ndarray, text: np.ndarray, wanted: np.ndarray, bound: np.ndarray, word_at: np.ndarray, word_end: np.ndarray, most_items: int, floor: int) -> Table:
    """``wanted`` are the windows that this table answers for, ``bound`` what the edit budget can take of each."""
    n = np.maximum(size - q + 1, 0)
    part = np.repeat(np.arange(len(start)), n)
    inside = _ragged(np.zeros(len(start), np.int64), n)
    h = slice_hash(s.sums, start[part] + inside, start[part] + inside + q)
    origin = np.append(0, np.cumsum(n))
    if len(h):
        _, code = np.unique(h, return_inverse=True)
        pairs = np.unique(code.astype(np.int64) * (int(text.max()) + 1) + text[part])
        rare = np.bincount(pairs // (int(text.max()) + 1))[code] <= most_items
    else:
        rare = np.zeros(0, bool)
    shape = wanted.shape
    lo = np.minimum(word_at, np.maximum(n, 0)[:, None])
    hi = np.clip(word_end - q + 1, lo, n[:, None])
    before = np.append(0, np.cumsum(rare))
    held = before[origin[:-1, None] + hi] - before[origin[:-1, None] + lo]
    # a window with few rare q-grams has its frequent ones indexed too
    poor = wanted & (held - bound < floor)
    marks = np.zeros(len(h) + 1, np.int64)
    np.add.at(marks, (origin[:-1, None] + lo)[poor], 1)
    np.add.at(marks, (origin[:-1, None] + hi)[poor], -1)
    covered = np.zeros(len(h) + 1, np.int64)
    np.add.at(covered, (origin[:-1, None] + lo)[wanted], 1)
    np.add.at(covered, (origin[:-1, None] + hi)[wanted], -1)
    indexed = (rare & (covered.cumsum()[:-1] > 0)) | (marks.cumsum()[:-1] > 0)
    before = np.append(0, np.cumsum(indexed))
    held = before[origin[:-1, None] + hi] - before[origin[:-1, None] + lo]
    need = np.where(wanted & (held > 0), np.maximum(held - bound, 1), _NEVER).astype(np.int32).reshape(shape)
    order = np.argsort(h[indexed], kind="stable")
    bitmap = np.zeros(1 << 22, bool)
    bitmap[h[indexed] & np.uint64(len(bitmap) - 1)] = True
    return Table(q, h[indexed][order], part[indexed][order], inside[indexed][order], need, np.stack([lo, hi]), bitmap)


def build_index(ids: list, texts: list[str], *, q: int = 10, most_items: int = 30, window: int = 18, hits: int = 16, floor: int = 12) -> Index:
    """``window`` successive words of an item must come with at least ``hits`` of them unchanged.

    Equal texts are indexed once; a long one in overlapping parts, so that every window lies in one. A q-gram of
    more than ``most_items`` texts is indexed only in windows that without it would share fewer than ``floor``
    above the edit budget. The bound of a window counts its indexed q-grams, less those that the budget can touch:
    its longest words, as many as may be changed (in two stretches one less, so that the place between them is
    paid for). Where the budget can touch all of them, q-grams of ``_FINE`` letters answer: of the unchanged
    words so many stand together that one remains. Texts of one word or fewer letters must occur as they are, between the ends of words.
    """
    held_by: dict[str, list] = {}
    for i, t in zip(ids, texts):
        held_by.setdefault(t, []).append(i)
    b = Block(np.arange(len(held_by)), [_whole(t) for t in held_by])
    s = _stream(b)
    first = np.flatnonzero(_begins(b, s))
    last = np.append(first[1:], len(s.cp))
    of = s.owner[first] if len(first) else np.zeros(0, np.int64)
    last = np.minimum(last, s.start[of + 1]) if len(first) else last
    bounds = np.searchsorted(of, np.arange(len(held_by) + 1))
    cuts = [(i, w, min(w + _WORDS, hi)) for i, (lo, hi) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())) if hi > lo for w in range(lo, max(lo + 1, hi - 2 * window), _WORDS - 2 * window)]
    text = np.array([c[0] for c in cuts], np.int64)
    w0, w1 = (np.array([c[k] for c in cuts], np.int64) for k in (1, 2))
    every = list(held_by.values())
    n_words = w1 - w0
    n, most = len(cuts), int(n_words.max()) if len(cuts) else 0
    start = first[w0] if n else np.zeros(0, np.int64)
    size = (last[w1 - 1] if n else start) - start
    word_hash, word_at, word_size = np.zeros((n, most), np.uint64), np.zeros((n, most), np.int64), np.zeros((n, most), np.int64)
    row, col = np.repeat(np.arange(n), n_words), _ragged(np.zeros(n, np.int64), n_words)
    w = _ragged(w0, n_words)
    if n:
        word_hash[row, col] = slice_hash(s.sums, first[w], last[w])
        word_at[row, col] = first[w] - start[row]
        word_size[row, col] = last[w] - first[w]
    # windows: where each begins and ends, and the letters of its longest words, as many as may be changed
    least, may = np.minimum(window, n_words), np.zeros(n, np.int64)
    n_windows = n_words - least + 1
    plain = (size < _FINE) | (n_words == 1)
    there = (np.arange(max(1, most)) < n_windows[:, None]) & ~plain[:, None]
    begin, end, lost = (np.zeros((n, max(1, most)), np.int64) for _ in range(3))
    for i in range(n):
        k, m = int(least[i]), int(n_windows[i])
        may[i] = k - -(-k * hits // window)
        begin[i, :m], end[i, :m] = word_at[i, :m], word_at[i, k - 1 : k - 1 + m] + word_size[i, k - 1 : k - 1 + m]
        if may[i]:
            lost[i, :m] = np.partition(sliding_window_view(word_size[i, : int(n_words[i])], k), k - int(may[i]), axis=1)[:, -int(may[i]) :].sum(axis=1)

    def table(size_of_gram: int, wanted: np.ndarray, rarity: int) -> Table:
        bound = lost + may[:, None] * (size_of_gram - 1)
        return _table(s, size_of_gram, start, size, text, wanted, bound, begin, end, rarity, floor)

    tables = []
    if n:
        held = np.clip(end - begin - q + 1, 0, None)
        sound = there & (held - lost - may[:, None] * (q - 1) >= 1)
        tables = [table(q, sound, most_items)]
        if (rest := there & ~sound).any():
            tables.append(table(_FINE, rest, most_items))
    tiny: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for length in np.unique(size[plain]).tolist():
        at = np.flatnonzero(plain & (size == length))
        h = slice_hash(s.sums, start[at], start[at] + length)
        order = np.argsort(h)
        tiny[length] = (h[order], at[order])
    letters, begins = s.cp[_ragged(start, size)] if n else np.zeros(0, np.uint32), np.append(0, np.cumsum(size))
    longest = -(-int(size.max(initial=0)) // _SLOT) * _SLOT
    return Index([every[i] for i in text], window, hits, tables, letters, begins, longest, word_hash, word_at, word_size, n_words, tiny)


def _survivors(key: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Of overlapping bands, whose keys follow each other, those to align: every dropped one has a neighbour that
    stays and shares at least as much."""
    after = key[1:] == key[:-1] + 1
    stay, left = np.zeros(len(key), bool), np.ones(len(key), bool)
    while left.any():
        v = np.where(left, both, -1)
        less = np.append(False, after & (v[:-1] >= v[1:]) & left[:-1]) | np.append(after & (v[1:] > v[:-1]), False)
        top = left & ~less
        stay |= top
        left &= ~(top | np.append(False, after & top[:-1]) | np.append(after & top[1:], False))
    return stay


def _candidates(s: Stream, x: Index, t: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, part and diagonal of each band worth a look."""
    none = (np.zeros(0, np.int64),) * 3
    at, h = _grams(s, t.q)
    seen = np.flatnonzero(t.bitmap[h & np.uint64(len(t.bitmap) - 1)])
    at, h = at[seen], h[seen]
    lo = np.searchsorted(t.gram, h, "left")
    n = np.searchsorted(t.gram, h, "right") - lo
    if not n.sum():
        return none
    post = _ragged(lo, n)
    at = np.repeat(at, n)
    doc, part = s.owner[at].astype(np.int64), t.part[post]
    slot = (at - s.start[doc] - t.at[post] + x.longest) // _SLOT
    width = int((len(s.cp) + x.longest) // _SLOT + 4)  # slots of a pair
    every = (doc * len(x.ids) + part) * width + slot
    order = np.argsort(every, kind="stable")
    every = every[order]
    first = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
    count = np.diff(np.append(first, len(every)))
    key = every[first]
    both = count.copy()
    both[:-1] += np.where(key[1:] == key[:-1] + 1, count[1:], 0)
    stay = _survivors(key, both)
    key, both = key[stay], both[stay]
    pair, slot = key // width, key % width
    first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
    size = np.diff(np.append(first, len(pair)))
    # a passage lies in one band, or its two stretches in two: what the best and another one share together
    least = t.need.min(axis=1)[pair % len(x.ids)]
    best = np.repeat(np.maximum.reduceat(both, first), size)
    rows = np.flatnonzero((best * 2 >= least) & (both + best >= least) & ((both >= _PART) | (both == best)))
    pair, slot = pair[rows], slot[rows]
    if not len(pair):
        return none
    # the same window by window: which q-grams of the part these bands share
    lo, hi = np.searchsorted(every, pair * width + slot), np.searchsorted(every, pair * width + slot + 2)
    n = hi - lo
    first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
    which = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(pair))))
    keep = np.zeros(len(pair), bool)
    wide = int(t.span.max()) + 2
    for a in range(0, len(first), 4096):  # bounds the memory where many pairs are worth a look
        z = min(a + 4096, len(first))
        i, j = int(first[a]), int(first[z]) if z < len(first) else len(pair)
        shared = np.zeros((z - a, wide), np.int32)
        shared[np.repeat(which[i:j] - a, n[i:j]), t.at[post[order][_ragged(lo[i:j], n[i:j])]] + 1] = 1
        np.cumsum(shared, axis=1, out=shared)
        it = pair[first[a:z]] % len(x.ids)
        in_window = np.take_along_axis(shared, t.span[1, it], axis=1) - np.take_along_axis(shared, t.span[0, it], axis=1)
        keep[i:j] = (in_window >= t.need[it]).any(axis=1)[which[i:j] - a]
    rows = np.flatnonzero(keep)
    return pair[rows] // len(x.ids), pair[rows] % len(x.ids), (slot[rows] + 1) * _SLOT - x.longest


def _matches(s: Stream, x: Index, doc: np.ndarray, part: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
    """(band, word, shift): where a word of the part stands in the document."""
    shifts = np.arange(-_REACH, _REACH + 1)
    words = int(x.n_words[part].max()) if len(doc) else 0
    place = s.start[doc][:, None] + diagonal[:, None] + x.word_at[part][:, :words]
    where = place[:, :, None] + shifts
    end = where + x.word_size[part][:, :words, None]
    fits = (where >= s.start[doc][:, None, None]) & (end <= s.start[doc + 1][:, None, None]) & (x.word_size[part][:, :words, None] > 0)
    lo, hi = np.where(fits, where, 0), np.where(fits, end, 0)
    return fits & (slice_hash(s.sums, lo, hi) == x.word_hash[part][:, :words, None])


def _align(s: Stream, x: Index, doc: np.ndarray, part: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each band the part's words that stand in the document along the best path through the band, and the
    path's shift at every word.

    A path has one shift for each word; it gains the characters of the words that match and pays for
    every change of shift.
    """
    shifts = np.arange(-_REACH, _REACH + 1)
    n, most = len(doc), x.word_hash.shape[1]
    words = int(x.n_words[part].max()) if n else 0
    match = _matches(s, x, doc, part, diagonal)
    gain = match * x.word_size[part][:, :words, None].astype(np.float32)
    change = np.float32(6.0)
    score = np.zeros((n, len(shifts)), np.float32)
    came = np.zeros((n, words, len(shifts)), np.int8)
    own = np.broadcast_to(np.arange(len(shifts), dtype=np.int8), (n, len(shifts)))
    for w in range(words):
        top = score.argmax(axis=1)
        jump = score[np.arange(n), top] - change
        leave = jump[:, None] > score
        came[:, w] = np.where(leave, top[:, None], own)
        score = np.where(leave, jump[:, None], score) + gain[:, w]
    found, path = np.zeros((n, most), bool), np.zeros((n, most), np.int8)
    k = score.argmax(axis=1)
    for w in range(words - 1, -1, -1):
        found[:, w] = match[np.arange(n), w, k]
        path[:, w] = shifts[k]
        k = came[np.arange(n), w, k]
    return found, path


def _slips(s: Stream, x: Index, doc: np.ndarray, part: np.ndarray, diagonal: np.ndarray, found: np.ndarray, path: np.ndarray, wide: int = 24) -> np.ndarray:
    """Words that do not stand in the document as they are but with one letter changed, left out or put in, or
    two swapped, where the path expects them. Words of 4 to ``wide`` letters without digits."""
    size = x.word_size[part]
    band, word = np.nonzero(~found & (size >= 4) & (size <= wide))
    out = np.zeros_like(found)
    if not len(band):
        return out
    length, rows = size[band, word], part[band]
    col = np.arange(wide)
    mine = np.minimum(x.first[rows][:, None] + x.word_at[rows, word][:, None] + col, len(x.letters) - 1)
    a = np.where(col < length[:, None], x.letters[mine], 0)
    k2 = path[band, word].astype(np.int64)
    k1 = np.where(word > 0, path[band, np.maximum(word - 1, 0)], k2).astype(np.int64)
    base = s.start[doc[band]] + diagonal[band] + x.word_at[rows, word]

    def seen(at: np.ndarray) -> np.ndarray:
        ok = (at >= s.start[doc[band]][:, None]) & (at < s.start[doc[band] + 1][:, None])
        return np.where(ok, s.cp[np.clip(at, 0, len(s.cp) - 1)], 0)

    head = seen((base + k1)[:, None] + col)
    equal = (a == head) & (a > 0)
    lead = np.where(equal.all(axis=1), wide, np.argmin(equal, axis=1))
    back = np.clip(length[:, None] - 1 - col, 0, None)
    tail = (np.take_along_axis(a, back, axis=1) == seen((base + k2 + length)[:, None] - 1 - col)) & (col < length[:, None])
    trail = np.where(tail.all(axis=1), wide, np.argmin(tail, axis=1))
    ok = (np.abs(k2 - k1) <= 1) & (lead + trail >= length - (k2 <= k1))
    # two neighbours swapped
    one = np.minimum(lead, wide - 2)[:, None]
    swapped = (k1 == k2) & (lead + trail == length - 2) & (np.take_along_axis(a, one, 1) == np.take_along_axis(head, one + 1, 1))[:, 0] & (np.take_along_axis(a, one + 1, 1) == np.take_along_axis(head, one, 1))[:, 0]
    ok = (ok | swapped) & ~_digit()[a].any(axis=1)
    out[band[ok], word[ok]] = True
    return out


def _best_windows(found: np.ndarray, window: int) -> np.ndarray:
    """For each row the most words found among ``window`` successive ones (or all, of a shorter part)."""
    total = np.zeros((len(found), found.shape[1] + 1), np.int32)
    np.cumsum(found, axis=1, out=total[:, 1:])
    if found.shape[1] < window:
        return total[:, -1]
    return (total[:, window:] - total[:, :-window]).max(axis=1)


def _best_joined(a: np.ndarray, b: np.ndarray, n: int, window: int, least: int = 4) -> int:
    """The same with the words before some place taken from ``a`` and the others from ``b``."""
    ta, tb = np.append(0, np.cumsum(a[:n])), np.append(0, np.cumsum(b[:n]))
    # words of a before the cut and of b after it: the whole of b, and what a has more before the cut
    more = sliding_window_view((ta - tb)[least : n - least + 1], window - 2 * least + 1).max(axis=1)
    return int((tb[window:] - ta[: n - window + 1] + more).max())


def _chain(match: np.ndarray, at: np.ndarray, size: np.ndarray, window: int, need: int) -> int:
    """Most words of a window that stand in the document in order and apart, whatever their shifts.

    ``match`` has a row for each word and a column for each shift. What the path leaves out, a word alone
    between two changed ones, counts here. Windows with fewer than ``need`` words anywhere are passed over.
    """
    n, best = len(size), 0
    shifts = np.arange(match.shape[1])
    begin = at[:, None] + shifts
    end = begin + size[:, None]
    there = np.append(0, np.cumsum(match.any(axis=1)))
    for lo in range(max(1, n - window + 1)):
        if there[min(n, lo + window)] - there[lo] < max(need, best + 1):
            continue
        ends, chains = np.zeros(0, np.int64), np.zeros(0, np.int64)  # Pareto front: least end for each length
        for w in range(lo, min(n, lo + window)):
            k = np.flatnonzero(match[w])
            if not len(k):
                continue
            length = 1 + np.where(np.searchsorted(ends, begin[w, k], "right") > 0, chains[np.maximum(np.searchsorted(ends, begin[w, k], "right") - 1, 0)] if len(chains) else 0, 0)
            every_end, every = np.append(ends, end[w, k]), np.append(chains, length)
            order = np.lexsort((-every, every_end))
            every_end, every = every_end[order], every[order]
            keep = np.append(True, every[1:] > np.maximum.accumulate(every)[:-1])
            ends, chains = every_end[keep], every[keep]
        best = max(best, int(chains.max(initial=0)))
    return best


def _joined(x: Index) -> int:
    """Words that must stand unchanged in two stretches together: half of the edit budget of one."""
    return x.window - (x.window - x.hits) // 2


def _scan(b: Block, x: Index, step: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, part and words of every passage that the block holds."""
    s = _stream(b)
    bands = [_candidates(s, x, t) for t in x.tables]
    doc, part, diagonal = (np.concatenate([c[k] for c in bands] or [np.zeros(0, np.int64)]) for k in range(3))
    if len(bands) > 1:
        order = np.lexsort((diagonal, part, doc))
        doc, part, diagonal = doc[order], part[order], diagonal[order]
    out = _tiny(b, s, x)
    if len(doc):
        every = [_align(s, x, doc[i : i + step], part[i : i + step], diagonal[i : i + step]) for i in range(0, len(doc), step)]
        found, path = (np.concatenate([e[k] for e in every]) for k in range(2))
        n = x.n_words[part]
        need = np.where(n >= x.window, x.hits, -(-n * x.hits // x.window))
        best = _best_windows(found, x.window)
        near = np.flatnonzero((best < need) & (best >= need - _SLACK))
        for i in range(0, len(near), step):
            r = near[i : i + step]
            loose = found[r] | _slips(s, x, doc[r], part[r], diagonal[r], found[r], path[r])
            best[r] = np.maximum(best[r], _best_windows(loose, x.window))
        near = near[best[near] < need[near]]
        for i in range(0, len(near), step):
            r = near[i : i + step]
            for k, m in zip(r, _matches(s, x, doc[r], part[r], diagonal[r])):
                best[k] = max(best[k], _chain(m[: n[k]], x.word_at[part[k], : n[k]], x.word_size[part[k], : n[k]], x.window, int(need[k])))
        pair = doc * len(x.ids) + part
        edges = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        most = np.maximum.reduceat(best, edges)
        half = x.window // 2
        solid = _best_windows(found, half) >= half - (x.window - _joined(x))
        ends = np.append(edges[1:], len(pair))
        some = np.flatnonzero((most < need[edges]) & (ends - edges > 1) & (n[edges] >= x.window) & np.logical_or.reduceat(solid, edges))
        for e in some:
            i, j = int(edges[e]), int(ends[e])
            pairs = {(min(k, c, key=diagonal.__getitem__), max(k, c, key=diagonal.__getitem__)) for k in range(i, j) if solid[k] for c in range(i, j) if diagonal[c] != diagonal[k]}
            joined = max((_best_joined(found[f], found[c], int(n[i]), x.window) for f, c in pairs), default=0)
            most[e] = joined if joined >= _joined(x) else most[e]
        good = most >= need[edges]
        out.append(np.stack([doc[edges[good]], part[edges[good]], most[good]], axis=1))
    got = np.concatenate(out) if out else np.zeros((0, 3), np.int64)
    return got[:, 0], got[:, 1], got[:, 2]


def _tiny(b: Block, s: Stream, x: Index) -> list[np.ndarray]:
    """Texts of one word or fewer letters than a q-gram: as they are, from the beginning of a word to an end."""
    out = []
    if x.tiny:
        begin = np.append(_begins(b, s), True)
        for length, (known, part) in x.tiny.items():
            at = np.flatnonzero(begin[: len(s.cp) - length + 1] & begin[length:]) if len(s.cp) >= length else np.zeros(0, np.int64)
            at = at[s.owner[at] == s.owner[at + length - 1]]
            h = slice_hash(s.sums, at, at + length)
            lo = np.searchsorted(known, h, "left")
            n = np.searchsorted(known, h, "right") - lo
            rows = np.unique(np.stack([np.repeat(s.owner[at], n).astype(np.int64), part[_ragged(lo, n)]], axis=1), axis=0) if n.sum() else np.zeros((0, 2), np.int64)
            out.append(np.column_stack([rows, x.n_words[rows[:, 1]]]))
    return out


def leaks(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = 18, hits: int = 16, block_chars: int = 4_000_000) -> DataFrame:
    """``(key, item_key, words)``: documents that hold an item or ``window`` successive words of it.

    ``words`` is the largest number of words that stand unchanged among ``window`` successive words of the
    item; at least ``hits`` must. Where it is not reached by unchanged words, words with one slip of the pen
    count too. In two separate stretches half of the other words may be changed. Case, marks, width, look-alikes,
    punctuation, blanks and line breaks do not count; other matter may stand between two stretches. Items of fewer
    words must come with the same share of all their words, those of one word or under four letters as they are; empty and
    null texts, and those without letters, match nothing. Repeated documents each come out, and repeated rows
    repeatedly.

    Scale: one pass over the documents without a shuffle for each block of items. A block has at most about
    ``block_chars`` characters of items, which bounds what is sent to the workers, whatever their number.
    """
    src = docs.select(field(key).alias("_key"), field(text).cast("string").alias("_text"))
    its = items.select(field(item_key).alias("_item"), field(item_text).cast("string").alias("_text")).filter("_text is not null").distinct()
    size = its.agg(F.sum(F.length("_text"))).first()[0] or 0
    n = -(-size // block_chars) or 1
    schema = T.StructType([T.StructField(key, src.schema["_key"].dataType), T.StructField(item_key, its.schema["_item"].dataType), T.StructField("words", T.IntegerType())])
    out = None
    for k in range(n):
        part = its if n == 1 else its.filter(F.pmod(F.xxhash64("_text"), F.lit(n)) == k)
        rows = sorted(part.collect(), key=lambda r: (str(r[0]), r[1]))
        shared = docs.sparkSession.sparkContext.broadcast(build_index([r[0] for r in rows], [r[1] for r in rows], window=window, hits=hits))
        found = src.mapInArrow(_scanner(shared, key, item_key, schema), schema)
        out = found if out is None else out.unionByName(found)
    return out


def _best(doc: np.ndarray, part: np.ndarray, words: np.ndarray, x: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the parts of one item the one with the most words."""
    item = np.array([id(x.ids[i]) for i in part], np.int64)
    order = np.lexsort((-words, item, doc))
    doc, part, words, item = doc[order], part[order], words[order], item[order]
    first = np.append(True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])) if len(doc) else np.zeros(0, bool)
    return doc[first], part[first], words[first]


def _scanner(shared, key: str, item_key: str, schema: T.StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x: Index = shared.value
        for batch in batches:
            for b in blocks(pa.array([_whole(t) for t in batch.column(1).to_pylist()], pa.string())):
                doc, part, words = _best(*_scan(b, x), x)
                same = np.array([len(x.ids[i]) for i in part], np.int64)
                keys = batch.column(0).take(pa.array(np.repeat(b.rows[doc], same) if len(doc) else [], pa.int64()))
                ids, words = pa.array([k for i in part for k in x.ids[i]]), np.repeat(words, same)
                yield pa.RecordBatch.from_arrays([keys, ids.cast(_arrow(schema[item_key].dataType)), pa.array(words, pa.int32())], names=[key, item_key, "words"])

    return run


def _arrow(kind: T.DataType) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "smallint": pa.int16()}[kind.simpleString()]
