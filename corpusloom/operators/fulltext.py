"""Boolean and phrase search over tokenised texts, with ranks, snippets and highlights."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as tx


@dataclass(frozen=True)
class Query:
    """What a user typed: words, quoted phrases and excluded words, normalised.

    ``terms`` are alternatives; with ``every`` each of ``groups`` is one, all words of which must match.
    """

    terms: tuple[str, ...] = ()
    phrases: tuple[tuple[str, ...], ...] = ()
    excluded: tuple[str, ...] = ()
    every: bool = False
    groups: tuple[tuple[str, ...], ...] = ()

    @property
    def empty(self) -> bool:
        return not (self.terms or self.phrases)

    @property
    def words(self) -> list[str]:
        return list(dict.fromkeys([*self.terms, *(w for p in self.phrases for w in p)]))


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def parse_query(text: str, every: bool = False) -> Query:
    """Quoted runs are phrases, ``-word`` excludes, the rest are terms; all phrases must match, and of the terms
    any one. With ``every`` all terms must match, and ``or`` between them parts alternatives."""
    phrases = [tuple(words_of(p)) for p in re.findall(r'"([^"]*)"', text)]
    rest = re.sub(r'"[^"]*"', " ", text).replace('"', " ").split()
    excluded = [w for t in rest if t.startswith("-") for w in words_of(t)]
    kept = [t for t in rest if not t.startswith("-")]
    groups: list[list[str]] = [[]]
    for i, t in enumerate(kept):
        if every and t.lower() == "or" and groups[-1] and i + 1 < len(kept):
            groups.append([])
        else:
            groups[-1] += words_of(t)
    terms = [w for g in groups for w in g]
    return Query(tuple(terms), tuple(p for p in phrases if p), tuple(excluded), every, tuple(tuple(g) for g in groups if g) if every else ())


def query_language(text: str) -> str:
    """ar or ur by the letters of the query, otherwise en."""
    if not re.search("[\u0600-\u06ff\u0750-\u077f]", text):
        return "en"
    return "ur" if any(c in tx.URDU_QUERY_LETTERS for c in text) else "ar"


_DIGITS = str.maketrans(tx.ARABIC_DIGITS + tx.EXTENDED_DIGITS, tx.ASCII_DIGITS * 2)


def fold_word(word: str, language: str | None = None) -> str:
    """A word of a query as ``content_fold`` leaves it in a text of that language (its own, if none is given)."""
    language = language or query_language(word)
    out = unicodedata.normalize("NFC", word).replace(tx.TATWEEL, "")
    if language == "ar":
        out = out.translate(str.maketrans(*tx.HAMZA_FOLD)).translate(_DIGITS)
        out = unicodedata.normalize("NFC", re.sub("[\u0640\u064b-\u065f\u0670]", "", out)).translate(str.maketrans("ٱآأإى", "ااااي"))
    return out.translate(_DIGITS) if language == "ur" else out


def normalized_query(text: str, every: bool = False, language: str | None = None) -> Query:
    """The query with every word folded as the contents are."""
    q = parse_query(text, every)

    def fold(words: tuple[str, ...]) -> tuple[str, ...]:
        return tuple(f for w in words if (f := fold_word(w, language)))

    return Query(fold(q.terms), tuple(fold(p) for p in q.phrases), fold(q.excluded), every, tuple(fold(g) for g in q.groups))


def content_fold(text: Column, language: Column) -> Column:
    """A text as it is indexed: normalised by its language, Arabic also without marks and with unified letters.

    Protected wording is folded here too: the index is no place where it is shown.
    """
    base = F.translate(tx.collapse_blanks(tx.unicode_form(tx.unify_breaks(text))), tx.TATWEEL, "")
    arabic = tx.search_fold(tx.fold_letters(base, hamza=True, digits=True))
    return F.when(language == "ar", arabic).when(language == "ur", tx.fold_digits(base)).otherwise(base)


def indexed(df: DataFrame, text: Column) -> DataFrame:
    """Adds ``tokens`` and ``padded``, the tokens between single blanks, in which a phrase is a substring."""
    return df.withColumn("tokens", tx.tokens(text)).withColumn("padded", F.concat(F.lit(" "), F.array_join("tokens", " "), F.lit(" ")))


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts)


def matches(q: Query) -> Column:
    """The condition on ``padded``; an empty query matches nothing."""
    def has(words: tuple[str, ...]) -> Column:
        return F.col("padded").contains(" " + " ".join(words) + " ")

    parts = [has(p) for p in q.phrases]
    if q.terms:
        parts.append(_any([_all([has((t,)) for t in g]) for g in q.groups]) if q.every else _any([has((t,)) for t in q.terms]))
    parts += [~has((t,)) for t in q.excluded]
    return _all(parts) if not q.empty else F.lit(False)


def may_match(q: Query, text: Column) -> Column:
    """A cheap necessary condition on the raw text, so that only likely matches are tokenised."""
    low = F.lower(text)
    parts = [low.contains(w) for p in q.phrases for w in p]
    if q.terms:
        parts.append(_any([_all([low.contains(t) for t in g]) for g in q.groups]) if q.every else _any([low.contains(t) for t in q.terms]))
    return _all(parts) if parts else F.lit(False)


def matching(df: DataFrame, q: Query, text: Column) -> DataFrame:
    """The rows that match, with their tokens."""
    return indexed(df.filter(may_match(q, text)), text).filter(matches(q))


def term_rank(q: Query) -> Column:
    """0.1 for each occurrence of a word of the query."""
    return F.size(F.filter("tokens", lambda t: t.isin(*q.words))) * F.lit(0.1)


def events_of(q: Query) -> Column:
    """The words of the query in ``tokens``, with their places from 1 on."""
    return F.filter(F.transform("tokens", lambda t, i: F.struct((i + 1).alias("pos"), t.alias("term"))), lambda e: e["term"].isin(*q.words))


def _follows(phrase: tuple[str, ...], events: Column, n: Column) -> Column:
    """Whether the events up to the n-th end in the phrase, its words one behind the other."""
    size = len(phrase)
    if size == 1:
        return F.get(events, n - 1)["term"] == phrase[0]
    part = F.slice(events, F.greatest(n - size + 1, F.lit(1)), F.lit(size))
    near = F.get(events, n - 1)["pos"] - F.get(events, n - size)["pos"] == size - 1
    return (n >= size) & near & (F.transform(part, lambda e: e["term"]) == F.array(*map(F.lit, phrase)))


def matches_at(q: Query) -> Column:
    """The condition on ``events``; excluded words are not among these."""
    events = F.col("events")

    def has(term: str) -> Column:
        return F.exists(events, lambda e: e["term"] == term)

    parts = [F.exists(F.sequence(F.lit(1), F.size(events)), lambda n: _follows(p, events, n)) for p in q.phrases]
    if q.terms:
        parts.append(_any([_all([has(t) for t in g]) for g in q.groups]) if q.every else _any([has(t) for t in dict.fromkeys(q.terms)]))
    return _all(parts)


def cover_rank(q: Query) -> Column:
    """``cover_rank_at`` of the words in ``tokens``."""
    return cover_rank_at(q, events_of(q))


def cover_rank_at(q: Query, events: Column | None = None) -> Column:
    """Cover density: every shortest stretch that fulfils the query adds 0.1 over one plus its other words.

    Terms that are alternatives are one slot, each phrase is one, and with ``every`` each term. Of the
    alternatives of ``every`` only stretches with all terms count. A stretch begins after the one before it.
    """
    events = F.col("events") if events is None else events
    slots: list[tuple[str, ...] | frozenset[str]] = [*q.phrases]
    slots += [frozenset([t]) for t in dict.fromkeys(q.terms)] if q.every and len(q.groups) <= 1 else ([frozenset(q.terms)] if q.terms else [])
    if not slots:
        return F.lit(0.0)
    if len(slots) == 1 and isinstance(slots[0], frozenset):
        return F.size(events) * F.lit(0.1)
    k, none = len(slots), F.lit(0)
    zero = F.struct(F.array_repeat(none, k).alias("last"), F.array_repeat(none, k).alias("nth"), none.alias("start"), none.alias("n"), F.lit(0.0).alias("rank"))

    def step(acc: Column, event: Column) -> Column:
        i, n = event["pos"], acc["n"] + 1
        last, nth, new_one = [], [], F.lit(False)
        for at, slot in enumerate(slots):
            size = 1 if isinstance(slot, frozenset) else len(slot)
            here = event["term"].isin(*slot) if isinstance(slot, frozenset) else _follows(slot, events, n)
            new_one = new_one | here
            last.append(F.when(here, i - size + 1).otherwise(acc["last"][at]))
            nth.append(F.when(here, n - size + 1).otherwise(acc["nth"][at]))
        last, nth = F.array(*last), F.array(*nth)
        start = F.array_min(last)
        new = new_one & (start > acc["start"])
        noise = (i - start) - (n - F.array_min(nth))
        gain = F.when(new, F.lit(0.1) / (1 + noise)).otherwise(F.lit(0.0))
        return F.struct(last.alias("last"), nth.alias("nth"), F.when(new, start).otherwise(acc["start"]).alias("start"), n.alias("n"), (acc["rank"] + gain).alias("rank"))

    return F.aggregate(events, zero, step)["rank"]


def excerpt(text: Column, terms: list[str], before: int = 90, after: int = 180) -> Column:
    """The surroundings of the earliest term, with ellipses where the text goes on."""
    places = [F.when(F.locate(t, F.lower(text)) > 0, F.locate(t, F.lower(text))) for t in terms]
    at = F.coalesce(F.least(*places) if len(places) > 1 else places[0], F.lit(1))
    start = F.greatest(F.lit(1), at - before)
    piece = F.substring(text, start, F.lit(before + after))
    return F.concat(F.when(start > 1, "…").otherwise(""), piece, F.when(start + before + after - 1 < F.length(text), "…").otherwise(""))


def highlight(text: Column, terms: list[str]) -> Column:
    """HTML-safe text with the terms marked, whatever their case."""
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    pattern = "|".join(re.escape(t) for t in sorted(terms, key=lambda t: (-len(t), t)))
    return F.regexp_replace(out, f"(?i)({pattern})", "<mark>$1</mark>")


def search(df: DataFrame, q: Query, *, text: Column, keys: list[str], limit: int = 20, rank: str = "terms") -> DataFrame:
    """The ``limit`` best matches, by rank and then by the keys; the filter comes before any rank."""
    hits = matching(df, q, text).withColumn("rank", F.round(cover_rank(q) if rank == "cover" else term_rank(q), 6))
    return hits.orderBy(F.desc("rank"), *keys).limit(limit)
