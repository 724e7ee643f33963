"""Languages of texts and of their segments: averaged hashed subword embeddings with a linear softmax.

The model is trained here, by stochastic gradient descent in numpy on a bounded sample of labelled rows.
Labels may be wrong: a first model drops sentences that contradict their label, a second is trained on
the rest. On held-out sentences are fitted a temperature, a least probability, and for each language how far
a sentence must stand out from the others: what stands out less than all but one in a thousand of them is
rejected as none of the languages.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.lookalikes import CYRILLIC, GREEK, LATIN
from corpusloom.session import field

# The spellings of a label that name one of the five languages, in lower case.
NAMES = {
    "en": ["en", "eng", "english", "anglais", "inggris", "bahasa inggris", "الإنجليزية", "انگریزی"],
    "ar": ["ar", "ara", "arb", "arabic", "arabe", "arab", "bahasa arab", "العربية", "عربي", "عربی"],
    "ur": ["ur", "urd", "urdu", "ourdou", "اردو", "أردو", "الأردية"],
    "fr": ["fr", "fra", "fre", "french", "français", "francais", "prancis", "bahasa prancis", "الفرنسية", "فرانسیسی"],
    "id": ["id", "in", "ind", "indonesian", "indonésien", "indonesien", "bahasa", "bahasa indonesia", "indonesia", "الإندونيسية", "انڈونیشی"],
}
LANGUAGES = list(NAMES)

_WORD = re.compile(r"[^\W\d_]+")
_END = re.compile("[.!?؟۔…．。！？]+[\"'”»’)\\]]*[\u00ad\u200b-\u200f\u2060\ufeff]*(?=\\s|$)|\\n\\s*\\n")
_QUOTED = re.compile(r"“[^”]+”|«[^»]+»|\"[^\"]+\"")
_TOKEN = re.compile(r"[^\s“”«»\"]+")
_ENDED = re.compile("[.!?؟۔…．。！？][\u00ad\u200b-\u200f\u2060\ufeff\\s]*$")
_BUCKETS = 1 << 15


def canonical(label: Column) -> Column:
    """The code that a label names, whatever its case, blanks or region suffix; otherwise null."""
    plain = F.lower(F.trim(label))
    base = F.regexp_replace(plain, "[-_](?:[a-z]{2,4}|[0-9]{3})$", "")
    out = F.lit(None).cast("string")
    for code, names in NAMES.items():
        out = F.when(plain.isin(names) | base.isin(names), F.lit(code)).otherwise(out)
    return out


@cache
def _fold() -> dict[int, str | None]:
    table: dict[int, str | None] = {ord(a): b for pairs in (GREEK, CYRILLIC, LATIN) for a, b in pairs.items()}
    for c in (*range(0x64B, 0x660), 0x670, 0x640, 0xAD, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), 0xFEFF):
        table[c] = None
    return table


def _plain(text: str) -> str:
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFKC", text).translate(_fold()).lower()


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans between sentence ends and empty lines; a single line break is a blank."""
    out, start = [], 0
    for m in _END.finditer(text):
        if m.end() > start:
            out.append((start, m.end()))
        start = m.end()
    if start < len(text):
        out.append((start, len(text)))
    return [(a, b) for a, b in out if text[a:b].strip()]


def spans(text: str) -> list[tuple[str, int, int, list[tuple[int, int]]]]:
    """``(kind, start, end, tokens)`` of the segments: each sentence, with its tokens outside of quotation marks
    where three or more are there, and each quotation of three tokens or more. A quotation of five or more that
    ends like a sentence is one."""
    out = []
    for a, b in sentences(text):
        quoted = [m.span() for m in _QUOTED.finditer(text, a, b)]
        tokens = [m.span() for m in _TOKEN.finditer(text, a, b)]
        bare = [t for t in tokens if not any(i <= t[0] < j for i, j in quoted)] if quoted else tokens
        out.append(("sentence", a, b, bare if len(bare) >= 3 else tokens))
        for i, j in quoted:
            inner = [t for t in tokens if i <= t[0] < j]
            if len(inner) >= 3:
                whole = len(inner) >= 5 and _ENDED.search(text, i + 1, j - 1)
                out.append(("sentence" if whole else "quotation", i, j, inner))
    return out


def words_of(token: str) -> list[str]:
    """The folded words of a stretch of text."""
    return _WORD.findall(_plain(token))


def grams(word: str) -> list[int]:
    """Buckets of the word and its pieces of 1 to 4 characters, with marks at both ends."""
    w = f"<{word}>"
    parts = [w] + [w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)] + list(word)
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) % _BUCKETS for p in parts]


@dataclass
class Model:
    table: np.ndarray  # (buckets, languages): embedding times output weights
    bias: np.ndarray
    temperature: float
    threshold: float  # least probability of an accepted language
    margin: np.ndarray  # for each language the least lead over the mean of the others of an accepted sentence

    def judge(self, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language, probability and whether it is accepted, of mean logits."""
        z = mean + self.bias
        lang = z.argmax(axis=1)
        top = z[np.arange(len(z)), lang]
        lead = top - (z.sum(axis=1) - top) / (z.shape[1] - 1)
        e = np.exp((z - z.max(axis=1, keepdims=True)) / self.temperature)
        p = (e / e.sum(axis=1, keepdims=True)).max(axis=1)
        return lang, p, (p >= self.threshold) & (lead >= self.margin[lang])

    def save(self, path: str) -> None:
        np.savez_compressed(path, table=self.table, bias=self.bias, rest=np.array([self.temperature, self.threshold]), margin=self.margin)


def load(path: str) -> Model:
    with np.load(path) as f:
        return Model(f["table"], f["bias"], float(f["rest"][0]), float(f["rest"][1]), f["margin"])


class _Tokens(dict):
    """Token -> its words as rows of ``sums`` and ``sizes``; forgets all when it has grown too large."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.sums, self.sizes, self.rows = model, [], [], {}

    def __missing__(self, token: str) -> list[int]:
        out = []
        for word in words_of(token):
            if word not in self.rows:
                g = grams(word)
                self.rows[word] = len(self.sums)
                self.sums.append(self.model.table[g].sum(axis=0))
                self.sizes.append(len(g))
            out.append(self.rows[word])
        self[token] = out
        return out

    def trim(self, most: int = 300_000) -> None:
        if len(self) > most:
            self.clear()
            self.rows.clear()
            self.sums.clear()
            self.sizes.clear()


def _train_once(flat: np.ndarray, first: np.ndarray, y: np.ndarray, epochs: int, seed: int, dim: int = 12, lr: float = 6.0, batch: int = 32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    k = len(LANGUAGES)
    emb = rng.normal(0, 0.1, (_BUCKETS, dim)).astype(np.float32)
    out, bias = rng.normal(0, 0.3, (dim, k)).astype(np.float32), np.zeros(k, np.float32)
    n, steps, done = len(y), epochs * -(-len(y) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for s in range(0, n, batch):
            rows = order[s : s + batch]
            size = first[rows + 1] - first[rows]
            owner = np.repeat(np.arange(len(rows)), size)
            ids = flat[np.repeat(first[rows] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())]
            h = np.add.reduceat(emb[ids], np.append(0, np.cumsum(size)[:-1]), axis=0) / size[:, None]
            z = h @ out + bias
            e = np.exp(z - z.max(axis=1, keepdims=True))
            g = e / e.sum(axis=1, keepdims=True)
            g[np.arange(len(rows)), y[rows]] -= 1
            rate = lr * (1 - done / steps)
            gh = (g @ out.T) / size[:, None]
            out -= rate / len(rows) * 0.2 * (h.T @ g)
            bias -= rate / len(rows) * 0.2 * g.sum(axis=0)
            by = np.argsort(ids, kind="stable")  # one sum for each bucket that occurs
            cut = np.flatnonzero(np.append(True, np.diff(ids[by]) != 0))
            emb[ids[by][cut]] -= rate * np.add.reduceat(gh[owner[by]], cut, axis=0)
            done += 1
    return emb, out, bias


def train(texts: list[str], labels: list[str], *, most_sentences: int = 15_000, epochs: int = 5, precision: float = 0.995, seed: int = 7) -> Model:
    """Fits the model on sentences of labelled texts; every tenth sentence is held out for calibration."""
    words: dict[str, np.ndarray] = {}
    flat, sizes, y = [], [], []
    per = max(1, most_sentences // len(LANGUAGES))
    taken = dict.fromkeys(LANGUAGES, 0)
    for text, label in zip(texts, labels):
        if taken[label] >= per:
            continue
        for kind, _, _, tokens in spans(text):
            found = [w for i, j in tokens for w in words_of(text[i:j])]
            if kind == "sentence" and len(found) >= 3:
                ids = [words[w] if w in words else words.setdefault(w, np.array(grams(w), np.int32)) for w in found]
                flat.append(np.concatenate(ids))
                sizes.append(len(flat[-1]))
                y.append(LANGUAGES.index(label))
                taken[label] += 1
    if not flat:
        return Model(np.zeros((_BUCKETS, len(LANGUAGES)), np.float32), np.zeros(len(LANGUAGES), np.float32), 1.0, 1.0, np.zeros(len(LANGUAGES)))
    first = np.append(0, np.cumsum(sizes))
    ids, target = np.concatenate(flat), np.array(y)
    held = np.arange(len(target)) % 10 == 9

    def pick(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.concatenate([ids[first[r] : first[r + 1]] for r in rows]), np.append(0, np.cumsum(np.diff(first)[rows])), target[rows]

    def logits(emb: np.ndarray, out: np.ndarray, bias: np.ndarray) -> np.ndarray:
        table = emb @ out
        return np.add.reduceat(table[ids], first[:-1], axis=0) / np.diff(first)[:, None] + bias

    rows = np.flatnonzero(~held)
    if not len(rows):
        rows = np.arange(len(target))
    z = logits(*_train_once(*pick(rows), 2, seed))
    e = np.exp(z - z.max(axis=1, keepdims=True))
    agrees = (e / e.sum(axis=1, keepdims=True))[np.arange(len(target)), target] >= 0.4
    clean = rows[agrees[rows]]
    emb, out, bias = _train_once(*pick(clean if len(clean) else rows), epochs, seed + 1)
    z = logits(emb, out, bias)
    check = np.flatnonzero(held & agrees)
    temperature, threshold, margin = 1.0, 0.5, np.zeros(len(LANGUAGES))
    if len(check):
        own = z[check, target[check]]
        lead = own - (z[check].sum(axis=1) - own) / (len(LANGUAGES) - 1)
        for k in range(len(LANGUAGES)):
            if (mine := lead[target[check] == k]).size:
                margin[k] = 0.9 * mine.size / (mine.size + 5) * np.quantile(mine, 0.001, method="lower")  # a small sample proves little

        def loss(t: float) -> float:
            s = z[check] / t
            s = s - s.max(axis=1, keepdims=True)
            own = s[np.arange(len(check)), target[check]]
            unsure = len(LANGUAGES) / (len(check) + len(LANGUAGES))  # so that a faultless sample is no proof
            return float((np.log(np.exp(s).sum(axis=1)) - (1 - unsure) * own - unsure * s.mean(axis=1)).mean())

        temperature = min(np.geomspace(0.25, 8, 41), key=loss)
        s = z[check] / temperature
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        right, sure = p.argmax(axis=1) == target[check], p.max(axis=1)
        order = np.argsort(-sure, kind="stable")
        kept = np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= precision
        if kept.any():  # the lowest confidence down to which the accepted sentences are that precise
            last = np.flatnonzero(kept)[-1]
            threshold = 0.5 if last == len(order) - 1 else float(np.clip(sure[order][last], 0.5, 0.9))
    return Model((emb @ out).astype(np.float32), bias, float(temperature), threshold, margin)


_TRAINED: dict[bytes, Model] = {}  # by a digest of the sample; the latest few


def train_from(df: DataFrame, *, text: str, label: str, most_rows: int = 16_000) -> Model:
    """Trains on about ``most_rows`` labelled rows, chosen by a hash of the text: the bound of the sample. A
    sample that this process has met before is not trained on again."""
    rows = df.select(field(text).cast("string").alias("t"), canonical(field(label)).alias("l"))
    n = df.count()  # from the footers of the files
    rows = rows.filter("t is not null and l is not null").withColumn("h", F.xxhash64("t"))
    if n > most_rows:
        rows = rows.filter(F.pmod("h", F.lit(1 << 20)) < int((1 << 20) * most_rows / n))
    got = sorted(rows.distinct().collect(), key=lambda r: (r["h"], r["t"], r["l"]))
    digest = hashlib.sha256("\0".join(f"{r['l']}{r['t']}" for r in got).encode("utf-8", "surrogatepass")).digest()
    if digest not in _TRAINED:
        while len(_TRAINED) >= 4:
            _TRAINED.pop(next(iter(_TRAINED)))
        _TRAINED[digest] = train([r["t"] for r in got], [r["l"] for r in got])
    return _TRAINED[digest]


def _parts(sums: np.ndarray, sizes: np.ndarray, model: Model, lang: int, price: float = 9.0, least: int = 5) -> list[tuple[int, int, int]]:
    """Runs of at least ``least`` words in another language than the sentence's: ``(first, behind, language)``.

    The best path over the languages: a word adds its mean logits, a change of language costs ``price``.
    """
    z = (sums / sizes[:, None] + model.bias) / model.temperature
    z -= np.log(np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)) + z.max(axis=1, keepdims=True)
    z = np.maximum(z, -6.0)  # no single word forces a change
    score, came = z[0].copy(), np.zeros(z.shape, np.int64)
    for i in range(1, len(z)):
        top = int(score.argmax())
        stay = score >= score[top] - price
        came[i] = np.where(stay, np.arange(len(score)), top)
        score = np.where(stay, score, score[top] - price) + z[i]
    path = np.zeros(len(z), np.int64)
    path[-1] = score.argmax()
    for i in range(len(z) - 1, 0, -1):
        path[i - 1] = came[i, path[i]]
    edge = np.flatnonzero(np.append(True, path[1:] != path[:-1]))
    return [(int(a), int(b), int(path[a])) for a, b in zip(edge, np.append(edge[1:], len(path))) if path[a] != lang and b - a >= least]


def segments(df: DataFrame, model: Model, *, key: str = "row_id", text: str = "text", window: int = 6) -> DataFrame:
    """``(key, kind, start, end, words, language, confidence)`` of the segments of each row.

    ``kind`` is ``sentence``, ``quotation`` (three words or more in quotation marks, which then do not count for
    their sentence) or ``part``: words within a sentence that are in another language than the rest. ``language``
    is null where the calibrated probability is below the model's threshold or the sentence stands out less than
    those of that language do. Offsets are code points of the original text. Null, empty and blank texts have no
    segment; repeated rows come out repeatedly. One pass, no shuffle; whole texts and whole words.
    """
    src = df.select(field(key).alias("_key"), field(text).cast("string").alias("_text")).filter("_text is not null")
    schema = T.StructType([T.StructField(key, src.schema["_key"].dataType), T.StructField("kind", T.StringType()), *[T.StructField(c, T.IntegerType()) for c in ("start", "end", "words")], T.StructField("language", T.StringType()), T.StructField("confidence", T.DoubleType())])
    names = np.array([*LANGUAGES, None], object)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Tokens(model)
        for rows in batches:
            keys, kinds, where, sizes, index, places = [], [], [], [], [], []
            for k, t in zip(rows["_key"], rows["_text"]):
                for kind, a, b, tokens in spans(t):
                    before = len(index)
                    for i, j in tokens:
                        index += known[t[i:j]]
                    keys.append(k)
                    kinds.append(kind)
                    where.append((a, b))
                    sizes.append(len(index) - before)
                    places.append((t, tokens))
            if not keys:
                continue
            size, at = np.array(sizes), np.array(index, np.int64)
            lang, conf = np.full(len(size), len(LANGUAGES)), np.zeros(len(size))
            some = np.flatnonzero(size)
            more: list[tuple] = []
            if len(some):
                sums, n = np.array(known.sums)[at], np.array(known.sizes)[at]
                first = np.append(0, np.cumsum(size)[:-1])
                found, p, sure = model.judge(np.add.reduceat(sums, first[some], axis=0) / np.add.reduceat(n, first[some])[:, None])
                conf[some] = p
                lang[some[sure]] = found[sure]
                for s in _mixed(sums, n, first, size, np.array(kinds) == "sentence", lang, model, window):
                    a, z = int(first[s]), int(first[s] + size[s])
                    owner = [m for m, (i, j) in enumerate(places[s][1]) for _ in known[places[s][0][i:j]]]
                    for i, j, other in _parts(sums[a:z], n[a:z], model, int(lang[s])):
                        own, q, ok = model.judge((sums[a + i : a + j].sum(axis=0) / n[a + i : a + j].sum())[None])
                        if ok[0] and own[0] == other:
                            more.append((keys[s], "part", places[s][1][owner[i]][0], places[s][1][owner[j - 1]][1], j - i, LANGUAGES[other], float(q[0])))
            known.trim()
            span = np.array(where)
            out = pd.DataFrame({key: pd.Series(keys, dtype=rows["_key"].dtype), "kind": kinds, "start": span[:, 0], "end": span[:, 1], "words": size, "language": names[lang], "confidence": np.round(conf, 6)})
            yield pd.concat([out, pd.DataFrame(more, columns=out.columns)]) if more else out

    return src.mapInPandas(run, schema)


def _mixed(sums: np.ndarray, n: np.ndarray, first: np.ndarray, size: np.ndarray, whole: np.ndarray, lang: np.ndarray, model: Model, window: int) -> np.ndarray:
    """Sentences of which some ``window`` words are surely in another language than the whole."""
    if len(n) < window:
        return np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(size)), size)
    total, count = np.vstack([np.zeros((1, sums.shape[1])), np.cumsum(sums, axis=0, dtype=np.float64)]), np.append(0, np.cumsum(n))
    inside = np.flatnonzero((owner[window - 1 :] == owner[: len(owner) - window + 1]) & whole[owner[: len(owner) - window + 1]] & (lang[owner[: len(owner) - window + 1]] < len(LANGUAGES)))
    if not len(inside):
        return inside
    found, p, sure = model.judge((total[inside + window] - total[inside]) / (count[inside + window] - count[inside])[:, None])
    return np.unique(owner[inside[sure & (p >= 0.9) & (found != lang[owner[inside]])]])


def document_languages(found: DataFrame, *, key: str = "row_id") -> DataFrame:
    """``(key, language, share, confidence)``: of each row and language, its share of the characters of all
    sentences and the mean confidence by characters. Sentences without a language count as null language."""
    n = F.col("end") - F.col("start")
    per = found.filter("kind = 'sentence'").groupBy(field(key).alias(key), "language").agg(F.sum(n).alias("_n"), F.sum(n * F.col("confidence")).alias("_c"))
    total = per.groupBy(key).agg(F.sum("_n").alias("_all"))
    out = per.withColumnRenamed(key, "_k").join(total, F.col("_k").eqNullSafe(total[key])).drop("_k")
    return out.select(key, "language", F.round(F.col("_n") / F.col("_all"), 6).alias("share"), F.round(F.col("_c") / F.col("_n"), 6).alias("confidence"))


def unnamed_languages(df: DataFrame, model: Model, *, key: str = "row_id", text: str = "text", label: str = "label", least_words: int = 3) -> DataFrame:
    """Distinct ``(key, language)``: languages of at least one whole sentence, of ``least_words`` or more, that the
    row's label does not name. Quoted words and parts of sentences are none."""
    rows = df.select(F.struct(field(key).alias("k"), canonical(field(label)).alias("l")).alias("row"), field(text).alias("text"))
    found = segments(rows, model, key="row", text="text").filter((F.col("kind") == "sentence") & F.col("language").isNotNull() & (F.col("words") >= least_words))
    return found.filter("row.l is null or row.l <> language").select(F.col("row.k").alias(key), "language").distinct()
