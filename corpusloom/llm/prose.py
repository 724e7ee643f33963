"""Running prose against lists, tables, markup and junk: boosted trees over the statistics of each text.

The trees learn from weak labels. Texts that plainly are prose or plainly are not get a label by rule, and
copies of them altered by rule (prose wrapped, in capitals, without punctuation or with a foreign fragment;
other matter led by one sentence) keep it. The probability is calibrated on every second row of
``holdout.json``, documents of the test tables that were read and labelled by hand (with their id, the digest of
their text and its statistics); the other rows only evaluate.
"""

from __future__ import annotations

import json
import re
import textwrap
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.quality import STATISTICS, measure
from corpusloom.llm.textblocks import blocks
from corpusloom.session import field

HOLDOUT = Path(__file__).with_name("holdout.json")
_AT = {name: i for i, name in enumerate(STATISTICS)}
#: Sizes say nothing about the kind of matter.
USED = [i for i, name in enumerate(STATISTICS) if name not in ("chars", "words", "lines")]


def weak_labels(m: np.ndarray) -> np.ndarray:
    """1 for plainly something other than prose, 0 for plainly prose, -1 for neither, by the statistics."""
    def s(name: str) -> np.ndarray:
        return m[:, _AT[name]]

    prose = (s("prose_line_share") >= 0.9) & (s("common_words") >= 0.2) & (s("word_repeats") < 0.1) & (s("repeated_lines") < 0.2) & (s("distinct_words") >= np.minimum(0.3, 30 / np.maximum(s("words"), 1)))
    other = (s("prose_line_share") <= 0.1) & ((s("common_words") <= 0.05) | (s("digit_ratio") >= 0.2) | (s("brackets") >= 0.1) | (s("symbol_ratio") >= 0.3) | (s("short_lines") >= 0.7))
    other |= (s("repeated_lines") >= 0.6) | (s("word_repeats") >= 0.5) | (s("letter_ratio") < 0.25)
    return np.where(other & ~prose, 1, np.where(prose & ~other, 0, -1))


# Foreign matter that is put into copies of prose.
_FRAGMENTS = ["1234567 0042 3.14", "<s> [PAD] </s>", "½ ¾ № § ¶", "\t\tcolumn\tcell\t", "🙂 📚", "««»»", "- one\n- two\n", "��"]


def altered(text: str, other: bool, sentence: str, rng: np.random.Generator) -> str:
    """The text as a careless hand could have left it, its kind unchanged."""
    if other:
        return f"{sentence}\n{text}" if len(text) > 4 * len(sentence) else text
    kind = rng.integers(6)
    if kind == 0:
        return "\n".join(textwrap.wrap(text, int(rng.integers(32, 80)))) or text
    if kind == 1:
        return text.upper()
    if kind == 2:
        return re.sub(r"[.,;:!?؟۔،]", "", text)
    words = text.split(" ")
    if kind == 3:
        return " ".join(words[: max(6, int(rng.integers(6, 16)))])
    for _ in range(int(rng.integers(1, 3))):
        words.insert(int(rng.integers(len(words) + 1)), _FRAGMENTS[int(rng.integers(len(_FRAGMENTS)))])
    return " ".join(words)


@dataclass
class Trees:
    """Boosted regression trees of fixed depth on binned statistics, with a fitted probability."""

    cuts: list[np.ndarray]
    feature: np.ndarray  # (trees, inner nodes)
    limit: np.ndarray  # bin up to which a row goes left
    value: np.ndarray  # (trees, leaves)
    base: float
    slope: float = 1.0
    offset: float = 0.0

    def bins(self, m: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, m[:, i]) for c, i in zip(self.cuts, USED)], axis=1)

    def margin(self, m: np.ndarray) -> np.ndarray:
        x = self.bins(m)
        rows, out = np.arange(len(x)), np.full(len(x), self.base)
        depth = int(np.log2(self.value.shape[1]))
        for f, limit, value in zip(self.feature, self.limit, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > limit[node])
            out += value[node - (2**depth - 1)]
        return out

    def probability(self, m: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.margin(m) + self.offset)))


def boost(m: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 3, rate: float = 0.2, n_bins: int = 32, l2: float = 1.0) -> Trees:
    """Second-order boosting of the logistic loss; the best split of every node from histograms."""
    cuts = [np.unique(np.quantile(m[:, i], np.linspace(0, 1, n_bins + 1)[1:-1])) for i in USED]
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Trees(cuts, np.zeros((trees, 2**depth - 1), np.int64), np.full((trees, 2**depth - 1), n_bins), np.zeros((trees, 2**depth)), float(np.log(share / (1 - share))))
    x = model.bins(m)
    score, k = np.full(len(y), model.base), len(USED)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            here = node - first
            hist = np.zeros((2, n, k, n_bins))
            for j in range(k):
                cell = here * n_bins + x[:, j]
                hist[0, :, j] = np.bincount(cell, g, n * n_bins).reshape(n, n_bins)
                hist[1, :, j] = np.bincount(cell, h, n * n_bins).reshape(n, n_bins)
            left = hist.cumsum(axis=3)
            total = left[:, :, :1, -1:]
            right = total - left
            gain = left[0] ** 2 / (left[1] + l2) + right[0] ** 2 / (right[1] + l2) - total[0] ** 2 / (total[1] + l2)
            best = gain.reshape(n, -1).argmax(axis=1)
            worth = gain.reshape(n, -1).max(axis=1) > 1e-6
            model.feature[t, first : first + n] = best // n_bins
            model.limit[t, first : first + n] = np.where(worth, best % n_bins, n_bins)
            node = 2 * node + 1 + (x[np.arange(len(y)), model.feature[t, node]] > model.limit[t, node])
        leaf = node - (2**depth - 1)
        model.value[t] = -rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + l2)
        score += model.value[t][leaf]
    return model


def calibrate(model: Trees, m: np.ndarray, y: np.ndarray) -> None:
    """Slope and offset of the probability: the least loss of smoothed targets on a grid."""
    z, n1 = model.margin(m), y.sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2))

    def loss(slope: float, offset: float) -> float:
        x = slope * z + offset
        return float((np.logaddexp(0, x) - target * x).mean())

    model.slope, model.offset = min(((s, o) for s in np.geomspace(0.1, 2, 40) for o in np.linspace(-2, 2, 41)), key=lambda w: loss(*w))


def holdout(evaluation: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels (1 for other matter than prose) of the half that calibrates, or of the other, which
    only evaluates."""
    rows = json.loads(HOLDOUT.read_text())[int(evaluation) :: 2]
    return np.array([r["statistics"] for r in rows], float), np.array([r["other"] for r in rows], float)


def train(texts: list[str], *, seed: int = 11, longest_copy: int = 20_000) -> Trees:
    """Trees from weakly labelled texts and altered copies of those of fewer than ``longest_copy`` characters (a
    bound on the work of fitting, not on what is classified), calibrated on half of the holdout."""
    rng = np.random.default_rng(seed)
    m = np.concatenate([measure(b) for b in blocks(pa.array(texts, pa.string()))]) if texts else np.zeros((0, len(STATISTICS)))
    y = weak_labels(m)
    prose = [t for t, k in zip(texts, y) if k == 0]
    first = [re.split(r"(?<=[.!?؟۔])\s", t, maxsplit=1)[0][:200] for t in prose[:200]] or ["It was so."]
    extra, kinds = [], []
    for t, k in zip(texts, y):
        if k >= 0 and len(t) < longest_copy:
            for _ in range(1 + (k == 1)):
                extra.append(altered(t, k == 1, first[int(rng.integers(len(first)))], rng))
                kinds.append(k)
    hm, hy = holdout()
    if extra:
        m, y = np.concatenate([m, *[measure(b) for b in blocks(pa.array(extra, pa.string()))]]), np.append(y, kinds)
    keep = y >= 0
    if len(set(y[keep])) < 2:  # nothing to learn from: the hand-labelled rows decide
        m, y, keep = np.concatenate([m, hm]), np.append(y, hy), np.append(keep, np.ones(len(hy), bool))
    model = boost(m[keep], y[keep].astype(float))
    calibrate(model, hm, hy)
    return model


def train_from(df: DataFrame, *, text: str = "text", most_rows: int = 3_000) -> Trees:
    """Trains on about ``most_rows`` distinct texts chosen by a hash of the text: the bound of the sample."""
    n = df.count()  # from the footers of the files
    rows = df.select(field(text).cast("string").alias("t")).filter("trim(t) <> ''").withColumn("h", F.xxhash64("t"))
    if n > most_rows:
        rows = rows.filter(F.pmod("h", F.lit(1 << 20)) < int((1 << 20) * most_rows / n))
    return train([r["t"] for r in sorted(rows.distinct().collect(), key=lambda r: (r["h"], r["t"]))])


def classify(df: DataFrame, model: Trees, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, other)`` of each row with a visible text: the probability that it mainly is no running prose.

    Null, empty and blank texts (also of format characters only) are left out. One pass, no shuffle.
    """
    src = df.select(field(key).alias("_key"), field(text).cast("string").alias("_text"))
    schema = T.StructType([T.StructField(key, src.schema["_key"].dataType), T.StructField("other", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(1)):
                seen = np.array([bool(t.strip()) for t in b.texts], bool)
                p = np.round(model.probability(measure(b)), 6)
                keys = batch.column(0).slice(int(b.rows[0]), len(b.rows)).filter(pa.array(seen))
                yield pa.RecordBatch.from_arrays([keys, pa.array(p[seen])], names=[key, "other"])

    return src.mapInArrow(run, schema)
