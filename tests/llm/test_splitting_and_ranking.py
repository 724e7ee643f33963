import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import fused_ranking, splitting

TEXTS = st.lists(st.sampled_from(["word ", "a sentence ends. ", "line\n", "para\n\n", "x" * 70, "é́́", "؟ ", "- item\n", "\r\n\r\n"]), min_size=0, max_size=120).map("".join)


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.integers(40, 300), st.integers(0, 19))
def test_pieces_cover_the_text(text, most, overlap):
    parts = splitting.cut(text, most, overlap)
    assert parts[0][0] == 0 and parts[-1][1] == len(text) and all(b - a <= most for a, b in parts)
    for (a, b), (c, d) in zip(parts, parts[1:]):
        assert a < c <= b < d and b - c <= overlap
    joined = text[slice(*parts[0])] + "".join(text[b:d] for (_, b), (_, d) in zip(parts, parts[1:]))
    assert joined == text


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.integers(40, 300), st.integers(0, 19))
def test_cuts_cost_as_little_as_any(text, most, overlap):
    at, cost = splitting.boundaries(text, max(1, overlap // 2 or most // 4))
    start, even = splitting.starts(at, cost, overlap), most * 0.8
    assert all(x <= y for x, y in zip(start, start[1:]))

    def price(i, j):
        size = at[j] - (start[i] if i else 0)
        return splitting.UNEVEN * (size / even - 1) ** 2 + cost[j] + splitting.PIECE if size <= most else float("inf")

    least = [0.0]
    for j in range(1, len(at)):
        least.append(min(least[i] + price(i, j) for i in range(j)))
    if least[-1] < float("inf"):
        ends = splitting.best_cuts(at, cost, start, most, even)
        assert sum(price(i, j) for i, j in zip(ends, ends[1:])) == pytest.approx(least[-1])


@pytest.mark.parametrize("size", [40, 129, 385, 433, 1500])
def test_sentences_of_any_length_overlap(size):
    text = "".join(" ".join(["word"] * (size // 5)) + f" {i}. " for i in range(12000 // size))
    parts = splitting.cut(text, 2048, 256)
    assert len(parts) > 3 and all(128 <= b - c <= 256 for (_, b), (c, _) in zip(parts, parts[1:]))
    assert all(text[b - 1] == " " and text[c - 1] == " " for (_, b), (c, _) in zip(parts, parts[1:]))


def test_one_unbroken_word_overlaps():
    parts = splitting.cut("x" * 9000, 2048, 256)
    assert all(b - a <= 2048 for a, b in parts) and all(128 <= b - c <= 256 for (_, b), (c, _) in zip(parts, parts[1:]))


def test_cuts_prefer_paragraphs():
    text = "First part. It goes on here.\n\n" * 8
    assert all(text[:b].endswith("\n\n") for _, b in splitting.cut(text, 100, 10))


def test_the_overlap_must_be_smaller():
    with pytest.raises(ValueError):
        splitting.cut("x" * 50, 20, 10)


def test_split_edge_cases(spark):
    rows = [("a", "x " * 3000, "en", 1, 9), ("b", None, "en", 1, 9), ("c", "", "en", 1, 9), ("d", "word " * 400, "ar", 1, 9), (None, "y" * 5000, None, 1, 9), ("a", "x " * 3000, "en", 1, 9)]
    df = spark.createDataFrame(rows, "chunk_id string, text string, language string, piece int, _key int")
    got = splitting.split_oversized(df, keep_small=True)
    assert got.filter("tokens > 512").count() == 0
    per = {r["chunk_id"]: r["n"] for r in got.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert per["c"] == 1 and "b" not in per and per["a"] == 2 * got.filter("chunk_id = 'a'").first()["n_pieces"] and per["d"] > 1
    assert splitting.split_oversized(df.limit(0)).count() == 0


def test_latest_version_decides(spark):
    rows = [("a", "x" * 9000, "en", 1), ("a", "short", "en", 2), ("b", "short", "en", 1), ("b", "y" * 9000, "en", 2), ("c", None, "en", None), ("d", "z" * 9000, None, None)]
    df = spark.createDataFrame(rows, "chunk_id string, text string, language string, updated_at int")
    assert sorted(r["chunk_id"] for r in splitting.latest_oversized(df).collect()) == ["b", "d"]


def _borda(rows, weights):
    out = {}
    for g in {r[0] for r in rows}:
        items = {}
        for r in rows:
            if r[0] == g:
                old = items.get(r[1], [None] * len(weights))
                items[r[1]] = [max((x for x in p if x is not None), default=None) for p in zip(old, r[2:])]
        n, sums = len(items), dict.fromkeys(items, 0.0)
        for k, w in enumerate(weights):
            for i, s in items.items():
                v = s[k]
                have = [t[k] for t in items.values() if t[k] is not None]
                rank = (n + 1) / 2 if v is None else 1 + sum(x > v for x in have) + (sum(x == v for x in have) - 1) / 2
                sums[i] += w * ((n - rank) / (n - 1) if n > 1 else 0.5)
        for pos, i in enumerate(sorted(sums, key=lambda i: (-round(sums[i], 9), i)), 1):
            out[g, i] = (round(sums[i], 9), pos)
    return out


@pytest.mark.parametrize("hot_rows", [1_000_000, 30])
def test_borda_against_brute_force(spark, hot_rows):
    rng = random.Random(3)
    pick = lambda: rng.choice([None, 0.0, 1.0, 2.5, 1e9, -3.0])
    rows = [(rng.choice("gggggh"), f"i{rng.randrange(70):02d}", pick(), pick()) for _ in range(150)] + [("one", "x", None, None)]
    df = spark.createDataFrame(rows, "query_id string, chunk_id string, s double, t double")
    got = {(r["query_id"], r["chunk_id"]): (pytest.approx(r["points"]), r["position"]) for r in fused_ranking.borda(df, {"s": 1.0, "t": 2.0}, hot_rows=hot_rows).collect()}
    assert got == _borda(rows, [1.0, 2.0])


def test_borda_nan_infinite_null_and_empty(spark):
    rows = [("q", "a", float("nan")), ("q", "b", float("inf")), ("q", "c", 1.0), (None, None, 1.0)]
    df = spark.createDataFrame(rows, "query_id string, chunk_id string, s double")
    got = {r["chunk_id"]: r["position"] for r in fused_ranking.borda(df, {"s": 1.0}).filter("query_id = 'q'").collect()}
    assert got == {"b": 1, "a": 2, "c": 3} and fused_ranking.borda(df, {"s": 1.0}).count() == 4
    assert fused_ranking.borda(df.limit(0), {"s": 1.0}).count() == 0
