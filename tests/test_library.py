import pytest
from pyspark.sql import functions as F

from corpusloom.operators import library
from corpusloom.plans import pipeline
from corpusloom.streaming import streams


def _verses(spark):
    rows = [(1, 1, "بِسْمِ ٱللَّهِ", "In the name", "T. One", "en"), (1, 2, "ٱلْحَمْدُ", "Praise be", "T. One", "en"), (1, 1, "بِسْمِ ٱللَّهِ", None, None, None)]
    return spark.createDataFrame(rows, "chapter int, verse int, text string, translation string, translator string, language string")


def test_verses_match_without_vowel_signs(spark):
    assert [r["citation"] for r in library.verse_search(_verses(spark), "بسم").collect()] == ["1:1"]
    assert [r["citation"] for r in library.verse_search(_verses(spark), "praise").collect()] == ["1:2 (T. One)"]
    assert library.verse_search(_verses(spark), "praise", language="ar").count() == 0


def test_reports_match_in_both_languages(spark):
    df = spark.createDataFrame([("c", 7, "Deeds are by intentions", "إنما الأعمال")], "collection string, number int, text string, text_arabic string")
    assert all(library.report_search(df, q).first()["citation"] == "c #7" for q in ("intentions", "الأعمال", "انما"))


def test_requests_are_checked():
    library.validate("x", 10)
    for bad in (("", 10), ("x" * 501, 10), ("x", 0), ("x", 101), ("x", 5, "nowhere")):
        with pytest.raises(ValueError):
            library.validate(*bad)
    assert library.domains("quran") == ["quran"] and library.answer_sources("library") == 6 and library.answer_sources("quran") == 4


def test_text_layer_keeps_the_unknown(spark):
    files = spark.createDataFrame([("a",), ("b",), ("c",)], "file string")
    jobs = spark.createDataFrame([("a", '{"text_pages": 3}'), ("b", '{"text_pages": 0}')], "file string, manifest string")
    assert sorted(r["file"] for r in library.text_layer(files, jobs, "file").collect()) == ["a", "c"]


def test_snippet(spark):
    text = " ".join(f"w{i}" for i in range(50)) + " Needle " + " ".join(f"v{i}" for i in range(50))
    s = spark.createDataFrame([(text,)], "t string").select(library.snippet(F.col("t"), ["needle"]).alias("s")).first()["s"]
    assert "<mark>Needle</mark>" in s and len(s.split()) == 24


def test_block_review(spark):
    blocks = spark.createDataFrame([("b", 1, 1, "draft"), ("b", 1, 2, "draft"), ("b", 1, 3, "draft")], "book_id string, page int, sequence int, status string")
    what = spark.createDataFrame([("b", 1, 1, "approve"), ("b", 1, 2, "reject")], "book_id string, page int, sequence int, action string")
    assert [r["status"] for r in library.review_blocks(blocks, what).orderBy("sequence").collect()] == ["published", "quarantined", "draft"]


def test_pipeline(spark):
    df = spark.range(3)
    runs = []

    def stage(name, fail=False):
        def run(d):
            runs.append(name)
            if fail:
                raise RuntimeError("broken")
            return d
        return run

    p = pipeline.Pipeline({"inspect": stage("inspect"), "extract": stage("extract"), "chunk": stage("chunk", True), "embed": stage("embed")})
    out = p.run(df)
    assert [(o.stage, o.status) for o in out] == [("inspect", "succeeded"), ("extract", "succeeded"), ("chunk", "failed")] and not pipeline.succeeded(out)
    assert [o.status for o in p.run(df, continue_on_error=True)] == ["skipped", "skipped", "failed", "succeeded"]
    assert [o.stage for o in p.run(df, start="extract", stop="extract", force=True)] == ["extract"]
    with pytest.raises(ValueError):
        p.plan("nothing")
    waiting = pipeline.Pipeline({"inspect": lambda d: "waiting", "extract": stage("x")}).run(df)
    assert [o.status for o in waiting] == ["waiting"]


def test_rate_limiter():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    r = pipeline.RateLimiter(2, 1.0, lambda: now[0], sleep)
    for _ in range(3):
        r.wait()
    assert slept == [1.0, 59.0]


def test_first_seen_in_several_batches(spark, tmp_path):
    for i, (ts, user) in enumerate([("2024-01-02 00:00:00", 1), ("2024-01-05 00:00:00", 2), ("2024-01-08 00:00:00", 1), ("2024-01-01 00:00:00", 3)]):
        row = spark.sql(f"SELECT {i}L AS event_id, TIMESTAMP '{ts}' AS ts, {user}L AS user_id, 'a' AS event_type, 1D AS value, '' AS props")
        row.coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    seen = streams.first_seen(streams.source(spark, str(tmp_path / "events"), files_a_batch=1), ["user_id", "event_type"])
    assert sorted(r["user_id"] for r in streams.drain(seen, "append").collect()) == [1, 2, 3]
