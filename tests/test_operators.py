import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import answering, chunking, corpus, fulltext, operations, postings, stars, structure, vectors
from corpusloom.sources import files


def test_chunk_groups():
    assert chunking.group_paragraphs([8, 8, 10, 30, 5], chunking.ChunkConfig(20, 5)) == [[0, 1], [2], [3], [4]]
    assert chunking.group_paragraphs([5, 5, 5, 5], chunking.ChunkConfig(16, 6)) == [[0, 1], [1, 2], [2, 3]]
    assert chunking.group_paragraphs([], chunking.ChunkConfig()) == []


def _units(spark, rows):
    return spark.createDataFrame(rows, "source string, block_id string, chapter_no int, section_no int, page int, sequence int, text string, tokens int")


@pytest.mark.parametrize("partitions", ["1", "8"])
def test_chunks_keep_sections_and_ids(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    rows = [("b", "p1", 1, 1, 1, 1, "one", 5), ("b", "p2", 1, 1, 2, 2, "two", 5), ("b", "p3", 1, 2, 2, 3, "three", 5), ("c", "q1", None, None, None, 1, "four", 40)]
    got = chunking.build_chunks(_units(spark, rows), chunking.ChunkConfig(16, 6)).orderBy("source", "chunk_index").collect()
    assert [(r["source"], r["chunk_index"], r["block_ids"], r["page_start"], r["page_end"], r["token_count"]) for r in got] == [("b", 0, ["p1", "p2"], 1, 2, 12), ("b", 1, ["p3"], 2, 2, 5), ("c", 0, ["q1"], None, None, 40)]
    assert all(len(r["chunk_id"]) == 64 for r in got) and got[0]["text"] == "one\n\ntwo"
    assert chunking.build_chunks(_units(spark, [])).count() == 0
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_query_parser():
    q = fulltext.parse_query('care "the price of" -water Salt "')
    assert q.terms == ("care", "salt") and q.phrases == (("the", "price", "of"),) and q.excluded == ("water",)
    assert fulltext.parse_query("  ").empty and fulltext.parse_query('""').empty
    assert fulltext.query_language("plain") == "en" and fulltext.query_language("نص") == "ar" and fulltext.query_language("گھر") == "ar" and fulltext.query_language("گھر ہے") == "ur"


def test_phrase_order_and_any_or_all(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "beta alpha"), (3, None), (4, "")], "id int, text string")
    found = lambda q: sorted(r["id"] for r in fulltext.search(docs, q, text=F.col("text"), keys=["id"]).collect())
    assert found(fulltext.parse_query('"alpha beta"')) == [1]
    assert found(fulltext.parse_query("gamma beta")) == [1, 2]
    assert found(fulltext.parse_query("gamma beta", every=True)) == [1]
    assert found(fulltext.parse_query("beta -gamma")) == [2]
    assert found(fulltext.parse_query("")) == []


def test_cover_rank_prefers_near_words(spark):
    docs = spark.createDataFrame([(1, "a x b"), (2, "a x x x x b"), (3, "a b a")], "id int, text string")
    q = fulltext.parse_query("a b", every=True)
    rank = {r["id"]: r["rank"] for r in fulltext.search(docs, q, text=F.col("text"), keys=["id"], rank="cover").collect()}
    assert rank == {1: 0.05, 2: 0.02, 3: 0.2}
    mixed = fulltext.parse_query('"b a" x')
    docs = spark.createDataFrame([(1, "b a x"), (2, "x q b a b a"), (3, "b a")], "id int, text string")
    assert {r["id"]: r["rank"] for r in fulltext.search(docs, mixed, text=F.col("text"), keys=["id"], rank="cover").collect()} == {1: 0.1, 2: 0.05}
    every = fulltext.parse_query("a or b c", every=True)
    assert every.groups == (("a",), ("b", "c"))


@pytest.mark.parametrize("text,every", [("well", False), ("well salt", False), ("well salt", True), ('"the well" salt', False), ('"the well" "of salt"', False), ("well or price salt", True), ("well -price", False), ('"the price of salt"', False), ("كتاب", False), ("", False)])
def test_the_index_finds_what_a_scan_finds(spark, tmp_path, text, every):
    docs = spark.createDataFrame([(1, "The well, the well of salt", "en"), (2, "price of the well and the price of salt", "en"), (3, "salt salt the price of salt", "en"), (4, None, "en"), (5, "", "en"), (6, "الكِتَاب والكتاب كِتَابٌ", "ar"), (7, "well " * 50, None)], "id long, text string, lang string")
    path = str(tmp_path / "index")
    postings.write_index(postings.postings(docs, key="id", text=F.col("text"), language=F.col("lang")), path)
    q = fulltext.normalized_query(text, every)
    got = {r["key"]: r["rank"] for r in postings.search(postings.read_index(spark, path), q).collect()}
    folded = docs.withColumn("text", fulltext.content_fold(F.col("text"), F.col("lang")))
    want = {r["id"]: r["rank"] for r in fulltext.search(folded, q, text=F.col("text"), keys=["id"], rank="cover").collect()}
    assert got == want and (bool(got) == bool(text))
    plan = postings.found(postings.read_index(spark, path), q)._jdf.queryExecution().executedPlan().toString()
    assert q.empty or "bucket" in plan.split("PartitionFilters")[1][:60]


def test_excerpt_and_highlight(spark):
    df = spark.createDataFrame([("x" * 200 + " Needle & <b> " + "y" * 300,)], "t string")
    r = df.select(fulltext.excerpt(F.col("t"), ["needle"]).alias("e"), fulltext.highlight(F.col("t"), ["needle"]).alias("h")).first()
    assert r["e"].startswith("…") and r["e"].endswith("…") and "Needle" in r["e"] and "<mark>Needle</mark> &amp; &lt;b&gt;" in r["h"]


def test_hash_vector_and_nearest(spark):
    v = vectors.hash_vector("some words", 32)
    assert sum(x * x for x in v) == pytest.approx(1) and vectors.hash_vector("", 8)[0] == 1.0
    df = vectors.embed(spark.createDataFrame([(1, "some words"), (2, "other things"), (3, None)], "id int, text string"), text="text", dimensions=32)
    top = vectors.nearest(df, v, column="vector", key="id", k=2, min_score=0.9).collect()
    assert [r["id"] for r in top] == [1]
    with pytest.raises(ValueError):
        vectors.check_dimensions([1.0], 2)


def test_retry_gives_up():
    calls, pauses = [], []

    def fail(texts):
        calls.append(1)
        raise OSError

    with pytest.raises(OSError):
        vectors.with_retry(fail, 2, 0.5, pauses.append)([])
    assert len(calls) == 3 and pauses == [0.5, 1.0]


def test_fusion_merges_both_paths(spark):
    k = spark.createDataFrame([("a", 2.0), ("b", 1.0)], "id string, rank double")
    v = spark.createDataFrame([("b", 0.9), ("c", 0.5)], "id string, score double")
    got = {r["id"]: (r["score"], r["retrievers"]) for r in vectors.fuse(k, v, on=["id"]).collect()}
    assert got == {"a": (0.5, "fts"), "b": (pytest.approx(0.7), "fts+vector"), "c": (0.25, "vector")}
    two = spark.createDataFrame([("x", "a", 8.0), ("x", "b", 4.0), ("y", "a", 1.0), (None, "a", 2.0), (None, "b", 1.0)], "q string, id string, rank double")
    per = {(r["q"], r["id"]): r["score"] for r in vectors.fuse(two, v.withColumn("q", F.lit("z")).limit(0), on=["q", "id"]).collect()}
    assert per == {("x", "a"): 0.5, ("x", "b"): 0.25, ("y", "a"): 0.5, (None, "a"): 0.5, (None, "b"): 0.25}
    assert {r["id"] for r in vectors.fuse(k, v, on=["id"], weight_vector=0).collect()} == {"a", "b"}


def test_embedding_plan(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "chunk_id string, content_hash string")
    old = spark.createDataFrame([("a", "1"), ("b", "0")], "chunk_id string, content_hash string")
    assert {r["chunk_id"]: r["action"] for r in vectors.embedding_plan(now, old).collect()} == {"a": "reused", "b": "updated", "c": "new"}


def test_ingest(spark):
    rows = [("/in/a.PDF", "g", 3, "s1"), ("/in/b.pdf", "g", 3, "s1"), ("/in/c.xyz", "g", 3, "s2"), ("/in/d.txt", "g", 0, "s3"), ("/in/e.md", "g", 1, "s4")]
    df = spark.createDataFrame(rows, "path string, category string, size long, sha256 string")
    got = {r["path"]: (r["status"], r["target"]) for r in corpus.ingest(df, spark.createDataFrame([("s4",)], "sha256 string")).collect()}
    assert got["/in/a.PDF"] == ("registered", "raw/g/s1//s1/a.PDF") and got["/in/b.pdf"][0] == "duplicate" and got["/in/e.md"][0] == "duplicate"
    assert got["/in/c.xyz"] == ("quarantined", "quarantine/c.xyz") and got["/in/d.txt"] == ("quarantined", "quarantine/d.txt")


def test_metadata_merge_prefers_approved(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("1", "f", "title", "A", "high", "title_page", "review", t), ("2", "f", "title", "B", "low", "filename", "approved", t), ("3", "f", "author", "C", "high", "first_pages", "rejected", t), ("4", "f", "year", "1", "medium", "first_pages", "review", t), ("5", "f", "year", "2", "medium", "title_page", "review", t)]
    df = spark.createDataFrame(rows, "id string, source_file_id string, field string, value string, confidence string, source string, status string, created_at timestamp")
    best = corpus.merge_candidates(df)
    assert {r["field"]: r["value"] for r in best.collect()} == {"title": "B", "year": "2"}
    assert corpus.overall_confidence(best).first()["overall"] == "low"
    gate = corpus.review_gate(best, auto=True).first()  # the title was approved by hand, so its low confidence does not block
    assert (gate["verdict"], gate["n_approved"]) == ("approved", 0)
    assert corpus.review_gate(best.withColumn("status", F.lit("review")), auto=True).first()["verdict"] == "blocked" and corpus.review_gate(best, auto=False).first()["verdict"] == "waiting"
    assert corpus.publish(best).first()["title"] == "B"


def test_title_page_facts(spark):
    page = "تأليف: ابن سينا\nالطبعة الثانية\nكتاب في الطب والحكمة\nسنة 1392 هـ\nISBN: 978-3-16-148410-0\n7"
    pages = spark.createDataFrame([("f", 1, page)], "file string, page int, text string")
    facts = {r["field"]: r["value"] for r in corpus.marked_facts(pages).collect()}
    assert facts["author"] == "ابن سينا" and facts["edition"] == "الطبعة الثانية"
    assert corpus.year_facts(pages).first()["value"] == "1392 (AH)"
    assert corpus.isbn_facts(pages).first()["value"] == "9783161484100"
    assert corpus.title_guess(pages).first()["value"].startswith("ISBN")
    marked = spark.createDataFrame([("f", 1, "تأليف: a very long name of an author that is longer than the title\nA title\nبسملہ or so, a long line that does not count at all")], "file string, page int, text string")
    assert corpus.title_guess(marked).first()["value"] == "A title"


def test_filename_facts(spark):
    df = spark.createDataFrame([("a", "My_Book_vol_3.pdf"), ("b", "scan.pdf"), ("c", "123.pdf")], "k string, name string")
    got = sorted((r["k"], r["field"], r["value"]) for r in corpus.filename_facts(df, "k", "name").collect())
    assert got == [("a", "edition", "Vol. 3"), ("a", "title", "My Book")]


def test_seed_conflict(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, text string")
    new = spark.createDataFrame([(1, "a"), (2, "x"), (3, "c")], "k int, text string")
    seeded = corpus.seed(old, new, ["k"], "text")
    assert {r["k"]: r["action"] for r in seeded.collect()} == {1: "skipped", 2: "conflict", 3: "created"}
    with pytest.raises(Exception, match="differs"):
        corpus.refuse_conflicts(seeded).collect()


def test_ocr_failures_are_rows(spark):
    def engine():
        def call(file, page):
            if page == 2:
                raise RuntimeError("no image")
            return "a text that is long enough to be all right", 88.0
        return call

    pages = spark.createDataFrame([("f", 1), ("f", 2)], "file string, page int")
    got = {r["page"]: r["status"] for r in corpus.recognise(pages, engine).collect()}
    assert got == {1: "ok", 2: "failed"}


@pytest.mark.parametrize("line,level,number", [("Chapter 3: The Well", 1, 3), ("الباب الثاني في الماء", 1, 2), ("الفصل الأول", 2, 1), ("1.2 Measures", 2, None), ("1.2.3 Weights", 3, None), ("Appendix A", 1, None), ("partial words", None, None), ("plain sentence here.", None, None), ("الباب الخامس والعشرون", 1, 25)])
def test_headings(line, level, number):
    h = structure.heading(line)
    assert (h and h["level"]) == level and (h is None or h["number"] == number)


def test_segments():
    out, dropped = structure.segment("12\n\nLonely Title Here\n\nA paragraph\ngoes on.\n* note one\nstill note\n\nChapter 1\ntext", False)
    assert dropped == 1 and [e["type"] for e in out] == ["heading", "paragraph", "footnote", "heading", "paragraph"]


def test_structure_plan(spark):
    pages = [("b", 1, "Preface text is here."), ("b", 2, "Contents\nOne ..... 3\nTwo ..... 5\nThree ..... 7\nFour ..... 9"), ("b", 3, "Chapter 1 The Well\nFirst text."), ("b", 4, "Chapter 1 The Well\n1.1 Depth\nMore."), ("b", 5, "References\nA book")]
    got = structure.structure_books(spark.createDataFrame(pages, "book_id string, page int, text string")).orderBy("page", "sequence").collect()
    assert [(r["page"], r["type"], r["chapter_no"], r["section_no"]) for r in got if r["page"] != 2] == [(1, "paragraph", 0, None), (3, "heading", 1, None), (3, "paragraph", 1, None), (4, "heading", 1, 1), (4, "paragraph", 1, 1), (5, "heading", 2, None), (5, "reference", 2, None)]
    assert {r["type"] for r in got if r["page"] == 2} == {"toc_entry"}


def test_structure_tables(spark):
    pages = [("b", 1, "Chapter 1 The Well\nFirst text.\n1.1 Depth\nMore."), ("b", 2, "Chapter 2 The Roof\nText."), (None, None, "Lonely text."), ("e", 1, None)]
    blocks = structure.structure_books(spark.createDataFrame(pages, "book_id string, page int, text string"))
    made = structure.tables(blocks)
    assert [(r["chapter_no"], r["title"]) for r in made["chapters"].filter("book_id = 'b'").orderBy("chapter_no").collect()] == [(1, "Chapter 1 The Well"), (2, "Chapter 2 The Roof")]
    assert made["sections"].count() == 1 and made["subsections"].count() == 0 and made["paragraphs"].count() == 4
    assert made["blocks"].select("id").distinct().count() == made["blocks"].count() and made["pages"].count() == 3


def test_blocks_become_units_with_normalised_text(spark):
    blocks = spark.createDataFrame([("s", "a", "paragraph", 1, 1, 1, 2, "one", "en"), ("s", "b", "paragraph", 1, 1, 1, 1, "two", "en"), ("s", "c", "heading", 1, 1, 1, 3, "three", "en"), ("s", "d", "paragraph", 1, 2, 2, 1, "four", None)], "source string, block_id string, type string, chapter_no int, section_no int, page int, sequence int, text string, language string")
    units = chunking.units_of_blocks(blocks, spark.createDataFrame([("b", "TWO")], "block_id string, normalized_text string"))
    got = chunking.build_chunks(units)
    assert [r["text"] for r in got.orderBy("chunk_index").collect()] == ["TWO\n\none", "four"]
    assert {r["block_id"]: r["is_normalized"] for r in units.collect()} == {"a": False, "b": True, "d": False}
    chapters = spark.createDataFrame([("s", 1, "ch")], "source string, chapter_no int, chapter_id string")
    sections = spark.createDataFrame([("s", 1, 2, "se"), ("s", 2, 1, "other")], "source string, chapter_no int, section_no int, section_id string")
    placed = chunking.with_places(got, chapters, sections).orderBy("chunk_index").collect()
    assert [(r["chapter_id"], r["section_id"]) for r in placed] == [("ch", None), ("ch", "se")]


def test_small_stage_operators(spark):
    words = spark.createDataFrame([("f", 1, "a", 90.0), ("f", 1, "b", 70.0), ("f", 1, " ", 10.0), ("f", 1, "c", -1.0), ("f", 2, None, 50.0)], "file string, page int, word string, confidence double")
    assert {r["page"]: r["confidence"] for r in corpus.word_confidence(words, ["file", "page"]).collect()} == {1: 80.0, 2: None}
    files = spark.createDataFrame([("b", 2), ("a", 1), ("c", None)], "id string, created_at int")
    assert [r["id"] for r in corpus.batch(files, 2).collect()] == ["c", "a"] and corpus.batch(files, None).count() == 3
    wanted, stored = (spark.createDataFrame(rows, "target string, sha256 string") for rows in ([("t", "1"), ("u", "2")], [("t", "9"), ("u", "2")]))
    assert [tuple(r) for r in corpus.collisions(wanted, stored).collect()] == [("t", "1", "9")]
    with pytest.raises(ValueError):
        vectors.provider_of("nothing")
    assert vectors.provider_of("collections:OrderedDict") and vectors.provider_of("hashing")(8)(["x"])
    with pytest.raises(ValueError):
        vectors.provider_of("no.such.module:Thing")


def test_quarantined_names_do_not_collide(spark):
    rows = [(f"/in/{d}/x.xyz", "g", 1, f"s{d}") for d in range(3)]
    got = [r["target"] for r in corpus.ingest(spark.createDataFrame(rows, "path string, category string, size long, sha256 string")).orderBy("path").collect()]
    assert got == ["quarantine/x.xyz", "quarantine/x-1.xyz", "quarantine/x-2.xyz"]


def _catalog(spark):
    frame = spark.createDataFrame
    return stars.Catalog(
        frame([("b1", "The Well", None, "en", "f1", "a1", "k1"), ("b2", "The Roof of Salt", "on wells", None, "f2", None, None)], "book_id string, title string, subtitle string, language string, file_id string, author_id string, category_id string"),
        frame([("f1", "abc", "pdf"), ("f2", "bcd", "txt")], "file_id string, sha256 string, format string"),
        frame([("a1", "A. Well")], "author_id string, author string"),
        frame([("k1", "fiqh")], "category_id string, category string"),
        frame([("c1", "b1", 1, "Of salt"), ("c2", "b2", 1, "Of salt and water")], "chapter_id string, book_id string, chapter_no int, chapter string"),
        frame([("s1", "c1", "b1", 1, "Salt in wells")], "section_id string, chapter_id string, book_id string, section_no int, section string"),
    )


def test_searches_say_where_their_hits_stand(spark):
    c = _catalog(spark)
    rows = [("k1", "b1", "c1", "s1", 0, 7, "en", "salt of the well", 1), ("k2", "b2", None, None, 3, 4, "ur", "salt salt", 1), ("k3", "b9", None, None, None, None, "en", "salt of no book", 1), ("k4", "b1", None, None, None, None, "en", None, 1), ("k5", "b2", "zz", None, None, None, "en", "", 1)]
    chunks = spark.createDataFrame(rows, "chunk_id string, book_id string, chapter_id string, section_id string, page_start int, page_end int, language string, text string, rank int").drop("rank")
    index = postings.postings(chunks, key="chunk_id", text=F.col("text"), language=F.col("language"))
    hits = stars.content_search(index, chunks, c, "Salt").collect()
    assert [(r["chunk_id"], r["rank"], r["page"], r["author"], r["category"], r["chapter"], r["section"], r["sha256"]) for r in hits] == [("k2", 0.2, 3, None, None, None, None, "bcd"), ("k1", 0.1, 7, "A. Well", "fiqh", "Of salt", "Salt in wells", "abc")]
    assert [r["chunk_id"] for r in stars.content_search(index, chunks, c, "salt", scope=stars.Scope(category="fiqh")).collect()] == ["k1"]
    assert [r["chunk_id"] for r in stars.content_search(index, chunks, c, "salt", scope=stars.Scope(language="ur", sha="b")).collect()] == ["k2"]
    assert stars.content_search(index, chunks, c, "").count() == 0
    assert [r["book_id"] for r in stars.book_search(c, "well").collect()] == ["b1", "b2"]
    assert [r["book_id"] for r in stars.book_search(c, "well", scope=stars.Scope(language="en", author="a.")).collect()] == ["b1"]
    assert [r["chapter_id"] for r in stars.chapter_search(c, "of SALT".lower()).collect()] == ["c1", "c2"]
    assert [(r["section_id"], r["chapter"], r["book"]) for r in stars.section_search(c, "wells").collect()] == [("s1", "Of salt", "The Well")]
    embedded = spark.createDataFrame([("k1", "m", "1", [1.0, 0.0]), ("k1", "m", "2", [0.0, 1.0]), ("k2", "m", "2", [1.0, 0.1]), ("k2", "n", "9", [0.0, 1.0])], "chunk_id string, model_name string, model_version string, vector array<float>")
    near = stars.vector_search(embedded, chunks, c, [0.0, 1.0], model="m").collect()
    assert [(r["chunk_id"], r["score"], r["book"]) for r in near][0] == ("k1", 1.0, "The Well") and len(near) == 2
    assert stars.vector_search(embedded, chunks, c, [0.0, 1.0], model="none").count() == 0
    both = {r["chunk_id"]: (r["retrievers"], r["format"]) for r in stars.hybrid_search(index, embedded, chunks, c, "salt", [0.0, 1.0], model="m").collect()}
    assert both == {"k1": ("fts+vector", "pdf"), "k2": ("fts+vector", "txt")}
    assert stars.hybrid_search(index, embedded, chunks, c, "salt", None, model="m").first()["score"] == 1.0 * 0.5
    refs = {r["chunk_id"]: r["reference"] for r in stars.citations(chunks, c).collect()}
    assert refs["k1"] == "The Well, ch. Of salt, Salt in wells, p. 7, k1" and refs["k3"] == "b9, k3"
    with pytest.raises(TypeError):
        stars.cite(chunks, "rumour")
    verse = stars.cite(spark.createDataFrame([(2, 3, "en", "T")], "s int, v int, l string, t string"), "translation", surah="s", verse="v", language="l", translator="t")
    assert verse.first()["reference"] == "2:3 (en by T)"


def test_grounding(spark):
    rows = [("Yes [S1]. No [S2].", 2, True), ("Nothing here.", 2, False), ("See [S9].", 2, False), ("One [S1]. Two. Three.", 1, False), ("x", 0, False)]
    df = spark.createDataFrame(rows, "a string, n int, ok boolean").select("ok", answering.grounding(F.col("a"), F.col("n")).alias("g"))
    assert all(r["ok"] == r["g"]["grounded"] for r in df.collect())
    assert {r["g"]["note"] for r in df.collect()} == {"all claims are cited", "answer cites no sources", "markers out of range: [9]", "only 1/3 sentences carry a citation", "no sources provided"}


def test_answer(spark):
    chunks = spark.createDataFrame([("a", "The well was measured by a scribe."), ("b", "Salt is dear.")], "chunk_id string, text string")
    got = answering.answer(spark, "who measured the well", chunks)
    assert got["sources"] == ["a"] and got["answer"].startswith("[S1] The well")
    assert answering.answer(spark, "zzz", chunks)["answer"] == answering.NOTHING
    embedded = vectors.embed(chunks, text="text")
    assert answering.answer(spark, "salt", chunks, embedded=embedded)["sources"][0] == "b"


def test_any_backend_answers(spark):
    rows = [("a", 0.9, "The well."), ("b", 0.2, "Salt."), (None, 0.8, "no id"), ("c", 0.7, " ")]
    stub = answering.Backend(lambda question, limit: spark.createDataFrame(rows, "chunk_id string, score double, text string"))
    got = stub.retrieve("well", answering.AnswerConfig(min_score=0.5)).collect()
    assert [(r["chunk_id"], r["source_no"]) for r in got] == [("a", 1)]


def test_page_images_and_folders_without_an_index(spark, tmp_path):
    def render(content, page):
        if page == 2:
            raise ValueError("no such page")
        return content + bytes([page])

    made = spark.createDataFrame([("f", bytearray(b"x")), ("g", bytearray(b"y"))], "path string, content binary")
    got = files.render_pages(made, render, spark.createDataFrame([("f", 1), ("f", 2), ("f", 1)], "path string, page int")).orderBy("page").collect()
    assert [(r["page"], bytes(r["image"]) if r["image"] else None, r["error"]) for r in got] == [(1, b"x\x01", None), (2, None, "no such page")]
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "0007.txt").write_text("seven")
    (tmp_path / "pages" / "notes.txt").write_text("no page")
    assert [(r["page"], r["text"], r["quality"]) for r in files.read_page_folder(spark, str(tmp_path)).collect()] == [(7, "seven", None)]


def test_ledger_pending_and_audit(spark):
    old = spark.createDataFrame([("a", "failed", 1), ("b", "succeeded", 1)], "source string, status string, version int")
    new = spark.createDataFrame([("a", "succeeded", 2)], "source string, status string, version int")
    ledger = operations.upsert_ledger(old, new, ["source"], "version")
    assert {r["source"]: r["status"] for r in ledger.collect()} == {"a": "succeeded", "b": "succeeded"}
    sources = spark.createDataFrame([("a",), ("c",)], "source string")
    assert [r["source"] for r in operations.pending(sources, old, "source").orderBy("source").collect()] == ["a", "c"]
    items = spark.createDataFrame([("x",)], "book_id string")
    every = dict.fromkeys(["blocks", "chunks", "documents", "embeddings", "normalized"], items)
    assert operations.audit_books(items, every).first()["severity"] == "ok"
    assert {r["rule"] for r in operations.audit_books(items, every | {"embeddings": items.limit(0)}).collect()} == {"not_embedded"}


def test_page_of(spark):
    got = operations.page_of(spark.range(25), [F.col("id")], 2, 10).collect()
    assert [r["id"] for r in got] == list(range(10, 20)) and got[0]["total"] == 25 and got[0]["has_more"]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.md").write_text("hello")
    got = corpus.ingest(files.scan_directory(spark, str(tmp_path))).orderBy("path").collect()
    assert [r["status"] for r in got] == ["registered", "duplicate"] and got[0]["size"] == 5
    (tmp_path / "book" / "pages").mkdir(parents=True)
    (tmp_path / "book" / "pages" / "0001.txt").write_text("page one\n")
    (tmp_path / "book" / "index.json").write_text(json.dumps({"pages": {"total": 2, "with_text": 1}, "page_files": [{"page": 1, "chars": 8, "quality": "ok", "file": "0001.txt"}, {"page": 2, "chars": 0, "quality": "blank", "file": None}]}))
    assert [(r["page"], r["text"].strip()) for r in files.read_page_folder(spark, str(tmp_path / "book")).orderBy("page").collect()] == [(1, "page one"), (2, "")]
    (tmp_path / "q.json").write_text(json.dumps({"translator": "T", "language": "en", "surahs": [{"number": 1, "name_arabic": "x", "ayahs": [{"number": 1, "text": "t"}, {"number": 0, "text": "bad"}]}]}))
    assert files.read_verses(spark, str(tmp_path / "q.json")).count() == 1
    facts = files.user_facts(spark.createDataFrame([("a", '{"Title": "X"}'), ("b", '[{"field": "author", "value": "Y"}]')], "k string, j string"), "j", "k")
    assert sorted((r["k"], r["field"], r["value"]) for r in facts.collect()) == [("a", "title", "X"), ("b", "author", "Y")]
    html = spark.createDataFrame([("<p>Hi &amp; you</p><script>x</script>",)], "h string").select(files.html_text(F.col("h")).alias("t")).first()["t"]
    assert html == "Hi & you"


def test_replace_by_key(spark, tmp_path):
    path = str(tmp_path / "t")
    operations.replace_by_key(spark.createDataFrame([(1, "a"), (2, "a")], "k int, v string"), path, "k")
    operations.replace_by_key(spark.createDataFrame([(2, "b")], "k int, v string"), path, "k")
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "b")]


def test_export_holds_the_texts_of_a_book_in_order_over_several_parts(spark):
    rows = [(b, i, f"c{i:03d}", f"text {b} {i}") for b in (None, "a", "b") for i in range(100 if b == "b" else 2)]
    df = spark.createDataFrame(rows[::-1], "book_id string, sequence int, chunk_id string, text string")
    got = operations.export_books(df)
    assert [tuple(r) for r in got.collect()] == rows
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows become one part
    try:
        parts = got.withColumn("part", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r["part"] for r in parts if r["book_id"] == "b"}) > 1
