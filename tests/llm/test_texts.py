import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import contamination, languages, lookalikes, prose, quality, tokenizing
from corpusloom.llm.queries import TOKENIZERS
from corpusloom.llm.textblocks import blocks

VOCABULARY = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"


@pytest.mark.parametrize("a,b,same", [("Ｆｕｌｌ width", "Full width", True), ("a\u200bb", "ab", True), ("café", "cafe\u0301", True), ("ｃafé", "cafe", False), ("Тhе", "The", True), ("a\u00a0b", "a b", True), ("The", "the", False), ("كتابي", "کتابی", True), ("أحمد", "احمد", False), ("ﻛﺘﺎب", "كتاب", True), ("ﬁt", "fit", True), ("12", "13", False), ("x²", "x2", False), ("", " \u200b", True), ("ئ", "ئ", True), ("a\x00b\x7f", "ab", True), ("a\x00b\x7f", "a\u200bb", True), ("օk", "ok", True), ("ꭲ", "T", False), ("ᎪΤ", "AT", True), ("ꓮ", "A", True), ("𝐀b", "Ab", True), ("Ⲟ", "O", True), ("l", "I", False)])
def test_skeletons(a, b, same):
    assert (lookalikes.skeleton(a) == lookalikes.skeleton(b)) == same


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=40))
def test_one_form_is_stable(text):
    form = lookalikes.one_form(text)
    assert lookalikes.one_form(form) == form


def test_look_alike_pairs(spark):
    rows = [("1", "ab c"), ("2", "a\u200bb c"), ("3", "ab c"), ("4", "AB c"), ("5", None), ("6", ""), ("1", "ab c"), (None, "ab\u00a0c")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "content_block_id string, original_text string, look string, spelling string")
    got = sorted((r["key_a"], r["key_b"]) for r in lookalikes.look_alike_pairs(df).collect())
    assert got == [("1", "2"), ("2", "3")]
    assert sorted((r["key_a"], r["key_b"]) for r in lookalikes.look_alike_pairs(df, expand=1).collect()) == [("1", "2")]
    assert lookalikes.look_alike_pairs(df.limit(0)).count() == 0


def test_look_alike_pairs_of_many_copies(spark):
    rows = [(f"a{i:02d}", "ab c") for i in range(65)] + [("b", "ab\u00a0c")]
    df = spark.createDataFrame(rows, "content_block_id string, original_text string")
    assert sorted(tuple(r) for r in lookalikes.look_alike_pairs(df).collect()) == [(f"a{i:02d}", "b") for i in range(65)]
    assert lookalikes.look_classes(df).groupBy("look").count().collect()[0]["count"] == 66


SAMPLES = ["", " ", "Hello  world\n\n don't we'll ''s 's", "نص عربي ١٢٣", "a" * 3000, "🙂👩\u200d🏫 ½²", "<|endoftext|>", "x'ld 'LL  \t\r\n end ", "\u0301\u0301'd"]


def test_tokens_equal_the_library_and_decode():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    m = tokenizing.merger(VOCABULARY)
    rng = random.Random(1)
    pool = "ab '\n\t\u00a0.,'sdtmlvre 12é٣ع\u0301"
    texts = SAMPLES + ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(400)]
    got = []
    for b in blocks(pa.array(texts)):
        ids, before, begins = tokenizing.encode_block(b, m)
        got += [ids[i:j].tolist() for i, j in zip(before, before[1:])]
        for r, i, j in zip(b.rows, before, before[1:]):
            raw = texts[r].encode()
            ends = [*begins[i + 1 : j], len(raw)]
            assert [tokenizing._pieces(VOCABULARY)[k] for k in ids[i:j]] == [raw[a:z] for a, z in zip(begins[i:j], ends)]
    assert got == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert [tokenizing.decode(g, VOCABULARY) for g in got] == texts


def test_encode_rows(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, " ", 0), (3, "word", 1), (None, "word", 1)], "doc_id long, text string, ids int")
    got = [(r["doc_id"], r["ids"]) for r in tokenizing.encode(df, VOCABULARY).collect()]
    assert (1, []) in got and (2, []) in got and (3, [220]) in got and len(got) == 5
    assert tokenizing.encode(df.limit(0), VOCABULARY).count() == 0
    long = tokenizing.encode(spark.createDataFrame([(1, "a word, é")], "doc_id long, text string"), VOCABULARY, offsets=True).first()
    assert long["begins"][0] == 0 and len(long["begins"]) == len(long["ids"]) and sorted(long["begins"]) == long["begins"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab '1.\n\u3000s", max_size=40), max_size=5))
def test_scan_equals_a_plain_walk(texts):
    b = next(iter(blocks(pa.array(texts, pa.string()))), None)
    if b is None:
        return
    sym, table = tokenizing.symbols(b), tokenizing.transitions()
    state, want = tokenizing.ENDED, []
    for s in sym:
        moved = table[s, state]
        want.append(bool(moved >= tokenizing.STARTS))
        state = moved & 7
    assert tokenizing.word_starts(sym, 4).tolist() == want


EN = "the judge of the village wrote that the price of salt was higher than before"
FR = "le juge du village a écrit que le prix du sel était plus élevé qu'avant"
AR = "كتب القاضي في القرية أن ثمن الملح كان أعلى من قبل"
UR = "گاؤں کے قاضی نے لکھا ہے کہ نمک کی قیمت پہلے سے زیادہ تھی"
ID = "hakim desa menulis bahwa harga garam lebih tinggi daripada sebelumnya"


def _varied(sentence, n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        words = sentence.split()
        rng.shuffle(words)
        out.append(" ".join(words[: rng.randrange(6, len(words) + 1)]) + ".")
    return out


@pytest.fixture(scope="module")
def model():
    texts, labels = [], []
    for code, s in zip(languages.LANGUAGES, (EN, AR, UR, FR, ID)):
        made = _varied(s, 60, 1)
        texts += made
        labels += [code] * 57 + ["fr" if code != "fr" else "en"] * 3  # some wrong labels
    order = random.Random(2).sample(range(len(texts)), len(texts))
    return languages.train([texts[i] for i in order], [labels[i] for i in order])


def test_held_out_sentences(model, spark):
    rows = [(c, t) for c, s in zip(languages.LANGUAGES, (EN, AR, UR, FR, ID)) for t in _varied(s, 20, 9)]
    got = languages.segments(spark.createDataFrame(rows, "row_id string, text string"), model).collect()
    assert sum(r["row_id"] == r["language"] for r in got) >= 0.95 * len(rows)


def test_segments_and_labels(model, spark):
    rows = [("a", f"{EN}. {FR}.", "en"), ("b", f"{EN}.", None), ("c", f"{EN}.", "English "), ("d", None, "en"), ("e", "", ""), ("f", "12. 34.", "en"), ("b", f"{EN}.", None), ("g", f"{AR}۔", "EN-GB")]
    df = spark.createDataFrame(rows, "row_id string, text string, label string")
    got = sorted((r["row_id"], r["language"]) for r in languages.unnamed_languages(df, model).collect())
    assert got == [("a", "fr"), ("b", "en"), ("g", "ar")]
    assert languages.segments(df, model).filter("row_id = 'f' and language is not null").count() == 0
    shares = languages.document_languages(languages.segments(df.filter("row_id = 'a'"), model)).collect()
    assert {r["language"] for r in shares} == {"en", "fr"} and sum(r["share"] for r in shares) == pytest.approx(1, abs=1e-5)
    assert languages.unnamed_languages(df.limit(0), model).count() == 0
    assert languages.train([], []).threshold == 1.0


def test_quotations_and_mixed_sentences(model, spark):
    quoted = "the teacher said to them all “le juge du village a écrit que le prix du sel était plus élevé” today"
    short = f"the judge of the village wrote “le prix du sel” before the price was higher than that."
    whole = "the judge of the village said “le juge du village a écrit que le prix était élevé.” before the price"
    rows = [("a", quoted, "en"), ("b", short, "en"), ("d", whole, "en")]
    df = spark.createDataFrame(rows, "row_id string, text string, label string")
    got = {(r["row_id"], r["kind"], r["language"]): {k: t for k, t, _ in rows}[r["row_id"]][r["start"] : r["end"]] for r in languages.segments(df, model).collect()}
    assert got["a", "sentence", "en"] == quoted and got["a", "quotation", "fr"].startswith("“le juge")
    assert got["b", "sentence", "en"] == short and got["b", "quotation", "fr"] == "“le prix du sel”"
    assert got["d", "sentence", "fr"].endswith("”")
    assert sorted((r["row_id"], r["language"]) for r in languages.unnamed_languages(df.filter("row_id in ('a', 'b', 'd')"), model).collect()) == [("d", "fr")]


def test_long_words_count_whole(model):
    tokens = languages._Tokens(model)
    assert tokens.sizes == [] and tokens["x" * 500] == [0] and tokens.sizes[0] > 1500


# Sentences in languages that no model here is trained on.
UNSEEN = ["El maestro de la aldea escribió que el precio de la sal era más alto que antes.", "No vinieron a la casa porque llovía mucho durante toda la noche.", "Der Lehrer des Dorfes schrieb, dass der Preis des Salzes höher war als zuvor.", "Sie kamen nicht nach Hause, weil es die ganze Nacht stark regnete.", "Il maestro del villaggio scrisse che il prezzo del sale era più alto di prima.", "O professor da aldeia escreveu que o preço do sal era mais alto do que antes.", "Köyün öğretmeni tuzun fiyatının eskisinden daha yüksek olduğunu yazdı.", "آموزگار روستا نوشت که بهای نمک از پیش بیشتر بود و مردم به خانه نیامدند.", "Учитель деревни написал, что цена соли была выше, чем раньше.", "De leraar van het dorp schreef dat de prijs van het zout hoger was dan voorheen.", "Nauczyciel we wsi napisał, że cena soli była wyższa niż przedtem.", "Ο δάσκαλος του χωριού έγραψε ότι η τιμή του αλατιού ήταν υψηλότερη."]


def test_unseen_languages_are_mostly_rejected(spark, tmp_path):
    from corpusloom.llm import queries

    folder = "/root/testdata/sf0.01"
    rows = queries._p6_rows(spark, folder)
    trained = languages.train_from(rows, text="text", label="label")
    assert languages.train_from(rows, text="text", label="label") is trained
    trained.save(str(tmp_path / "model.npz"))
    again = languages.load(str(tmp_path / "model.npz"))
    assert np.array_equal(again.table, trained.table) and again.threshold == trained.threshold
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(UNSEEN)], "row_id string, text string")
    accepted = languages.segments(df, again).filter("language is not null and kind = 'sentence'").count()
    own = languages.segments(rows, again, key="row_id").filter("kind = 'sentence' and words >= 3")
    mixed = spark.createDataFrame([("m", f"{EN} {FR}.")], "row_id string, text string")
    part = languages.segments(mixed, again).filter("kind = 'part'").collect()
    assert len(part) == 1 and {"fr": FR, "en": EN}[part[0]["language"]][:30] in f"{EN} {FR}."[part[0]["start"] :][:45]
    assert accepted <= 6 and own.filter("language is null").count() <= 0.003 * own.count()


ITEM = "In Ejrangrath a modest lexicon was hidden by the calligrapher until the great fire and on sheet 340 the scribe of Ejrolfjan lists the sharing of tools and a bitter primer"
FILL = "The miller of another valley speaks at length about rain and wheat while nobody listens to him any more today. "


def _changed(every, seed=0):
    words = ITEM.split()
    return " ".join("changed" if i % every == every - 1 else w for i, w in enumerate(words))


def test_leaks(spark):
    words = ITEM.split()
    docs = [(1, FILL + ITEM + FILL), (2, FILL + " ".join(words[4:23]).upper().replace(" ", "\n") + FILL), (3, FILL + _changed(9)), (4, FILL + _changed(3)), (5, " ".join(words[:10]) + FILL + " ".join(words[10:19])), (6, " ".join(words[:12])), (7, None), (8, ""), (9, FILL * 40), (1, FILL + ITEM + FILL), (10, FILL + "".join(words) + FILL), (11, ITEM.replace("e", "е").replace("fi", "ﬁ"))]
    items = [(1, ITEM), (2, "short item of only six words"), (3, None), (4, "")]
    df, it = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted({(r["doc_id"], r["item_id"]) for r in contamination.leaks(df, it).collect()})
    assert got == [(d, 1) for d in (1, 2, 3, 5, 10, 11)]
    blocked = contamination.leaks(df, it, block_chars=100)
    assert sorted({(r["doc_id"], r["item_id"]) for r in blocked.collect()}) == got
    assert contamination.leaks(df, it.limit(0)).count() == 0 and contamination.leaks(df.limit(0), it).count() == 0


def test_leak_filter_loses_nothing():
    """Every alteration within the edit budget that the alignment accepts also passes the filter."""
    rng, words = random.Random(4), ITEM.split()
    x = contamination.build_index([1], [ITEM])
    texts = []
    for _ in range(200):
        lo = rng.randrange(len(words) - 17)
        part = words[lo : lo + 18]
        for i in rng.sample(range(18), 2):
            part[i] = rng.choice(["other", "x", "longerword"])
        texts.append(FILL + " ".join(part) + " " + FILL)
    found = set()
    for b in blocks(pa.array(texts)):
        found |= set(b.rows[contamination._scan(b, x)[0]].tolist())
    assert len(found) == len(texts)


def _words(n, seed, lengths=(1, 6)):
    rng = random.Random(seed)
    return ["".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(*lengths))) for _ in range(n)]


def _found(items, texts):
    x = contamination.build_index(list(range(len(items))), items)
    got = set()
    for b in blocks(pa.array([contamination._whole(t) for t in texts], pa.string())):
        doc, part, _ = contamination._best(*contamination._scan(b, x), x)
        got |= {(int(b.rows[d]), i) for d, k in zip(doc, part) for i in x.ids[k]}
    return got


def test_short_items():
    items = ["what is the capital of", "paris", "ab", "paris is in france", "?", " "]
    texts = [FILL + "What is, the capital of Spain?", "comparison", "not PARIS!", "x ab y", "xab y", "they say paris is in france", "paris was in france", "a b"]
    assert _found(items, texts) == {(0, 0), (2, 1), (5, 1), (6, 1), (3, 2), (7, 2), (5, 3)}


def test_words_of_a_letter_or_two():
    rng = random.Random(3)
    words = [rng.choice("abcdefghiklmnoprstuvwz") + rng.choice(["", "a", "o", "x"]) for _ in range(30)]
    changed = words[4:22]
    changed[5], changed[11] = "qqq", "jj"
    assert _found([" ".join(words)], [" ".join(["some", "talk", *changed, "and", "more"]), " ".join(words[:12])]) == {(0, 0)}


def test_a_long_item_is_found_wherever_it_is_cut():
    words = _words(12000, 5)
    rng, texts = random.Random(6), []
    for _ in range(60):
        at = rng.randrange(len(words) - 18)
        texts.append(FILL + " ".join(words[at : at + 18]) + " " + FILL)
    texts.append(FILL + " ".join(words[-60:]))
    assert len(" ".join(words)) > 66_000
    assert _found([" ".join(words)], texts) == {(i, 0) for i in range(61)}


def test_slips_of_the_pen():
    words = _words(40, 8, (2, 5))
    slips = {"change": lambda w: w[:2] + "q" + w[3:], "omit": lambda w: w[:1] + w[2:], "insert": lambda w: w[:2] + "x" + w[2:], "swap": lambda w: w[0] + w[2] + w[1] + w[3:]}
    texts = [FILL + " ".join(f(w) if i % 6 == 5 else w for i, w in enumerate(words)) + " " + FILL for f in slips.values()]
    assert _found([" ".join(words)], texts) == {(i, 0) for i in range(4)}


def test_recall_of_altered_passages():
    rng = random.Random(9)
    items = [" ".join(_words(rng.randint(28, 60), 100 + k)) for k in range(40)]
    texts, want = [], set()
    for k, item in enumerate(items):
        words = item.split()
        for _ in range(10):
            at = rng.randrange(len(words) - 17)
            part = words[at : at + 18]
            kind = rng.randrange(4)
            if kind == 1:
                for i in rng.sample(range(18), 2):
                    part[i] = rng.choice(["other", "x", "longerword"])
            if kind == 2:
                part = [w.upper() + rng.choice(["", ",", "\u200b", "\n"]) for w in part]
            if kind == 3:
                part[9:9] = FILL.split()
            want.add((len(texts), k))
            texts.append(FILL + " ".join(part) + " " + FILL)
    got = _found(items, texts)
    assert len(got & want) >= 0.99 * len(want) and len(got - want) == 0


def test_leaks_of_passages_that_many_items_share(spark):
    rng = random.Random(6)
    own = ["".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") for _ in range(4)) for _ in range(400)]
    shared = " ".join(own[:20])
    items = [(i, f"{shared} {' '.join(own[30 + 9 * i : 39 + 9 * i])}") for i in range(40)] + [(100 + i, ITEM) for i in range(40)]
    changed = shared.split()
    changed[5] = changed[14] = "other"
    docs = [(1, FILL + shared + " " + FILL), (2, FILL + " ".join(changed[1:19])), (3, FILL + ITEM), (4, FILL + " ".join(own[:9]))]
    got = contamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = {(d, i) for d in (1, 2) for i in range(40)} | {(3, 100 + i) for i in range(40)}
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want


PROSE = "The keeper of the old library had written that the price of salt was higher than before, and they did not believe him. It was a long winter in the valley. "
LIST = "\n".join(f"well {i}, {i * 7 % 90}, {i * 31 % 700}" for i in range(30))


def test_statistics(spark):
    rows = [(1, PROSE), (2, LIST), (3, None), (4, ""), (5, "one two\n\nthree.")]
    got = {r["doc_id"]: r for r in quality.statistics(spark.createDataFrame([(*r, 0.0) for r in rows], "doc_id long, text string, words double")).collect()}
    assert got[5]["words"] == 3 and got[5]["lines"] == 2 and got[5]["punctuated_lines"] == 0.5
    assert got[1]["prose_line_share"] == 1 and got[2]["prose_line_share"] == 0 and got[2]["digit_ratio"] > 0.3
    assert all(v == 0 for k, v in got[3].asDict().items() if k != "doc_id") and got[4]["words"] == 0


def test_statistics_do_not_depend_on_the_block():
    texts = [PROSE, LIST, "", "x", PROSE.upper(), "\n\n", "é́ا" * 5]
    whole = np.concatenate([quality.measure(b) for b in blocks(pa.array(texts))])
    single = np.concatenate([quality.measure(b) for b in blocks(pa.array(texts), 1)])
    assert np.allclose(whole, single)


def test_prose_classifier(spark):
    rng = random.Random(5)
    words = PROSE.replace(".", "").replace(",", "").lower().split()

    def story():
        return " ".join(" ".join(rng.choice(words) for _ in range(12)).capitalize() + "." for _ in range(rng.randrange(2, 8)))

    def table():
        return "\n".join(f"item {rng.randrange(99)} | {rng.randrange(999)} | {rng.randrange(999)}" for _ in range(rng.randrange(8, 30)))

    model = prose.train([f() for _ in range(80) for f in (story, table)])
    rows = [(1, PROSE), (2, LIST), (3, None), (4, " \n"), (5, story()), (6, table()), (6, table())]
    got = [(r["doc_id"], r["other"] >= 0.5) for r in prose.classify(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, other int"), model).collect()]
    assert sorted(got) == [(1, False), (2, True), (5, False), (6, True), (6, True)]
    m, y = prose.holdout(evaluation=True)
    assert ((model.probability(m) >= 0.5) == y).mean() > 0.85  # of a model of two kinds of matter only
    assert len(prose.train([]).value) and prose.classify(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_holdout_is_what_the_documents_are():
    """Every row names a document of the test tables, its text and its statistics."""
    import hashlib
    import json

    import pyarrow.parquet as pq

    rows = json.loads(prose.HOLDOUT.read_text())
    assert len(rows) >= 119
    for scale in {r["scale"] for r in rows}:
        t = pq.read_table(f"/root/testdata/{scale}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
        texts = dict(zip(t["doc_id"], t["text"]))
        own = [r for r in rows if r["scale"] == scale]
        assert all(hashlib.md5(texts[r["doc_id"]].encode()).hexdigest() == r["md5"] for r in own)
        m = np.concatenate([quality.measure(b) for b in blocks(pa.array([texts[r["doc_id"]] for r in own]))])
        assert np.allclose(m, [r["statistics"] for r in own], atol=2e-5)


def test_evaluation_rows_with_the_model_of_the_tables(spark):
    model = prose.train_from(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    m, y = prose.holdout(evaluation=True)
    p = model.probability(m)
    assert ((p >= 0.5) == y).mean() >= 0.98 and np.mean((p - y) ** 2) < 0.02
