import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import name_variants, neighbours

SAME = [("Elizabeth bin Yusuf al-Miskigozun", "al-Miskigozun, Elizabeth bin Yusuf"), ("Dr. Benjamin Numkekoros", "BENJAMIN NUMKEKOROS"), ("William Tugtomudug", "Bill Tugtomudug"), ("Lotmūgulūn, Vicky", "Victoria ibn Khadijah Lotmugulun"), ("V. S. Rimzulokig", "Victoria Sulayman Rimzulokig"), ("Yusuf Zeglozufub", "Yousef Zeglozufub"), ("Kesbuzigek University Press", "Kesbuzigek Univ. Pr."), ("University Press (Kesbuzigek)", "The Kesbuzigek University Press"), ("Yusuf Relrumofil", "Ysuuf Relrumofil"), ("Ed al-Bubgizunos", "Edward al-Būbgizunos"), ("Zaynab Tariq allonzezodos", "Zaynab Tariq al-Lonzezodos"), ("Jim Nizmadudog", "James Nizmadudog"), ("Mike Bergarut", "Michael Bergarut"), ("Dick Bergarut", "Richard Bergarut"), ("Dot Reslufutun", "Dorothy Reslufutun"), ("Jenny Lotmug", "Jennifer Lotmug"), ("Alex Marrigon", "Alexandra Marrigon"), ("Alex Marrigon", "Alexander Marrigon"), ("Marrigon Alexandra Jane", "Alexandra Jane Marrigon"), ("Karimov Nadia", "Nadia Karimov"), ("Nur al-Din Haqqigar", "Noureddine Haqqigar"), ("U. Gazrutetaz", "Osman Gazrutetaz")]
OTHER = [("Rashid Ribdatagen", "Jaafar Ribdatagen"), ("R. Ribdatagen", "Jaafar Ribdatagen"), ("Kesbuzigek University Press", "Kesbuzigek & Sons, Publishers"), ("Benjamin bin Laylah Darbunibal", "Benjamin bin Yusuf Darbunibal"), ("Thomas Nizmadudog", "Thomas Reslufutun"), ("Alexandra Marrigon", "Alexander Marrigon"), ("Hasan Bergarut", "Husayn Bergarut"), ("Ellen Bergarut", "Alan Bergarut"), ("Yusuf bin Tariq Bergarut", "Tariq bin Yusuf Bergarut"), ("Edward Bergarut", "A. Bergarut")]


@pytest.mark.parametrize("a,b", SAME)
def test_variants_fit(a, b):
    assert name_variants.same_entity(name_variants.parse(a), name_variants.parse(b))


@pytest.mark.parametrize("a,b", OTHER)
def test_others_do_not(a, b):
    assert not name_variants.same_entity(name_variants.parse(a), name_variants.parse(b))


@pytest.mark.parametrize("name", [None, "", " ", "n/a", "Unknown", "Anonymous", "various", "12", "???"])
def test_placeholders(name):
    assert name_variants.parse(name) is None


def test_edits():
    assert [name_variants.edits(*p) for p in (("ab", "ba"), ("abc", "abd"), ("abc", "abcd"), ("abc", "abc"), ("abcdef", "uvwxyz"))] == [1, 1, 1, 0, 3]


def test_collision_curve():
    n = name_variants.bands(0.38, 0.98, 3)
    assert 1 - (1 - 0.38**3) ** n >= 0.98 > 1 - (1 - 0.38**3) ** (n - 1)


def test_pairs(spark):
    names = [x for p in SAME for x in p] + ["Rashid Ribdatagen", "Jaafar Ribdatagen", "n/a", None, "", "Rashid Ribdatagen"]
    df = spark.createDataFrame([(n, "x") for n in names], "name string, form string")
    got = {(r["name_a"], r["name_b"]) for r in name_variants.variant_pairs(df).collect()}
    want = {tuple(sorted(p)) for p in SAME if not p[0].startswith("Alex Marrigon")}
    assert want <= got and ("Jaafar Ribdatagen", "Rashid Ribdatagen") not in got
    assert all(a < b for a, b in got)
    assert name_variants.variant_pairs(df.limit(0)).count() == 0


def test_hot_keys_lose_nothing(spark):
    given = ["Thomas", "Thomsa", "Tom", "T.", "Tariq", "Tariiq", "Tarik", "Theodora", "Thelonius"]
    orgs = [f"{c} University Press" for c in ("Nizmadudog", "Nizmaduog", "Nizmadudogg", "Nizmadudok", "Nizmodudag")]
    nodes = name_variants.forms(spark.createDataFrame([(f"{g} Nizmadudog",) for g in given] + [(o,) for o in orgs] + [("Nizmadudog",), ("Nizmaddog",)], "name string")).select("form").distinct()
    wide, fine = (set(map(tuple, name_variants.candidate_pairs(nodes, hot=h).collect())) for h in (500, 2))
    close = {p for p in wide if name_variants.same_entity(*p)}
    assert close <= fine


def _made(rng, n, vowels="aeiou"):
    return "".join(rng.choice("bdfgklmnprstvz") + rng.choice(vowels) for _ in range(n)) + rng.choice("nrstl")


def test_recall_on_names_that_no_list_has(spark):
    """Invented people with slips, initials, titles, moved parts and other spellings of sounds."""
    rng = random.Random(12)
    loose = [("k", "q"), ("i", "ee"), ("u", "oo"), ("f", "ph"), ("s", "ss")]
    want, names, owner = set(), set(), {}
    for k in range(300):
        given, middle, family = _made(rng, 3).capitalize(), _made(rng, 2).capitalize(), _made(rng, 4).capitalize()
        name = f"{given} {middle} {family}"
        at = rng.randrange(1, len(family) - 2)
        swap = family[:at] + family[at + 1] + family[at] + family[at + 2 :]
        drop = given[:2] + given[3:]
        heard = given.lower()
        for a, b in loose:
            heard = heard.replace(a, b, 1)
        forms = [f"{given} {middle} {swap}", f"{drop} {middle} {family}", f"{given[0]}. {middle[0]}. {family}", f"{family}, {given} {middle}", f"{family.upper()} {given} {middle}", f"Dr. {given} {family}", f"{heard.capitalize()} {middle} {family}"]
        for other in forms:
            if other != name:
                want.add(tuple(sorted((name, other))))
                names |= {name, other}
                owner[name] = owner[other] = k
    got = {(r["name_a"], r["name_b"]) for r in name_variants.variant_pairs(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert len(want & got) >= 0.97 * len(want), sorted(want - got)[:8]
    assert sum(owner[a] != owner[b] for a, b in got) == 0


def test_stars_equal_the_sequential_ones(spark):
    rng = np.random.default_rng(1)
    edges = {tuple(sorted(map(str, rng.choice(30, 2, replace=False)))) for _ in range(45)}
    nodes = spark.createDataFrame([(str(i),) for i in range(32)], "form string")
    got = {r["form"]: r["star"] for r in name_variants.star_clusters(nodes, spark.createDataFrame(list(edges), "a string, b string")).collect()}
    near = {str(i): set() for i in range(32)}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    centres = []
    free = set(near)
    for v in sorted(near, key=lambda v: (len(near[v]), len(v), v), reverse=True):
        if v in free:
            centres.append(v)
            free -= near[v] | {v}
    assert set(got) == set(near) and set(got.values()) == set(centres)
    assert all(got[c] == c for c in centres) and all(got[v] in near[v] for v in near if v not in centres)


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "model_name string, chunk_id string, vector array<float>, dimensions int, updated_at int, _class int")


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(300, 24))
    near = base[:60] + 0.1 * rng.normal(size=(60, 24))
    x = np.concatenate([base, near]) * rng.uniform(0.1, 50, (360, 1))
    rows = [("m", f"c{i:03d}", [float(v) for v in r], 24 if i % 3 else None, 1, 0) for i, r in enumerate(x)]
    got = neighbours.neighbours(neighbours.valid_vectors(_vectors(spark, rows)), min_cosine=0.9).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = u @ u.T - 2 * np.eye(360)
    want = {(f"c{i:03d}", f"c{j:03d}") for i in range(360) for j in np.argsort(-cos[i])[:5] if cos[i, j] >= 0.9}
    assert len(want & {(r["_key"], r["_other"]) for r in got}) >= 0.97 * len(want) and len(got) <= len(want)
    near5 = neighbours.neighbours(neighbours.valid_vectors(_vectors(spark, rows)), k=5, queries=spark.createDataFrame([("m", f"c{i:03d}") for i in range(0, 360, 20)], "_model string, _key string")).collect()
    top = {(f"c{i:03d}", f"c{j:03d}") for i in range(0, 360, 20) for j in np.argsort(-cos[i])[:5]}
    assert len(near5) == 90 and len(top & {(r["_key"], r["_other"]) for r in near5}) >= 0.9 * 90


def test_pairs_near_the_threshold_with_many_leaves(spark):
    rng = np.random.default_rng(1)
    n, cos = 3000, rng.uniform(0.9005, 0.92, (3000, 1))
    a, b = rng.normal(size=(2, n, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    x = np.concatenate([a, cos * a + np.sqrt(1 - cos**2) * b / np.linalg.norm(b, axis=1, keepdims=True)])
    rows = [("m", str(i), r.tolist(), 64, 1, 0) for i, r in enumerate(x)]
    members, classes, _ = neighbours._prepared(neighbours.valid_vectors(_vectors(spark, rows)))
    key = {r["_class"]: int(r["_key"]) for r in members.collect()}
    found = neighbours.class_neighbours(classes, min_cosine=0.9, leaf_rows=48)
    pairs = {tuple(sorted((key[r["_q"]], key[r["_p"]]))) for r in found.collect()}
    assert sum((i, i + n) in pairs for i in range(n)) >= 0.98 * n


def test_invalid_vectors_and_versions(spark):
    v = [1.0, 2.0, 3.0]
    rows = [("m", "a", v, 3, 1, 0), ("m", "b", v, None, 1, 0), ("m", "c", [1.0, 2.0], 3, 1, 0), ("m", "d", None, 3, 1, 0), ("m", "e", [0.0] * 3, 3, 1, 0), ("m", "f", [1.0, float("nan"), 1.0], 3, 1, 0), ("m", "g", [], 3, 1, 0), ("m", "h", v, 3, 1, 0), ("m", "h", [-1.0, 5.0, 0.0], 3, 2, 0), ("n", "a", v, 3, 1, 0), (None, "a", v, 3, 1, 0), ("m", None, v, 3, 1, 0), ("m", "a", v, 3, 1, 0), ("m", "i", [float("inf"), 1.0, 1.0], 3, 1, 0)]
    got = neighbours.neighbours(neighbours.valid_vectors(_vectors(spark, rows)), min_cosine=0.9).collect()
    assert sorted((r["_model"], r["_key"], r["_other"]) for r in got) == [("m", "a", "b"), ("m", "b", "a")]
    assert neighbours.neighbours(neighbours.valid_vectors(_vectors(spark, []))).count() == 0


def test_masses_of_copies_stay_linear(spark):
    rows = [("m", f"c{i:03d}", [1.0, 2.0 * (1 + (i >= 100)), 3.0], 3, 1, 0) for i in range(103)]
    got = neighbours.neighbours(neighbours.valid_vectors(_vectors(spark, rows)), k=5, min_cosine=0.9)
    per = {r["_key"]: r["n"] for r in got.groupBy("_key").agg(F.countDistinct("_other").alias("n")).collect()}
    assert len(per) == 103 and {v for k, v in per.items() if k < "c100"} == {5} and got.count() == 103 * 5


def test_chi_square():
    assert neighbours.chi_square_quantile(0.95, 1) == pytest.approx(3.8415, abs=1e-3)
    assert neighbours.chi_square_quantile(0.99, 16) == pytest.approx(32.0, abs=1e-2)
