"""Spellings of one person or organisation: MinHash banding, Monge-Elkan similarity, star clustering."""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.session import materialize

# Fixed values. Values that name nobody, folded.
PLACEHOLDERS = {"", "n a", "na", "none", "null", "nil", "unknown", "unknown author", "author unknown", "not known", "anonymous", "anon", "various", "various authors", "several", "s n", "sine nomine", "tba", "tbd", "no author", "not available", "not given", "collective", "et al", "test", "xxx"}
HONORIFICS = {"dr", "prof", "professor", "mr", "mrs", "ms", "miss", "sir", "dame", "lord", "lady", "rev", "imam", "shaykh", "sheikh", "shaikh", "ustadh", "ustad", "mufti", "mawlana", "maulana", "allama", "allamah", "hafiz", "hajji", "haji", "qadi", "sayyid", "syed", "mullah", "jr", "sr", "phd"}
PARTICLES = {"al", "el", "ul", "ibn", "bin", "ben'", "bint", "binti", "b'", "the", "of", "de", "von", "van"}
# Short and pet forms of common given names, and abbreviations of them; a form can belong to several names.
NICKNAMES = {
    "alexander": "alex al sandy alec sasha lex", "alexandra": "alex sandra sandy", "andrew": "andy drew", "anthony": "tony", "barbara": "barb babs", "benjamin": "ben benny benjy benj", "catherine": "cathy cate", "charles": "charlie chas chuck chaz", "christopher": "chris kit", "christine": "chris tina", "daniel": "dan danny", "david": "dave davy", "deborah": "deb debbie", "donald": "don", "dorothy": "dot dottie dolly",
    "edward": "ed eddie ted ned teddy", "eleanor": "ellie nell nora", "elizabeth": "beth liz eliza lizzie betty betsy libby", "eugene": "gene", "frances": "fran fanny", "francis": "frank", "frederick": "fred freddy", "gerald": "gerry jerry", "george": "geo georgie", "gregory": "greg gregg", "harold": "hal harry", "helen": "nell nellie", "henry": "harry hank hal", "isabella": "bella izzy", "jacob": "jake", "james": "jim jimmy jamie jas", "jennifer": "jen jenny", "john": "jack johnny jno", "jonathan": "jon", "joseph": "joe joey jos", "josephine": "jo josie",
    "katherine": "kate kathy katie kathryn kat", "kenneth": "ken kenny", "lawrence": "larry laurie", "leonard": "len lenny leo", "margaret": "maggie peggy meg madge", "martha": "patty", "mary": "molly polly", "matthew": "matt", "michael": "mike mick micky", "nathaniel": "nat nate", "nicholas": "nick nico nicky nicolas", "ottilie": "otty ottie tilly", "patricia": "pat trish patty tricia", "patrick": "pat paddy", "peter": "pete", "philip": "phil pip", "rebecca": "becky", "richard": "dick rick rich ricky", "robert": "rob bob bobby robt robbie", "ronald": "ron", "rosemary": "rosie", "samuel": "sam sammy saml", "samantha": "sam", "sarah": "sally", "stephen": "steve", "susan": "sue susie", "teresa": "terry tess", "theodore": "ted theo", "thomas": "tom thos tommy", "timothy": "tim", "victoria": "vicky vicki tori", "walter": "walt wally", "william": "will bill wm billy willie",
    "muhammad": "md mhd mohd",
}
ORGANISATION = {"society": "soc", "press": "pr", "university": "univ", "library": "lib", "international": "intl int", "publishers": "pub publ publishing pubs publrs publisher", "company": "co", "institute": "inst", "studies": "stud", "manuscript": "ms mss manuscripts", "house": "", "sons": "", "books": "", "old": "", "dar": "darul", "maktabat": "maktaba maktabah", "foundation": "found fdn", "academy": "acad", "centre": "center ctr", "association": "assoc", "brothers": "bros", "editions": "edns", "printing": ""}
#: Words that an organisation's name can do without.
EXTRA = {"ltd", "inc", "limited", "llc", "plc", "and", "of", "for", "the", "al", "el", "ul", "company"}
KINDS = {"society", "press", "university", "library", "publishers", "institute", "house", "sons", "dar", "maktabat", "foundation", "academy", "centre", "association", "editions"}

SEPARATE = "\x1f"


@cache
def _names_of() -> dict[str, frozenset[str]]:
    """The names that a nickname, or a name itself, can stand for."""
    out: dict[str, set[str]] = {}
    for name, short in NICKNAMES.items():
        for v in (name, *short.split()):
            out.setdefault(v, set()).add(name)
    return {k: frozenset(v) for k, v in out.items()}


_SOUNDS = [(re.compile(a), b) for a, b in (("ph", "f"), ("kh|q", "k"), ("ch|sch", "sh"), ("th", "s"), (r"(?:[aeu]l|[aeu])d+[ie]n+e?$", "udin"), ("ee|ie(?=.)", "i"), ("oo|ou", "u"), ("e[iy]|ay", "ai"), (r"(?<=[^aeiouy])e$", ""), (r"(?<=[aeiouy])h$", ""), ("o", "u"), ("e", "a"), ("y", "i"), (r"(.)\1+", r"\1"))]


@lru_cache(200_000)
def sound(token: str) -> str:
    """A given name with the usual freedoms of spelling taken out: doubled letters, long and weak vowels, k and q,
    th and s, a last h. Rules, in this order, in place of lists of spellings."""
    for pattern, by in _SOUNDS:
        token = pattern.sub(by, token)
    return token


@cache
def _organisation_words() -> dict[str, str]:
    return {v: k for k, vs in ORGANISATION.items() for v in (k, *vs.split())}


@lru_cache(200_000)
def edits(a: str, b: str, most: int = 3) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours from a to b, at most ``most``."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) >= most:
        return most
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if two is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        if min(row) >= most:
            return most
        two, one = one, row
    return min(one[-1], most)


def _folded(name: str) -> str:
    out = unicodedata.normalize("NFKD", name)
    out = "".join(c for c in out if unicodedata.category(c) not in ("Mn", "Cf")).casefold()
    return re.sub(r"['’‘`ʿʾ]", "", out)


@lru_cache(100_000)
def _org_word(t: str) -> str | None:
    words = _organisation_words()
    if t in words:
        return words[t]
    if len(t) >= 5:
        for w in ORGANISATION:
            if len(w) >= 5 and edits(t, w) == 1:
                return w
    return None


def _bare(t: str) -> str:
    """A family name without a joined article."""
    return t[2:] if len(t) >= 8 and t[:2] in ("al", "el") else t


def parse(name: str | None) -> str | None:
    """A canonical form ``kind, given, others, family`` in one string; null for what names nobody."""
    if name is None:
        return None
    text = _folded(name)
    plain = " ".join(re.findall(r"[^\W_]+", text))
    if plain in PLACEHOLDERS or not re.search(r"[^\W\d_]", plain):
        return None
    tokens = re.findall(r"[^\W_]+", text.replace("&", " and "))
    known = [_org_word(t) for t in tokens]
    if any(k in KINDS for k in known):
        words = sorted({k for k in known if k and k not in EXTRA})
        core = [_bare(t) for t, k in zip(tokens, known) if k is None and t not in EXTRA]
        return SEPARATE.join(["o", "", " ".join(words), " ".join(sorted(core))])

    def side(part: str) -> list[str]:
        found = [t for t in re.findall(r"[^\W_]+", part) if t not in HONORIFICS and t not in PARTICLES]
        out: list[str] = []
        for t in found:
            if t == "din" and out:  # a compound with the article, written apart
                out[-1] += "uddin"
            else:
                out.append(t)
        return out

    left, comma, right = text.partition(",")
    if comma and side(right):
        family, given = side(left), side(right)
    else:
        every = side(text)
        family, given = every[-1:], every[:-1]
    if not family:
        return SEPARATE.join(["p", "", "", " ".join(tokens)])
    given = [next(iter(names)) if len(names := _names_of().get(t, frozenset())) == 1 else t for t in given]
    return SEPARATE.join(["p", given[0] if given else "", " ".join(given[1:]), " ".join(_bare(t) for t in family)])


@lru_cache(500_000)
def token_similarity(a: str, b: str, slips: int = 1) -> float:
    """1 for names that are equal, sound equal or can be short for one name; 0.9 for an initial; for up to
    ``slips`` slips of the pen, in spelling or sound, by their share of the length."""
    if a == b:
        return 1.0
    if len(a) == 1 or len(b) == 1:
        one, name = (a, b) if len(a) == 1 else (b, a)
        return 0.9 if any(n[0] == one or {n[0], one} in ({"o", "u"}, {"i", "y"}, {"k", "q"}) for n in (name, *_names_of().get(name, ()))) else 0.0
    if a in NICKNAMES and b in NICKNAMES:
        return 0.0  # names of their own
    x, y = _names_of().get(a, frozenset([a])), _names_of().get(b, frozenset([b]))
    if x & y:
        return 1.0
    return max(_alike(m, n, slips) for m in x | {a} for n in y | {b})


def _alike(a: str, b: str, slips: int) -> float:
    x, y = sound(a), sound(b)
    if x == y and min(len(a), len(b)) >= 5:
        return 1.0

    def near(a: str, b: str) -> float:
        d, most = edits(a, b), max(len(a), len(b))
        return 1 - d / most if d <= slips and most >= (4 if slips == 1 else 3) * d else 0.0

    return max(near(a, b), near(x, y) if min(len(a), len(b)) >= 5 else 0.0)


def _initial(name: str) -> str:
    """What the first letters of spellings of one name have in common: vowels are one, and q is k."""
    return "a" if name and name[0] in "aeiouy" else "k" if name[:1] == "q" else name[:1]


def monge_elkan(a: list[str], b: list[str], slips: int = 1) -> float:
    """The mean over the tokens of the shorter list of the best similarity in the other."""
    if len(a) > len(b):
        a, b = b, a
    return sum(max(token_similarity(x, y, slips) for y in b) for x in a) / len(a) if a else 0.0


def _parts_of(form: str) -> list[str]:
    _, given, others, family = form.split(SEPARATE)
    return [t for t in (given, *others.split(), *family.split()) if t]


def rotated(a: str, b: str) -> bool:
    """Whether one has the family name before, the other behind, with all parts written out and of equal sound."""
    x, y = ([sound(t) for t in _parts_of(f)] for f in (a, b))
    return len(x) == len(y) > 1 and min(map(len, x)) > 1 and x != y and (x[1:] + x[:1] == y or y[1:] + y[:1] == x)


@lru_cache(500_000)
def same_entity(a: str, b: str, slips: int = 1) -> bool:
    """Whether two canonical forms can name one entity: every part that both have must fit.

    ``slips`` is how many edits a name may be apart (2 for two misspellings of a third).
    """
    ka, ga, oa, fa = a.split(SEPARATE)
    kb, gb, ob, fb = b.split(SEPARATE)
    if ka != kb:
        return False
    if ka == "p" and rotated(a, b):
        return True
    fx, fy = fa.replace(" ", ""), fb.replace(" ", "")
    if not fx or not fy or (d := edits(fx, fy)) > (slips if min(len(fx), len(fy)) >= 5 else 0):
        return False
    if ka == "o":
        return oa == ob
    if not ga or not gb:
        return ga == gb and oa == ob
    if ga != gb and token_similarity(ga, gb, slips) == 0:
        return False
    xs, ys = oa.split(), ob.split()
    if xs and ys and monge_elkan(xs, ys, slips) < 0.7:
        return False
    family = 1 - d / max(len(fx), len(fy))
    return (monge_elkan([ga, *(xs if ys else [])], [gb, *(ys if xs else [])], slips) + family) / 2 >= (0.8 if slips == 1 else 0.7)


def bands(similarity: float, recall: float, rows: int) -> int:
    """The fewest bands with which a pair of that Jaccard similarity meets with that probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def _family_keys(families: list[str], heads: list[str], n_bands: int, rows: int, q: int) -> np.ndarray:
    """(families, bands): hashes of the padded q-grams of each family name, mixed with its head."""
    rng = np.random.default_rng(5)
    a = rng.integers(1, 1 << 63, n_bands * rows, dtype=np.int64).astype(np.uint64) | np.uint64(1)
    b = rng.integers(0, 1 << 63, n_bands * rows, dtype=np.int64).astype(np.uint64)
    grams, sizes = [], []
    for family in families:
        w = "#" * (q - 1) + family + "#" * (q - 1)
        g = {w[i : i + q] for i in range(len(w) - q + 1)}
        grams += [zlib.crc32(x.encode()) for x in g]
        sizes.append(len(g))
    h = np.array(grams, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    first = np.append(0, np.cumsum(sizes)[:-1])
    head = np.array([zlib.crc32(x.encode()) << 20 for x in heads], np.uint64)
    out = np.zeros((len(families), n_bands), np.uint64)
    for k in range(n_bands):
        out[:, k] = head + np.uint64(k)
        for r in range(rows):
            x = h * a[k * rows + r] + b[k * rows + r]
            low = np.minimum.reduceat(x ^ (x >> np.uint64(32)), first)
            out[:, k] = (out[:, k] ^ low) * np.uint64(0xBF58476D1CE4E5B9)
            out[:, k] ^= out[:, k] >> np.uint64(29)
    return out.view(np.int64)


def _heads(form: str) -> list[str]:
    """Kind and initial under which a form is looked up (vowels count as one initial; several where the name sounds
    otherwise or can be short for others); of an organisation its kind words."""
    kind, given, others, _ = form.split(SEPARATE)
    if kind == "o":
        return [kind + others]
    return sorted({kind + _initial(n) for n in (given, sound(given), *_names_of().get(given, ()))})


def _own_keys(form: str) -> list[str]:
    """Keys of a person's form that do not hang on the initial: the family name with what is left of the given name
    after a deletion at its beginning, and all parts whatever their order."""
    kind, given, _, family = form.split(SEPARATE)
    if kind == "o":
        return []
    left = [f"{family}/{x}" for x in (given[1:], given[0] + given[2:], given)] if len(given) > 2 else []
    parts = sorted(sound(t) for t in _parts_of(form))
    return left + ([" ".join(parts)] if len(parts) > 1 else [])


@F.pandas_udf(T.StringType())
def _parsed(names: pd.Series) -> pd.Series:
    return names.map(parse)


@F.pandas_udf(T.BooleanType())
def _close(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([same_entity(x, y) for x, y in zip(a, b)], dtype=bool)


@F.pandas_udf(T.BooleanType())
def _compatible(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([x == y or same_entity(x, y, 2) for x, y in zip(a, b)], dtype=bool)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _heard(names: pd.Series) -> pd.Series:
    """All that a given name is compared by: itself, its sound, and names that it can be short for."""
    return names.map(lambda n: sorted({n, sound(n), *_names_of().get(n, ())}))


def forms(names: DataFrame, column: str = "name") -> DataFrame:
    """Distinct ``(name, form)``; placeholders, blanks and nulls are left out."""
    rows = names.select(F.col(column).cast("string").alias("name")).distinct()
    return rows.withColumn("form", _parsed("name")).filter("form is not null")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _letters(names: pd.Series) -> pd.Series:
    """All that an initial can be to stand for a name."""
    alike = {"o": "u", "u": "o", "i": "y", "y": "i", "k": "q", "q": "k"}
    return names.map(lambda n: sorted({c for x in (n, *_names_of().get(n, ())) if x for c in (x[0], alike.get(x[0], x[0]))}))


@F.pandas_udf(T.BooleanType())
def _near_families(a: pd.Series, b: pd.Series) -> pd.Series:
    def near(x: str, y: str) -> bool:
        return edits(x, y) <= (1 if min(len(x), len(y)) >= 5 else 0)

    return pd.Series([near(x.split(SEPARATE)[1].replace(" ", ""), y.split(SEPARATE)[1].replace(" ", "")) for x, y in zip(a, b)], dtype=bool)


def _less_one(key: Column, c: Column) -> Column:
    """The key with the name, and with the name less each one letter: names an edit apart share one."""
    left = F.transform(F.sequence(F.lit(0), F.length(c)), lambda i: F.concat_ws("/", key, F.concat(F.substring(c, F.lit(1), i), F.substring(c, i + 2, F.length(c)))))
    return F.explode(F.array_distinct(left)).alias("key")


def _paired(cells: DataFrame) -> DataFrame:
    a, b = cells.select("key", F.col("form").alias("a")), cells.select("key", F.col("form").alias("b"))
    return a.join(b, "key").filter("a < b").select("a", "b")


def candidate_pairs(nodes: DataFrame, *, similarity: float = 0.38, recall: float = 0.98, rows: int = 3, q: int = 3, hot: int = 500) -> DataFrame:
    """Distinct ``(a, b)``, a < b: forms that may name one entity.

    Family names (and cores of organisations) are banded, each distinct one once under each of its heads, by as many
    bands as the collision curve asks for that ``recall`` at that ``similarity``, the one of a short family name with
    one slip; pairs that meet and are an edit apart at most stand. Within a family name and between two of a pair,
    forms with a full given name meet where it, its sound or its name is equal but for one letter, which is all that a
    slip allows; a bare initial meets all names that begin like it, as it may stand for each; forms without given names
    meet each other. So a family name with a third of all forms costs no more than its forms. Keys of more than
    ``hot`` family names are refined without loss: there those meet that are equal but for one letter.
    """
    n = bands(similarity, recall, rows)
    spread = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a name makes many keys, so small inputs are spread too

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(f, head + SEPARATE + f.split(SEPARATE)[3]) for f in batch["form"] for head in _heads(f)], columns=["form", "node"])

    def band(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                parts = [x.split(SEPARATE) for x in batch["node"]]
                keys = _family_keys([p[1] for p in parts], [p[0] for p in parts], n, rows, q)
                yield pd.DataFrame({"node": np.repeat(batch["node"].to_numpy(), n), "key": keys.ravel()})

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(f, k) for f in batch["form"] for k in _own_keys(f)], columns=["form", "key"])

    placed = materialize(nodes.select("form").repartition(spread, "form").mapInPandas(place, "form string, node string"))
    keyed = placed.select("node").distinct().repartition(spread, "node").mapInPandas(band, "node string, key long").distinct()
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    keyed = keyed.join(sizes, "key")
    text = F.col("key").cast("string")
    cells = keyed.filter(F.col("n") <= hot).select(F.col("node").alias("form"), text.alias("key")).unionByName(keyed.filter(F.col("n") > hot).select(F.col("node").alias("form"), _less_one(text, F.replace(F.split("node", SEPARATE)[1], F.lit(" "), F.lit("")))))
    families = materialize(_paired(cells).distinct().filter(_near_families("a", "b")))
    # every node with the pairs it is in, itself with itself among them
    pair = F.md5(F.concat_ws("|", "a", "b")).alias("pair")
    links = families.select(F.col("a").alias("node"), pair).unionByName(families.select(F.col("b").alias("node"), pair))
    alone = placed.select("form", F.md5(F.concat_ws("|", "node", "node")).alias("pair"))
    met = placed.join(links, "node").select("form", "pair").unionByName(alone).withColumn("given", F.split("form", SEPARATE)[1])
    size = F.length("given")
    full = met.filter(size > 1).select("form", "pair", F.explode(_heard("given")).alias("heard")).select("form", _less_one(F.col("pair"), F.col("heard")))
    none = met.filter(size == 0).select("form", F.col("pair").alias("key"))
    written = nodes.select("form").mapInPandas(own, "form string, key string")
    few = met.filter(size == 1).select(F.concat_ws("/", "pair", "given").alias("key"), F.col("form").alias("a"))
    some = met.filter(size > 0).select("pair", F.col("form").alias("b"), F.explode(_letters("given")).alias("letter")).select(F.concat_ws("/", "pair", "letter").alias("key"), "b")
    rest = few.join(some, "key").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return _paired(full.unionByName(none).unionByName(written).distinct()).unionByName(rest).distinct()


def star_clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(form, star)``: centres by falling degree, their neighbours as satellites.

    Every round takes as centres the undecided forms that come before all their undecided neighbours (by
    degree, then length and form), which gives what taking them one by one would. A satellite belongs to
    its first centre. Only the undecided part travels, and it shrinks with every round.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    degree = both.groupBy("u").agg(F.count(F.lit(1)).alias("d"))
    rank = F.struct(F.col("d"), F.length("u").alias("l"), F.col("u").alias("f"))
    ranked = degree.select("u", rank.alias("r"))
    left = materialize(both.join(ranked, "u").join(ranked.select(F.col("u").alias("v"), F.col("r").alias("rv")), "v"))
    done = nodes.select("form").join(degree.select(F.col("u").alias("form")), "form", "left_anti").select("form", F.col("form").alias("star"))
    while not left.isEmpty():
        best = left.groupBy("u").agg(F.max("rv").alias("rv"), F.max("r").alias("r"))
        centre = best.filter(F.col("r") > F.col("rv")).select(F.col("u").alias("c"))
        hit = left.join(centre, left["u"] == centre["c"]).groupBy("v").agg(F.max("r").alias("r")).select(F.col("v").alias("form"), F.col("r.f").alias("star"))
        now = materialize(centre.select(F.col("c").alias("form"), F.col("c").alias("star")).unionByName(hit))
        done = done.unionByName(now)
        out = now.select(F.col("form").alias("x"))
        rest = left.join(out, left["u"] == out["x"], "left_anti").join(out, left["v"] == out["x"], "left_anti")
        lone = left.select("u").distinct().join(out, F.col("u") == out["x"], "left_anti").join(rest.select(F.col("u").alias("w")).distinct(), F.col("u") == F.col("w"), "left_anti")
        done = done.unionByName(materialize(lone.select(F.col("u").alias("form"), F.col("u").alias("star"))))
        left = materialize(rest)
    return done


def variant_classes(names: DataFrame, column: str = "name") -> DataFrame:
    """``(name, form, star)``: one row for each distinct name that names somebody; a star is an entity.

    Case, accents, titles, the order of parts, nicknames, transliterations and usual abbreviations are
    removed by parsing; slips and initials are linked by candidate keys and verified part by part.
    """
    named = materialize(forms(names, column))
    nodes = named.select("form").distinct()
    edges = materialize(candidate_pairs(nodes).filter(_close("a", "b")))
    return named.join(star_clusters(nodes, edges), "form").select("name", "form", "star")


def variant_pairs(names: DataFrame, column: str = "name") -> DataFrame:
    """``(name_a, name_b)``, the smaller first: pairs of different names of one star that fit each other."""
    v = materialize(variant_classes(names, column))
    a = v.select("star", F.col("name").alias("name_a"), F.col("form").alias("fa"))
    b = v.select("star", F.col("name").alias("name_b"), F.col("form").alias("fb"))
    return a.join(b, "star").filter("name_a < name_b").filter(_compatible("fa", "fb")).select("name_a", "name_b")
