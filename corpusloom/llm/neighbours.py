"""The most similar vectors of every vector: 2-stable projections indexed by a kd-tree.

Vectors of unit length are projected by Gaussian weights to a few dimensions, in which a difference of
length d has a squared length of d**2 times a chi-square variable. A kd-tree over the projections, fitted
on a bounded sample, assigns every vector to a leaf. A query first meets its home leaf, where its projected
neighbours are verified in the order of their projected distance, first a few, then all up to where by the
chi-square test none can be among the k nearest of these. What it has found there is the
distance to beat: it goes on to those leaves whose box may hold something nearer, and stops in each by the same
test. With a least similarity that is the distance to beat from the start, and one round suffices.

Whole leaves are met at once, not one after the other: a query that returned from each leaf before the next
would cost a shuffle for each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import field, materialize

DIMENSIONS = 16  # of the projection


@lru_cache(1000)
def chi_square_quantile(p: float, freedom: int) -> float:
    """By bisection of the series of the incomplete gamma function."""
    def cdf(x: float) -> float:
        a, x = freedom / 2, x / 2
        term = total = 1 / a
        n = 1
        while term > total * 1e-12:
            term *= x / (a + n)
            total += term
            n += 1
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a))

    lo, hi = 1e-9, 20.0 * freedom + 50
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


@lru_cache(64)
def _weights(size: int) -> np.ndarray:
    return np.random.default_rng(size).normal(size=(size, DIMENSIONS)).astype(np.float32)


def project(units: np.ndarray) -> np.ndarray:
    return units.astype(np.float32) @ _weights(units.shape[1])


@dataclass
class Tree:
    """Splits of a complete binary tree; leaf i of it is leaf ``first + i`` of the whole index."""

    depth: int
    axis: np.ndarray
    cut: np.ndarray
    first: int
    cells: int

    def home(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.axis[node]] > self.cut[node])
        return node - (2**self.depth - 1) + self.first

    def reached(self, x: np.ndarray, squared: np.ndarray, p: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all leaves that may hold a point within the squared distance of the row's x.

        A box is out of reach where its distance in the r axes that part it from x exceeds what r axes of a
        difference of that length do with probability ``p``.
        """
        limit = np.array([0.0, *[chi_square_quantile(p, r) for r in range(1, DIMENSIONS + 1)]])
        row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        off = np.zeros((len(x), DIMENSIONS), np.float32)
        for _ in range(self.depth):
            a = self.axis[node]
            gap = x[row, a] - self.cut[node]
            far_off = off.copy()
            far_off[np.arange(len(row)), a] = np.abs(gap)
            near, far = 2 * node + 1 + (gap > 0), 2 * node + 2 - (gap > 0)
            ok = (far_off**2).sum(axis=1) <= squared[row] * limit[(far_off > 0).sum(axis=1)]
            row, node, off = np.append(row, row[ok]), np.append(near, far[ok]), np.concatenate([off, far_off[ok]])
        return row, node - (2**self.depth - 1) + self.first


def _fit(x: np.ndarray, n: int, leaf_rows: int, first: int) -> Tree:
    """Leaves of about ``leaf_rows`` of n vectors, but none of fewer than 16 of the sample; larger leaves are
    parted by hash into cells of that size, all of which a query meets."""
    depth = max(0, math.ceil(math.log2(max(1, n / leaf_rows))))
    depth = min(depth, max(0, int(math.log2(max(1, len(x) / 16)))))
    axis, cut = np.zeros(max(1, 2**depth - 1), np.int64), np.zeros(max(1, 2**depth - 1), np.float32)
    part = {0: x}
    for node in range(2**depth - 1):
        rows = part.pop(node)
        if len(rows):
            axis[node] = rows.var(axis=0).argmax()
            cut[node] = np.median(rows[:, axis[node]])
        right = rows[:, axis[node]] > cut[node]
        part[2 * node + 1], part[2 * node + 2] = rows[~right], rows[right]
    return Tree(depth, axis, cut, first, max(1, math.ceil(n / (2**depth * leaf_rows * 1.5))))


def valid_vectors(df: DataFrame, *, key: str = "chunk_id", model: str = "model_name", vector: str = "vector", dimensions: str = "dimensions", version: str = "updated_at") -> DataFrame:
    """``(_model, _key, _version, _vector)``: all versions of the vectors of each model and key, null in place of an
    invalid one. Of each key the latest version counts, and nothing if that is invalid.

    A valid vector has as many numbers as most rows of its model state in ``dimensions`` (nulls state
    nothing, of equal counts the larger; of a model without any, as most of its vectors have), all finite,
    not all zero. Null keys and models have no vector. Of equal versions the one with the greater hash of its
    direction counts.
    """
    rows = df.select(field(model).cast("string").alias("_model"), field(key).cast("string").alias("_key"), field(vector).cast("array<float>").alias("_vector"), field(dimensions).cast("int").alias("_d"), field(version).alias("_version"))
    length = F.when(F.size("_vector") > 0, F.size("_vector"))
    said = rows.groupBy("_model", F.coalesce(F.col("_d"), length).alias("_size")).agg(F.count("_d").alias("_c"), F.count(F.lit(1)).alias("_n")).filter("_size is not null")
    sizes = said.groupBy("_model").agg(F.max(F.struct("_c", "_n", "_size")).alias("_m")).select(F.col("_model").alias("_sm"), F.col("_m._size").alias("_size"))
    finite = F.forall("_vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = (F.size("_vector") == F.col("_size")) & finite & F.exists("_vector", lambda x: x != 0)
    # a row for each embedding model, so that the vectors need not be brought together by model
    all_rows = rows.filter("_key is not null and _model is not null").join(F.broadcast(sizes), F.col("_model") == F.col("_sm"), "left")
    return all_rows.select("_model", "_key", "_version", F.when(good, F.col("_vector")).alias("_vector"))


def _units(vectors: DataFrame) -> DataFrame:
    """(_model, _key, _version, _class, _unit): unit vectors, and a hash that equals for equal directions; both null
    where there is no vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            there = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
            classes, units = np.zeros(len(lists), np.int64), np.full(len(lists), None, object)
            some = lists.take(pa.array(there))
            sizes = np.diff(some.offsets.to_numpy()) if len(some) else np.zeros(0, int)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                v = some.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
                v /= np.abs(v).max(axis=1, keepdims=True)
                v /= np.linalg.norm(v, axis=1, keepdims=True)
                coarse = np.round(v * 16384).astype(np.int64).view(np.uint64)
                salt = np.random.default_rng(int(size)).integers(1, 1 << 63, int(size)).astype(np.uint64) | np.uint64(1)
                h = (coarse * salt).sum(axis=1, dtype=np.uint64)
                h ^= h >> np.uint64(31)
                classes[there[at]] = h.view(np.int64)
                for i, r in zip(there[at], v.astype(np.float32)):
                    units[i] = r.tobytes()
            gone = ~lists.is_valid().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(classes, mask=gone), pa.array(units, pa.binary())], names=["_model", "_key", "_version", "_class", "_unit"])

    kind = vectors.schema["_version"].dataType.simpleString()
    return vectors.select("_model", "_key", "_version", "_vector").mapInArrow(run, f"_model string, _key string, _version {kind}, _class long, _unit binary")


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _search(points: DataFrame, queries: DataFrame, trees: dict[str | None, Tree], k: int, p: float, reach: str) -> DataFrame:
    """(_model, _q, _p, _cos): of every leaf that a query reaches, its k most similar there.

    ``queries`` has ``_squared``, the squared distance to be beaten; ``reach`` is "home", "all", "away"
    (all but home) or "after" (home and the leaves after it). With "after", where every point is a query,
    a pair of leaves is visited once and its finds count for both sides. Points and queries of a cell meet in a
    sorted stream, so that a task holds the points of one cell and one batch of queries, however many there are.
    A point travels once; a query, once for each leaf in reach, in 16 bits a number (similarities are off by
    about 0.00001).
    """
    threshold = chi_square_quantile(p, DIMENSIONS)
    most = max(t.cells for t in trees.values())

    def place(is_query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                names = b.column(0).to_pylist()
                for name in set(names):
                    at = np.array([i for i, x in enumerate(names) if x == name])
                    for part in np.array_split(at, -(-len(at) // 4096)):
                        rows = b.take(pa.array(part))
                        x = _matrix(rows.column(2), np.float32)
                        tree, proj = trees[name], project(x)
                        bound = rows.column(3).to_numpy() if is_query else np.zeros(len(x))
                        home = leaf = tree.home(proj)
                        row = np.arange(len(x))
                        if is_query:
                            if reach != "home":
                                row, leaf = tree.reached(proj, bound, max(p, 0.995))
                                if reach != "all":
                                    keep = leaf != home[row] if reach == "away" else leaf >= home[row]
                                    row, leaf = row[keep], leaf[keep]
                            cell = np.tile(np.arange(tree.cells), len(row))
                            row, leaf = np.repeat(row, tree.cells), np.repeat(leaf, tree.cells)
                        else:
                            cell = rows.column(1).to_numpy() % tree.cells
                        at_row = pa.array(row)
                        small = pa.array([r.tobytes() for r in (np.round(x * 32767).astype(np.int16) if is_query else x)], pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(name, pa.string()), len(row)), pa.array(leaf * most + cell, pa.int64()), pa.array(np.full(len(row), is_query)), rows.column(1).take(at_row), small.take(at_row), pa.array(bound[row].astype(np.float32)), pa.array(leaf == home[row])], names=["_model", "_leaf", "_query", "_class", "_unit", "_squared", "_own"])

        return run

    shape = "_model string, _leaf long, _query boolean, _class long, _unit binary, _squared float, _own boolean"
    both = points.select("_model", "_class", "_unit").mapInArrow(place(False), shape).unionByName(queries.select("_model", "_class", "_unit", "_squared").mapInArrow(place(True), shape))
    n_cells = sum(2**t.depth * t.cells for t in trees.values())
    met = both.repartition(max(1, min(n_cells, 4096)), "_leaf").sortWithinPartitions("_leaf", "_query")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf, held, ids, unit, proj = None, [], None, None, None
        for b in batches:
            leaves, asks = b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.append(True, (leaves[1:] != leaves[:-1]) | (asks[1:] != asks[:-1]))) if len(leaves) else []
            for i, j in zip(edges, np.append(edges[1:], len(leaves))):
                part = b.slice(i, j - i)
                if leaves[i] != leaf:
                    leaf, held, unit = leaves[i], [], None
                if not asks[i]:
                    held.append((part.column(3).to_numpy(), _matrix(part.column(4), np.float32)))
                    continue
                if not held:
                    continue
                if unit is None:
                    ids, unit = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                    held = [held[0]]
                    proj = project(unit)  # with half of the squared length, so that one product gives the distance
                    proj = np.ascontiguousarray(np.hstack([proj, -(proj**2).sum(axis=1, keepdims=True) / 2]).T)
                name = part.column(0)[0].as_py()
                for s in range(0, len(part), 128):
                    some = part.slice(s, 128)
                    asked = some.column(3).to_numpy(), _matrix(some.column(4), np.int16).astype(np.float32) / np.float32(32767), some.column(5).to_numpy()
                    if reach == "after":
                        found = _within(*asked, ids, unit, proj, k, threshold, some.column(6).to_numpy(zero_copy_only=False))
                    else:
                        found = _incremental(*asked, ids, unit, proj, k, threshold)
                    if len(found[0]):
                        yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(name, pa.string()), len(found[0])), *map(pa.array, found)], names=["_model", "_q", "_p", "_cos"])

    return met.mapInArrow(verify, "_model string, _q long, _p long, _cos double")


def _true(q: np.ndarray, unit: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The similarities of rows r of q and rows c of unit."""
    return np.concatenate([np.einsum("ij,ij->i", q[r[s : s + 65536]], unit[c[s : s + 65536]]) for s in range(0, len(r), 65536)]) if len(r) else np.zeros(0, np.float32)


def _within(q_ids: np.ndarray, q: np.ndarray, squared: np.ndarray, ids: np.ndarray, unit: np.ndarray, proj: np.ndarray, k: int, threshold: float, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All within the distance, the best k of each query and of each point met from another leaf."""
    qp = project(q)
    least = ((qp**2).sum(axis=1) - squared * threshold) / 2
    near = np.hstack([qp, np.ones((len(qp), 1), np.float32)]) @ proj >= least[:, None].astype(np.float32)
    r, c = np.divmod(np.flatnonzero(near), near.shape[1])
    cos = (q @ unit.T)[r, c] if len(r) * 4 > near.size else _true(q, unit, r, c)
    keep = (cos >= 1 - squared[r] / 2 - 1e-4) & (q_ids[r] != ids[c])
    r, c, cos = r[keep], c[keep], cos[keep]
    a, b, score = _top(q_ids[r], ids[c], cos, k)
    abroad = ~own[r]  # the points found by queries from another leaf have found these in turn
    back = _top(ids[c[abroad]], q_ids[r[abroad]], cos[abroad], k)
    a, b, score = (np.append(x, y) for x, y in zip((a, b, score), back))
    return a, b, score.astype(np.float64)


def _incremental(q_ids: np.ndarray, q: np.ndarray, squared: np.ndarray, ids: np.ndarray, unit: np.ndarray, proj: np.ndarray, k: int, threshold: float, first: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best k of each query: the ``first`` neighbours by projected distance are verified, then by the k-th best
    of these, or the distance to beat, all others that the chi-square test allows for it; it allows no more."""
    qp = project(q)
    far = (qp**2).sum(axis=1, keepdims=True) - 2 * (np.hstack([qp, np.ones((len(qp), 1), np.float32)]) @ proj)  # squared projected distances
    n = far.shape[1]
    bound = np.minimum(squared, 4.0)
    some = np.argpartition(far, first, axis=1)[:, :first] if first < n else np.broadcast_to(np.arange(n), far.shape)
    r, c = np.repeat(np.arange(len(q)), some.shape[1]), some.ravel()
    cos = _true(q, unit, r, c)
    other = q_ids[r] != ids[c]
    sq = np.where(other, np.maximum(2 - 2 * cos, 0), 4.0).reshape(some.shape)
    if some.shape[1] >= k:
        bound = np.minimum(bound, np.partition(sq, k - 1, axis=1)[:, k - 1])
    near = far <= (threshold * bound)[:, None]
    near[r, c] = False
    r2, c2 = np.divmod(np.flatnonzero(near), n)
    cos2 = (q @ unit.T)[r2, c2] if len(r2) * 4 > near.size else _true(q, unit, r2, c2)
    r, c, cos = np.append(r, r2), np.append(c, c2), np.append(cos, cos2)
    keep = (q_ids[r] != ids[c]) & (cos >= 1 - np.minimum(squared, bound)[r] / 2 - 1e-4)
    r, c, cos = r[keep], c[keep], cos[keep]
    a, b, score = _top(q_ids[r], ids[c], cos, k)
    return a, b, score.astype(np.float64)


def _top(of: np.ndarray, other: np.ndarray, cos: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((other, -cos, of))
    of, other, cos = of[order], other[order], cos[order]
    top = np.arange(len(of)) - np.searchsorted(of, of) < k
    return of[top], other[top], cos[top]


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("_model", "_q").orderBy(F.desc("_cos"), "_p")
    return found.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k)


def class_neighbours(classes: DataFrame, *, k: int = 5, min_cosine: float | None = None, queries: DataFrame | None = None, p: float = 0.99, leaf_rows: int = 16_384, sample_rows: int = 20_000) -> DataFrame:
    """(_model, _q, _p, _cos, _rank): the k most similar other classes of each class of directions.

    ``classes`` has (_model, _class, _unit) and must be cheap to read again. With ``min_cosine`` only pairs at
    least that similar count, and one round with that distance suffices. Without it a first round in the
    home leaf gives each query the distance to beat. ``p`` is the probability of the chi-square test that a
    neighbour at the distance to beat is not missed; nearer ones are missed less. The tree is fitted on at
    most about ``sample_rows`` vectors of each model; every vector is indexed.
    """
    counts = {r[0]: r[1] for r in classes.groupBy("_model").count().collect()}  # a row per embedding model
    trees, first = {}, 0
    for name, n in sorted(counts.items(), key=lambda x: str(x[0])):
        share = F.pmod(F.xxhash64("_class"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, sample_rows / n))
        got = classes.filter(F.col("_model").eqNullSafe(F.lit(name)) & share).select("_unit").toArrow().column(0).combine_chunks()
        x = project(_matrix(got, np.float32)) if len(got) else np.zeros((0, DIMENSIONS), np.float32)
        trees[name] = _fit(x, n, leaf_rows, first)
        first += 2 ** trees[name].depth
    if not trees:
        return classes.sparkSession.createDataFrame([], "_model string, _q long, _p long, _cos double, _rank int")
    asked = classes if queries is None else queries
    if min_cosine is not None:
        found = _search(classes, asked.withColumn("_squared", F.lit(2 - 2 * min_cosine)), trees, k, p, "after" if queries is None else "all")
        return _best(found, k)
    near = materialize(_best(_search(classes, asked.withColumn("_squared", F.lit(4.0)), trees, k, p, "home"), k))
    beat = near.groupBy("_model", "_q").agg(F.count(F.lit(1)).alias("_n"), F.min("_cos").alias("_worst"))
    at = asked.join(beat, asked["_model"].eqNullSafe(beat["_model"]) & (asked["_class"] == beat["_q"]), "left")
    squared = F.when(F.col("_n") >= k, F.greatest(2 - 2 * F.col("_worst"), F.lit(1e-4))).otherwise(F.lit(4.0))
    asked = at.select(asked["_model"], "_class", "_unit", squared.alias("_squared"))
    return _best(near.drop("_rank").unionByName(_search(classes, asked, trees, k, p, "away")), k)


def _few(df: DataFrame, most: int = 100_000) -> DataFrame:
    """A stored frame, to be sent to all if it has at most so many rows, so that what it is joined with stays where
    it is; a larger one is joined as Spark sees fit."""
    stored = materialize(df)
    return F.broadcast(stored) if stored.count() <= most else stored


def _prepared(vectors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members (_model, _class, _key) of all classes of directions, classes (_model, _class, _unit) and the members
    of those of several (_model, _class, _key, _n). Only keys travel, to find older versions and copies."""
    units = materialize(_units(vectors).withColumn("_row", F.monotonically_increasing_id()))  # the ids are fixed with it
    last = F.max(F.struct("_version", "_class", "_row")).alias("_m")
    again = _few(units.groupBy("_model", "_key").agg(F.count(F.lit(1)).alias("_c"), last).filter("_c > 1").select("_model", "_key", F.col("_m._row").alias("_last")))
    now = units.join(again, ["_model", "_key"], "left").filter("(_last is null or _row = _last) and _class is not null").select("_model", "_key", "_class", "_unit", "_row")
    members = now.select("_model", "_class", "_key")
    copies = now.groupBy("_model", "_class").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("_key", "_row")).alias("_m")).filter("_n > 1").select("_model", "_class", "_n", F.col("_m._row").alias("_first"))
    copies = _few(copies)
    shared = members.join(copies, ["_model", "_class"]).select("_model", "_class", "_key", "_n")
    classes = now.join(copies, ["_model", "_class"], "left").filter("_first is null or _row = _first").select("_model", "_class", "_unit")
    return members, classes, shared


def neighbours(vectors: DataFrame, *, k: int = 5, min_cosine: float | None = None, queries: DataFrame | None = None, p: float = 0.99, bucket: int = 10_000) -> DataFrame:
    """(_model, _key, _other, _cos): for each key of a model its k most similar other keys of the model.

    ``vectors`` is what ``valid_vectors`` gives; ``queries`` (_model, _key) restricts who is asked for, not
    who is found. Keys of one direction form a class with similarity 1; each gets all the others of a class of up
    to k + 1, and k of a larger one, which are all as near: those next to it in the order of keys (within blocks of
    about ``bucket`` keys). Ties between classes go to the smaller class hash, then key.
    """
    members, classes, shared = _prepared(vectors)
    several = shared.select("_model", "_class", "_n").distinct()
    asked_members = members if queries is None else members.join(queries.distinct(), ["_model", "_key"], "left_semi")
    asked = None if queries is None else classes.join(asked_members.select("_model", "_class").distinct(), ["_model", "_class"], "left_semi").select("_model", "_class", "_unit")
    found = class_neighbours(classes, k=k, min_cosine=min_cosine, queries=asked, p=p)
    if min_cosine is not None:
        found = found.filter(F.col("_cos") >= min_cosine)
    # other classes: as many members as the query's own class leaves room for
    q = several.select("_model", F.col("_class").alias("_q"), F.col("_n").alias("_qn"))
    o = several.select("_model", F.col("_class").alias("_p"), F.col("_n").alias("_pn"))
    sized = found.join(q, ["_model", "_q"], "left").join(o, ["_model", "_p"], "left").fillna(1, ["_qn", "_pn"])
    before = F.coalesce(F.sum("_pn").over(Window.partitionBy("_model", "_q").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = _few(sized.withColumn("_room", k - (F.col("_qn") - 1) - before).filter("_room > 0").select("_model", "_q", "_p", "_cos", "_room"))
    # the first members of the classes found; of a class of one, which most are, its only one
    w = Window.partitionBy("_model", "_p").orderBy("_other")
    wanted = _few(room.select("_model", "_p").distinct())
    first = members.select("_model", F.col("_class").alias("_p"), F.col("_key").alias("_other")).join(wanted, ["_model", "_p"], "left_semi").withColumn("_at", F.row_number().over(w)).filter(F.col("_at") <= k)
    away = _few(first).join(room, ["_model", "_p"]).filter(F.col("_at") <= F.col("_room"))
    away = asked_members.select("_model", F.col("_class").alias("_q"), "_key").join(_few(away.select("_model", "_q", "_other", "_cos")), ["_model", "_q"]).select("_model", "_key", "_other", "_cos")
    # the own class
    own = shared.withColumn("_b", F.pmod(F.xxhash64("_key"), F.ceil(F.col("_n") / bucket)))
    w = Window.partitionBy("_model", "_class", "_b").orderBy("_key")
    near = F.slice(F.array_compact(F.array(*[F.lead("_key", i).over(w) for i in range(1, k + 1)], *[F.lag("_key", i).over(w) for i in range(1, k + 1)])), 1, k)
    near = own.withColumn("_near", near).select("_model", "_key", F.explode("_near").alias("_other"))
    if queries is not None:
        near = near.join(queries.distinct(), ["_model", "_key"], "left_semi")
    return away.unionByName(near.withColumn("_cos", F.lit(1.0)))
