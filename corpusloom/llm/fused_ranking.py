"""One ranking from several differently-scaled scores, by a weighted Borda count."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import field, materialize


def _usable(c: Column) -> Column:
    c = c.cast("double")
    return F.when(~F.isnan(c), c)


def borda(df: DataFrame, scores: dict[str, float], *, group: str = "query_id", item: str = "chunk_id", hot_rows: int = 1_000_000) -> DataFrame:
    """One row ``(group, item, points, position)`` for each distinct pair of group and item.

    ``scores`` maps a column to its weight. Per score and group, the items that have it get competition
    ranks, the highest first, ties the average of their ranks; a missing score (null or NaN) gets the
    middle rank of the group. A rank r among n items is worth ``(n - r) / (n - 1)`` times the weight, so
    no score counts for more by its range. ``position`` orders by the sum of points; equal sums (rounded
    to 9 places, so that the order of addition cannot decide) by the item, ascending.

    Rows that repeat a pair are one item with the highest of each score. A null group is a group, a null
    item an item. A group of one item has 0.5 points per weight. Infinite scores rank first or last.

    Scale: one shuffle by group for the collapse, ranks are windows on the same partitioning. Groups of
    more than ``hot_rows`` rows are ranked through counts per distinct value instead, whose running sums
    go over blocks of a value range, and placed by ranges of points and item, so that no task holds such a
    group, nor all of its ties. The sizes of the groups stay a table; the driver learns only whether there is
    a hot one.
    """
    names = list(scores)
    rows = df.select(field(group).alias("_g"), field(item).alias("_i"), *[_usable(field(c)).alias(f"_s{k}") for k, c in enumerate(names)])
    hot = rows.groupBy(F.col("_g").alias("_hg")).agg(F.count(F.lit(1)).alias("_hn")).filter(F.col("_hn") > hot_rows)
    ranked = None
    if not hot.isEmpty():
        hot = materialize(hot)
        same = F.col("_g").eqNullSafe(F.col("_hg"))
        ranked = _points_hot(_collapsed(rows.join(hot, same, "left_semi"), len(names)), list(scores.values()))
        rows = rows.join(hot, same, "left_anti")
    cold = _points(_collapsed(rows, len(names), by_group=True), list(scores.values()))
    cold = cold.withColumn("_position", F.row_number().over(Window.partitionBy("_g").orderBy(F.desc("_points"), F.asc_nulls_first("_i"))).cast("long"))
    out = cold if ranked is None else cold.unionByName(ranked)
    return out.select(F.col("_g").alias(group), F.col("_i").alias(item), F.col("_points").alias("points"), F.col("_position").alias("position"))


def _collapsed(rows: DataFrame, n: int, by_group: bool = False) -> DataFrame:
    if by_group:  # the aggregation then finds its rows in place
        rows = rows.repartition("_g")
    return rows.groupBy("_g", "_i").agg(*[F.max(f"_s{k}").alias(f"_s{k}") for k in range(n)])


def _sum(parts: list[Column], weights: list[float]) -> Column:
    return F.round(reduce(lambda a, b: a + b, [p * F.lit(float(w)) for p, w in zip(parts, weights)]), 9)


def _worth(rank: Column, n: Column) -> Column:
    return F.when(n > 1, (n - rank) / (n - 1)).otherwise(F.lit(0.5))


def _points(rows: DataFrame, weights: list[float]) -> DataFrame:
    out, parts = rows, []
    n = F.count(F.lit(1)).over(Window.partitionBy("_g"))
    for k in range(len(weights)):
        s = F.col(f"_s{k}")
        rank = F.rank().over(Window.partitionBy("_g").orderBy(F.desc_nulls_last(s)))
        same = F.count(F.lit(1)).over(Window.partitionBy("_g", s))
        out = out.withColumn(f"_r{k}", F.when(s.isNull(), (n + 1) / 2).otherwise(rank + (same - 1) / 2))
        parts.append(_worth(F.col(f"_r{k}"), n))
    return out.select("_g", "_i", _sum(parts, weights).alias("_points"))


def _before(rows: DataFrame, value: str, order_desc: bool, blocks: int = 256) -> DataFrame:
    """``rows`` (``_g``, ``value``, ``_c``) with ``_b``, the sum of ``_c`` over all better rows of ``_g``.

    Blocks are ranges of the value between percentiles; only the block totals meet in one task per group.
    """
    cuts = rows.groupBy("_g").agg(F.percentile_approx(value, [i / blocks for i in range(1, blocks)], F.lit(10_000)).alias("_cuts"))
    rows = rows.withColumn("_gk", F.coalesce(F.col("_g").cast("string"), F.lit("\0")))
    cuts = cuts.select(F.coalesce(F.col("_g").cast("string"), F.lit("\0")).alias("_gk"), "_cuts")
    rows = rows.join(cuts, "_gk").withColumn("_k", F.size(F.filter("_cuts", lambda x: x < F.col(value)))).drop("_cuts")
    order = F.desc if order_desc else F.asc
    totals = rows.groupBy("_gk", "_k").agg(F.sum("_c").alias("_t"))
    totals = totals.withColumn("_o", F.coalesce(F.sum("_t").over(Window.partitionBy("_gk").orderBy(order("_k")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_t")
    rows = rows.join(totals, ["_gk", "_k"])
    inner = Window.partitionBy("_gk", "_k").orderBy(order(value)).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_b", F.col("_o") + F.coalesce(F.sum("_c").over(inner), F.lit(0))).drop("_gk", "_k", "_o")


def _points_hot(rows: DataFrame, weights: list[float]) -> DataFrame:
    rows = materialize(rows)
    total = rows.groupBy(F.col("_g").alias("_tg")).agg(F.count(F.lit(1)).alias("_n"))
    out = rows.join(total, rows["_g"].eqNullSafe(total["_tg"])).drop("_tg")
    parts = []
    for k in range(len(weights)):
        s = f"_s{k}"
        values = rows.filter(F.col(s).isNotNull()).groupBy("_g", s).agg(F.count(F.lit(1)).alias("_c"))
        values = _before(values, s, True).select(F.col("_g").alias("_vg"), F.col(s).alias("_v"), (F.col("_b") + (F.col("_c") + 1) / 2).alias(f"_r{k}"))
        out = out.join(values, out["_g"].eqNullSafe(values["_vg"]) & (out[s] == values["_v"]), "left").drop("_vg", "_v")
        parts.append(_worth(F.coalesce(F.col(f"_r{k}"), (F.col("_n") + 1) / 2), F.col("_n")))
    return _placed(out.select("_g", "_i", _sum(parts, weights).alias("_points")))


def _placed(points: DataFrame) -> DataFrame:
    """Adds ``_position``: a sort by ranges, the rows before each range, and the place in it."""
    order = [F.desc("_points"), F.asc_nulls_first("_i")]
    ranged = materialize(points.repartitionByRange("_g", *order).withColumn("_part", F.spark_partition_id()))
    size = ranged.groupBy(F.col("_g").alias("_sg"), F.col("_part").alias("_sp")).agg(F.count(F.lit(1)).alias("_c"))  # a row for each group and range
    before = F.coalesce(F.sum("_c").over(Window.partitionBy("_sg").orderBy("_sp").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    size = size.withColumn("_b", before)
    out = ranged.join(size, ranged["_g"].eqNullSafe(size["_sg"]) & (ranged["_part"] == size["_sp"]))
    nth = F.row_number().over(Window.partitionBy("_g", "_part").orderBy(*order))
    return out.select("_g", "_i", "_points", (F.col("_b") + nth).cast("long").alias("_position"))
