"""Relational breadth: joins of every kind, groupings, set operations and windows over the star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.plans.registry import query
from corpusloom.session import table


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS mean_discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(spark, sf):
    rows = table(spark, sf, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("mean_discount"), F.count(F.lit(1)).alias("n"))


@query("SELECT n_name, r_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def star_join(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return o.groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def semi_join(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders").filter("o_totalprice > 200000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("SELECT coalesce(c_nationkey, s_nationkey) AS nation, c AS customers, s AS suppliers FROM (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1) FULL JOIN (SELECT s_nationkey, count(*) AS s FROM supplier GROUP BY 1) ON c_nationkey = s_nationkey")
def full_join(spark, sf):
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("customers"))
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("suppliers"))
    return c.join(s, "nation", "full")


@query("SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def rollup_extra(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect_extra(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation")).intersect(table(spark, sf, "supplier").select("s_nationkey"))


@query("SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def except_extra(spark, sf):
    return table(spark, sf, "part").select("p_partkey").subtract(table(spark, sf, "lineitem").filter("l_quantity > 45").select("l_partkey"))


@query("SELECT o_custkey, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def top_orders(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("rn")).filter("rn <= 3")


@query("SELECT p_brand, count(DISTINCT p_type) AS types, count(DISTINCT p_size) AS sizes FROM part GROUP BY p_brand")
def distinct_extra(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand").agg(F.countDistinct("p_type").alias("types"), F.countDistinct("p_size").alias("sizes"))


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, quantile_disc(l_quantity, 0.5) AS median, true AS parts_near, true AS median_near FROM lineitem GROUP BY l_returnflag")
def approx_extra(spark, sf):
    """Sketched counts and medians, and whether they are within 10 % and 1 of the exact ones (none within none).

    The exact count has a branch of its own: in one with the others, each pair of flag and part would carry a sketch.
    The sketch of ``approx_count_distinct`` (4.6 % standard error) misses 10 % too often; this one has 1.6 %."""
    rows = table(spark, sf, "lineitem")
    near = rows.groupBy("l_returnflag").agg(F.hll_sketch_estimate(F.hll_sketch_agg("l_partkey")).alias("a"), F.percentile_approx("l_quantity", 0.5).alias("m"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY l_quantity)").alias("median"))
    exact = rows.groupBy(F.col("l_returnflag").alias("flag")).agg(F.countDistinct("l_partkey").alias("parts"))
    both = near.join(exact, F.col("l_returnflag").eqNullSafe(F.col("flag")))
    return both.select("l_returnflag", "parts", "median", (F.abs(F.col("a") - F.col("parts")) <= 0.1 * F.col("parts")).alias("parts_near"), (F.col("m").eqNullSafe(F.col("median")) | (F.abs(F.col("m") - F.col("median")) <= 1)).alias("median_near"))


@query("SELECT event_type, count(*) AS n, count(json_extract_string(props, '$.k')) AS with_k FROM events GROUP BY event_type")
def json_props(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count(F.get_json_object("props", "$.k")).alias("with_k"))
