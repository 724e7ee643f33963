"""The star-schema queries on rows that the test tables lack."""

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom.plans import catalogue
from tests.compare import plain

#: Of the 20,000 parts from here approx_count_distinct counts 12 % too many.
START = 3_880_000


@pytest.fixture(scope="module")
def lineitem(spark, tmp_path_factory):
    """20,000 consecutive parts of one flag, rows without a flag, a flag without quantities, one without parts."""
    folder = tmp_path_factory.mktemp("relational")
    part, quantity = F.col("id"), (F.col("id") % 50 + 1).cast("double")
    many = spark.range(START, START + 20_000).select(part.alias("l_partkey"), quantity.alias("l_quantity"), F.lit("A").alias("l_returnflag"))
    few = spark.range(20).select(part.alias("l_partkey"), quantity.alias("l_quantity"))
    no_flag, none = few.withColumn("l_returnflag", F.lit(None).cast("string")), F.lit(None)
    no_quantity = few.select("l_partkey", none.cast("double").alias("l_quantity"), F.lit("N").alias("l_returnflag"))
    no_part = few.select(none.cast("long").alias("l_partkey"), "l_quantity", F.lit("R").alias("l_returnflag"))
    many.unionByName(no_flag).unionByName(no_quantity).unionByName(no_part).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_approx_extra_on_many_parts_and_nulls(spark, lineitem):
    got = catalogue.queries()["approx_extra"](spark, lineitem).toPandas()
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{lineitem}/lineitem.parquet/*.parquet'")
    want = con.execute(catalogue.oracle_sql()["approx_extra"]).df()
    assert sorted(want.columns) == sorted(got.columns)
    assert plain(got) == plain(want)


def test_approx_extra_keeps_no_sketch_for_each_part(spark, lineitem):
    plan = catalogue.queries()["approx_extra"](spark, lineitem)._jdf.queryExecution().executedPlan().toString()
    by_part = [line for line in plan.splitlines() if "Aggregate(keys=[" in line and "l_partkey" in line.split("keys=[")[1].split("]")[0]]
    assert by_part
    assert not [line for line in by_part if "functions=[]" not in line]
