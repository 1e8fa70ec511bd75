from tidemark.catalog.views import Views


def test_quarters_take_tasks_by_line_items(spark, tmp_path):
    """Shuffled quarters are a few bytes, yet each becomes a wide row in the same stage."""
    spark.range(40).selectExpr(
        "id AS l_orderkey", "id AS l_partkey", "id % 5 AS l_suppkey", "CAST(id AS INT) AS l_linenumber", "1.0D AS l_quantity", "10.0D AS l_extendedprice", "0.1D AS l_discount",
        "0.1D AS l_tax", "'A' AS l_returnflag", "'F' AS l_linestatus", "add_months(timestamp '1996-01-05', CAST(3 * (id DIV 5) AS INT)) AS l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(5).selectExpr("id AS s_suppkey", "CAST(0 AS INT) AS s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(1).selectExpr("CAST(0 AS INT) AS n_nationkey", "CAST(0 AS INT) AS n_regionkey").write.parquet(f"{tmp_path}/nation.parquet")
    views = Views(spark, str(tmp_path))
    assert views.dealt(spark.range(40), "id", per_task=4).rdd.getNumPartitions() == 10
    obs = views.obs()
    assert obs.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert obs.count() == 240
