from conftest import SMALL
from pyspark.sql import functions as F

from crashgrade.operators import integrate
from crashgrade.operators.joins import broadcast_limit, hot_keys, join_dimension
from crashgrade.sources.tables import table_with_row_id


def skewed(spark):
    """A third of the rows, all of them copies, share key 7; key 5000 has no match."""
    rest = spark.range(6000).select(
        "id", (F.col("id") % 997).alias("k"), F.col("id").alias("v")
    ).withColumn("k", F.when(F.col("id") == 17, F.lit(5000)).otherwise(F.col("k")))
    hot = spark.range(6000, 9000).select("id", F.lit(7).cast("bigint").alias("k"), F.lit(1).cast("bigint").alias("v"))
    return rest.unionByName(hot)


def dimension(spark):
    return spark.range(997).select(F.col("id").alias("k"), (F.col("id") * 2).alias("d"))


def rows(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=str)


def test_hot_keys_finds_the_hot_key_and_few_others(spark):
    found = [r[0] for r in hot_keys(skewed(spark), ["k"], share=0.01).collect()]
    assert found == [spark.range(1).select(F.xxhash64(F.lit(7).cast("bigint"))).first()[0]]


def test_hot_keys_finds_every_hot_key_among_many(spark):
    """Three keys with 20%, 5% and 1% of the rows in a crowd of rare ones."""
    rows = spark.range(100_000).repartition(16).select(
        F.when(F.col("id") < 20_000, -1).when(F.col("id") < 25_000, -2)
        .when(F.col("id") < 26_000, -3).otherwise(F.col("id")).alias("k")
    )
    want = {r[0] for r in spark.sql("SELECT xxhash64(k) FROM VALUES (-1L), (-2L), (-3L) AS t(k)").collect()}
    assert {r[0] for r in hot_keys(rows, ["k"], share=0.005).collect()} == want


def test_salted_join_of_no_rows(spark, no_broadcast):
    fact, dim = skewed(spark).where("id < 0"), dimension(spark)
    assert join_dimension(fact, dim, ["k"], ["id"], limit=0).count() == 0


def test_salted_join_gives_the_rows_of_a_plain_join(spark, no_broadcast):
    fact, dim = skewed(spark), dimension(spark)
    for how in ("inner", "left"):
        salted = join_dimension(fact, dim, ["k"], ["id"], how, limit=0, salts=16)
        assert rows(salted) == rows(fact.join(dim, ["k"], how))


def test_salted_join_spreads_the_hot_key(spark, no_broadcast):
    fact, dim = skewed(spark), dimension(spark)
    joined = join_dimension(fact, dim, ["k"], ["id"], limit=0, salts=16)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "salt" in plan
    shares = (
        fact.where("k = 7")
        .groupBy(F.pmod(F.xxhash64("id"), F.lit(16)))
        .count()
        .agg(F.max("count"), F.count("*"))
        .first()
    )
    assert shares[1] == 16 and shares[0] < 3 * 3000 / 16


def test_small_dimension_needs_no_salt(spark):
    joined = join_dimension(skewed(spark), dimension(spark), ["k"], ["id"])
    assert "salt" not in joined._jdf.queryExecution().optimizedPlan().toString()


def test_key_source_is_where_hot_keys_come_from(spark, no_broadcast):
    fact, dim = skewed(spark), dimension(spark)
    joined = join_dimension(
        fact, dim, ["k"], ["id"], "left", limit=0, salts=8, key_source=fact.select("k")
    )
    assert rows(joined) == rows(fact.join(dim, ["k"], "left"))


def test_row_ids_are_unique_and_stable(spark):
    first = table_with_row_id(spark, SMALL, "lineitem", "l_orderkey")
    assert first.select("row_id").distinct().count() == first.count()
    again = table_with_row_id(spark, SMALL, "lineitem", "l_orderkey")
    assert first.exceptAll(again).count() == 0


def test_broadcast_limit_reads_units(spark, no_broadcast):
    df = spark.range(1)
    for text, size in (("10MB", 10 << 20), ("1g", 1 << 30), ("-1", -1), ("2048", 2048), ("4kb", 4096)):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", text)
        assert broadcast_limit(df) == size


def test_attach_infra_fills_with_zero(spark, no_broadcast):
    facts = spark.createDataFrame([(1, 10), (2, 11), (3, 10)], "accident_id long, cell long")
    cells = spark.createDataFrame([(10, 5.0, "A")], "cell long, km double, kind string")
    for limit in (None, 0):
        got = integrate.attach_infra(facts, cells, "cell", "c_", limit=limit)
        assert sorted(map(tuple, got.collect())) == [
            (1, 10, 5.0, "A"), (2, 11, 0.0, ""), (3, 10, 5.0, "A")
        ]


def test_attach_weather_keeps_rows_without_weather(spark):
    facts = spark.sql(
        "SELECT 1L AS accident_id, timestamp_ntz'2024-01-01 10:59:59.5' AS obs_ts, 2L AS grid_id "
        "UNION ALL SELECT 2L, timestamp_ntz'2024-01-01 11:00:00', 2L"
    )
    weather = spark.sql(
        "SELECT timestamp_ntz'2024-01-01 10:00:00' AS hr, 2L AS grid_id, 21.5D AS temp_c"
    )
    got = {r["accident_id"]: r["temp_c"] for r in integrate.attach_weather(facts, weather).collect()}
    assert got == {1: 21.5, 2: None}
