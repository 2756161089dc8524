from treeline.llm.fitting import bounded_sample, fitted


def test_sample_is_bounded_and_repeatable(spark):
    table = spark.range(50_000).withColumnRenamed("id", "k")
    a = sorted(r.k for r in bounded_sample(table, 300, "k").collect())
    b = sorted(r.k for r in bounded_sample(table.repartition(13), 300, "k").collect())
    assert a == b and len(a) == 300
    # from everywhere
    assert a[0] < 2000 and a[-1] > 48_000
    assert bounded_sample(table.limit(20), 300, "k").count() == 20
    assert bounded_sample(table.limit(0), 300, "k").count() == 0


def test_fit_sees_all_rows_in_order(spark):
    table = spark.range(100).selectExpr("99 - id AS k", "cast(id AS string) AS t")
    assert fitted(table, lambda rows: [k for k, _ in rows]) == list(range(100))
    assert fitted(table.limit(0), len) == 0
