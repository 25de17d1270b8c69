"""Row numbers over all rows against sorting in one place."""

from pyspark.sql import functions as F

from lintlake.operators.ranking import global_row_number


def test_numbers_follow_the_order(spark):
    rows = spark.range(20_000).select((F.xxhash64("id") % 300).alias("k"), "id")
    got = [(r.k, r.id) for r in global_row_number(rows, [F.col("k").desc(), "id"], "n").orderBy("n").collect()]
    assert got == sorted(got, key=lambda r: (-r[0], r[1]))
    numbers = [r.n for r in global_row_number(rows, ["k"], "n").select("n").collect()]
    assert sorted(numbers) == list(range(1, 20_001))


def test_ties_nulls_and_nothing(spark):
    rows = spark.createDataFrame([(None,), (2,), (None,), (2,), (1,)], "k int")
    got = sorted((r.row_number, r.k) for r in global_row_number(rows, [F.col("k").asc_nulls_last()]).collect())
    assert [k for _, k in got] == [1, 2, 2, None, None]
    assert global_row_number(rows.limit(0), ["k"]).count() == 0


def test_no_task_sees_all_rows(spark):
    numbered = global_row_number(spark.range(1000), ["id"])
    assert "SinglePartition" not in numbered._jdf.queryExecution().toString()
