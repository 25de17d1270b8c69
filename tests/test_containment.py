"""Points in intervals against double loops, and many of both in one key."""

import random
import time

from pyspark.sql import functions as F

from lintlake.operators.containment import all_around, first_around
from lintlake.plans import rules_java as rj

POINT, RANGE = "k string, p int, x string", "k string, a int, b int, y int"


def test_first_of_any_intervals(spark):
    rng = random.Random(7)
    points = [(rng.choice("uvw"), rng.randint(0, 40), f"p{n}") for n in range(300)]
    ranges = [(rng.choice("uvz"), a, a + rng.randint(-1, 25), n) for n, a in enumerate(rng.choices(range(40), k=60))]
    got = first_around(spark.createDataFrame(points, POINT), spark.createDataFrame(ranges, RANGE), ["k"], "p", "a", "b", "r").collect()
    want = {}
    for k, p, x in points:
        if around := [(a, -b) for kk, a, b, _ in ranges if kk == k and a < p < b]:
            want[k, p, x] = min(around)[0]
    assert {(r.k, r.p, r.x): r.r.a for r in got} == want and len(got) == len(want)


def test_all_of_nested_intervals(spark):
    rng = random.Random(8)
    ranges = []

    def fill(key, lo, hi, deep):
        while lo < hi and deep < 5:
            a = min(lo + rng.randint(0, 2), hi)
            b = rng.randint(a, hi)
            ranges.append((key, a, b, len(ranges)))
            if b > a:
                fill(key, a, b, deep + 1)
            lo = b + rng.randint(0, 3)

    for key in "uv":
        fill(key, 0, 60, 0)
    points = [(rng.choice("uvw"), rng.randint(0, 60), f"p{n}") for n in range(300)]
    got = all_around(spark.createDataFrame(points, POINT), spark.createDataFrame(ranges, RANGE), ["k"], "p", "a", "b", "r").collect()
    want = sorted((x, y) for k, p, x in points for kk, a, b, y in ranges if kk == k and a < p < b)
    assert sorted((r.x, r.r.y) for r in got) == want and len(want) > 100


def test_many_calls_and_loops_of_one_member(spark):
    """20,000 loops one after the other and 60,000 calls: a product would be 1.2 billion pairs."""
    n = 20_000
    loops = spark.range(n).select(F.lit("A").alias("path"), F.lit(0).alias("member_ix"), F.lit("for").alias("kind"), (F.col("id") * 10).cast("int").alias("start"), (F.col("id") * 10 + 6).cast("int").alias("end"), F.lit(1).alias("line"))
    calls = spark.range(3 * n).select(F.lit("A").alias("path"), F.lit(0).alias("member_ix"), F.lit(0).alias("type_ix"), ((F.col("id") * 10 / 3).cast("int") + 1).alias("off"), F.lit("c").alias("callee"), F.lit(1).alias("line"), F.array().cast("array<string>").alias("receiver"))
    began = time.time()
    got = rj.calls_in_loops(rj.Java(None, None, None, calls, loops, None))
    inside = calls.filter("off % 10 between 1 and 5").count()
    assert got.count() == inside and time.time() - began < 60
    assert got.filter("loop != 'for'").count() == 0
