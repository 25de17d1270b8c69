"""Row numbers over all rows of a table, by ranges of the order and prefix sums of their sizes."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintlake.session import cut

#: A row number inside a partition takes the lower bits of monotonically_increasing_id().
_ROW_BITS = 33


def global_row_number(rows: DataFrame, order: Sequence[Column | str], name: str = "row_number") -> DataFrame:
    """`rows` with `name`, their number from 1 (bigint) in `order`, worked out in many tasks.

    Rows are dealt into ranges of the order and sorted there; a row's number is its place in its range, after the sizes
    of the ranges before it. Only those sizes, one for each partition, reach the driver. Rows that tie are numbered in
    any order, but each once; a range cuts through ties only where `order` tells them apart, so an order
    that ends in a key of its own spreads best. The numbered rows are written once to the checkpoint folder, so
    all readings agree. An empty table gives an empty result.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(dealt.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", _ROW_BITS)
    sizes = sorted((r[0], r[1]) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    spark = rows.sparkSession
    starts = spark.createDataFrame(
        [(p, start) for (p, _), start in zip(sizes, accumulate((n for _, n in sizes), initial=0))],
        T.StructType([T.StructField("__p", T.LongType()), T.StructField("__start", T.LongType())]),
    )
    within = F.col("__at") - F.shiftleft(F.col("__p"), _ROW_BITS)
    numbered = placed.withColumn("__p", part).join(F.broadcast(starts), "__p")
    return numbered.withColumn(name, F.col("__start") + within + 1).drop("__p", "__at", "__start")
