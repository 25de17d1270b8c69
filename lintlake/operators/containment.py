"""Points in intervals by one ordered pass: no pair is looked at that is not a result.

Intervals are open at both ends: a point on an edge is outside. Both functions sort the events of a key (a file, a
member) once in a window, so their cost is that of sorting, and of the rows they return.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_around(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str, name: str) -> DataFrame:
    """`points` that lie in an interval of their keys, with `name`: a struct of the first one by start, whatever overlaps what.

    Of the intervals in order of start only those count that reach beyond all before them; their ends ascend, so
    the first one around a point is the next such end after it, if it starts before the point.
    """
    cols = [c for c in intervals.columns if c not in keys]
    whole = F.struct(*cols)
    before = Window.partitionBy(*keys).orderBy(start, F.desc(end)).rowsBetween(Window.unboundedPreceding, -1)
    reaching = intervals.withColumn("__far", F.max(end).over(before)).filter(F.col("__far").isNull() | (F.col(end) > F.col("__far")))
    own = [c for c in points.columns if c not in keys]
    none_i, none_p = F.lit(None).cast(intervals.select(whole.alias("x")).schema["x"].dataType), F.lit(None).cast(points.select(F.struct(*own).alias("x")).schema["x"].dataType)
    ends = reaching.select(*keys, F.col(end).cast("long").alias("__pos"), F.lit(0).alias("__turn"), whole.alias("__i"), none_p.alias("__p"))
    asks = points.select(*keys, F.col(at).cast("long").alias("__pos"), F.lit(1).alias("__turn"), none_i.alias("__i"), F.struct(*own).alias("__p"))
    # read backwards, as a frame that begins at the current row would be worked out anew for each row
    down = Window.partitionBy(*keys).orderBy(F.desc("__pos"), F.desc("__turn")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = ends.unionByName(asks).withColumn(name, F.last("__i", ignorenulls=True).over(down)).filter("__turn = 1")
    return found.filter(F.col(name)[start] < F.col("__pos")).select(*keys, *[F.col("__p")[c].alias(c) for c in own], name)


def all_around(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str, name: str) -> DataFrame:
    """`points` once for each interval of their keys that they lie in, with `name`, its struct; intervals nest, or lie apart.

    A running count of openings less closings is the depth at each point; at each level up to that depth the last
    interval opened on that level is around it.
    """
    cols = [c for c in intervals.columns if c not in keys]
    own = [c for c in points.columns if c not in keys]
    whole, point = F.struct(*cols), F.struct(*own)
    none_i, none_p = F.lit(None).cast(intervals.select(whole.alias("x")).schema["x"].dataType), F.lit(None).cast(points.select(point.alias("x")).schema["x"].dataType)

    def events(df: DataFrame, pos: str, turn: int, step: int, i: Column, p: Column, size: Column) -> DataFrame:
        return df.select(*keys, F.col(pos).cast("long").alias("__pos"), F.lit(turn).alias("__turn"), F.lit(step).alias("__step"), size.alias("__size"), i.alias("__i"), p.alias("__p"))

    # at one place intervals close first, then come points, then intervals open, the longer one first
    real = intervals.filter(F.col(start) < F.col(end))
    size = (F.col(start) - F.col(end)).cast("long")
    rows = events(real, end, 0, -1, none_i, none_p, size).unionByName(events(points, at, 1, 0, none_i, point, F.lit(0).cast("long"))).unionByName(events(real, start, 2, 1, whole, none_p, size))
    order = Window.partitionBy(*keys).orderBy("__pos", "__turn", "__size")
    deep = rows.withColumn("__depth", F.sum("__step").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    levels = F.when(F.col("__turn") == 2, F.array("__depth")).otherwise(F.sequence(F.lit(1).cast("long"), "__depth"))
    each = deep.filter((F.col("__turn") > 0) & (F.col("__depth") > 0)).withColumn("__level", F.explode(levels))
    up_to = Window.partitionBy(*keys, "__level").orderBy("__pos", "__turn", "__size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = each.withColumn(name, F.last("__i", ignorenulls=True).over(up_to)).filter("__turn = 1")
    return found.select(*keys, *[F.col("__p")[c].alias(c) for c in own], name)
