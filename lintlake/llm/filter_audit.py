"""Audit of how filters interact, over all orders of applying them, by a recursive CTE.

Each document has a mask: the bits of the filters that it fails. The corpus is first added up to cells (part, mask), at
most 2^filters a part. A recursive CTE then extends filter prefixes by unused letters: it starts from the masks that
exist, carries the bits applied so far, and each level emits what its step does to every mask. The levels hold
at most (sum of k-permutations) x 2^filters rows, whatever the corpus (10,400 for five filters), so they are broadcast
to the cells, and a step's counts are sums over its part's cells.

The five filters of `text_filters`: A fewer than 200 words; B distinct words under half of the words; C more than 3
percent capitals A-Z of the code points; D any of #$%&*|; E the text is also that of a smaller id, whether that one
is kept or not. Words are runs other than ASCII white space, told apart by case.

A null text counts as empty; a null part as an empty string. A null id has no smaller one, so it never fails E, and has
no label. Rows are counted one by one, also where id and text repeat: of equal texts all rows of the least id pass E.
Several labels of an id count together: a document is good (toxic) if one of them says so. Only the named columns are
read. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm.common import stored, table

SPACE = r"[\x20\x09-\x0D]+"
LETTERS = "ABCDE"
MOST_FILTERS = 8
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_filters(text: Column) -> list[Column]:
    """Whether filters A, B, C and D fail, from a text alone."""
    words = F.array_remove(F.split(text, SPACE), "")
    n, points = F.size(words), F.length(text)
    return [
        n < 200,
        100 * F.size(F.array_distinct(words)) < 50 * n,
        100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 3 * points,
        text.rlike(r"[#$%&*|]"),
    ]


def _bits(failed: Sequence[Column], first: int = 0) -> Column:
    total = F.lit(0)
    for k, f in enumerate(failed, first):
        total = total + F.when(f, 1 << k).otherwise(0)
    return total


def masks(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang", label_id: str = "doc_id", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """(doc_id, part, mask, good, toxic) of every row; the last bit is that of a repeated text.

    Texts are read once and travel as digests. The first of equal texts is found by digest with partial sums, and
    brought back by id and digest, so a text that a third of all rows share is no hot key.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    own = text_filters(body)
    read = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(body, 256)).alias("digest"), _bits(own).alias("own"))
    read = stored(read, "filter-marks")
    firsts = read.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = labels.select(F.col(label_id).alias("doc_id"), (F.col(quality) == 1).alias("good"), (F.col(toxic) == 1).alias("toxic")).filter("doc_id is not null")
    known = known.groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    named = read.filter("doc_id is not null").join(known, "doc_id", "left").join(firsts, ["doc_id", "digest"], "left")
    nameless = read.filter("doc_id is null").withColumns({"good": F.lit(False), "toxic": F.lit(False), "first": F.lit(True)})
    repeated = F.col("first").isNull()
    no = F.lit(False)
    return named.unionByName(nameless).select("doc_id", "part", (F.col("own") + _bits([repeated], len(own))).alias("mask"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))


def cells(marked: DataFrame) -> DataFrame:
    """(part, mask, docs, good, toxic): documents by part and mask; tasks add up before anything is shuffled."""
    return marked.groupBy("part", "mask").agg(F.count("*").alias("docs"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


_STEPS = """
WITH RECURSIVE steps (filter_order, applied, step, letter, mask, kept, removed, redundant, unique_fails) AS (
  SELECT '', 0, 0, '', mask, 0, 0, 0, 0 FROM {found}
  UNION ALL
  SELECT concat(s.filter_order, u.letter), u.after, s.step + 1, u.letter, s.mask,
    CASE WHEN s.mask & u.after = 0 THEN 1 ELSE 0 END,
    CASE WHEN s.mask & s.applied = 0 AND s.mask & u.bit > 0 THEN 1 ELSE 0 END,
    CASE WHEN s.mask & s.applied > 0 AND s.mask & u.bit > 0 THEN 1 ELSE 0 END,
    CASE WHEN s.mask = u.bit THEN 1 ELSE 0 END
  FROM steps s JOIN {unused} u ON s.applied = u.applied
)
SELECT * FROM steps WHERE step > 0
"""


def prefixes(spark: SparkSession, found: DataFrame, letters: str = LETTERS) -> DataFrame:
    """What each step of each filter prefix does to each of the masks found: 0 or 1 as kept, removed, redundant, unique_fails."""
    n = len(letters)
    if n > MOST_FILTERS or len(set(letters)) != n:
        raise ValueError(f"up to {MOST_FILTERS} filters, each with a letter of its own")
    unused = [(a, x, 1 << k, a | 1 << k) for a in range(1 << n) for k, x in enumerate(letters) if not a >> k & 1]
    unused = spark.createDataFrame(unused, "applied int, letter string, bit int, after int")
    most = sum(len(list(itertools.permutations(letters, k))) for k in range(n + 1)) << n
    name = "spark.sql.cteRecursionRowLimit"
    if most > int(spark.conf.get(name)):
        spark.conf.set(name, str(most))
    return spark.sql(_STEPS, found=found, unused=unused)


def orders(cell: DataFrame, letters: str = LETTERS) -> DataFrame:
    """(part, filter_order, step, counts, shapley) for each part, all orders and steps, from cells.

    shapley: what the step's filter removes, summed over all orders, at whatever step.
    """
    spark = cell.sparkSession
    cell = stored(cell, "filter-cells")
    steps = stored(prefixes(spark, cell.select("mask").distinct(), letters), "filter-steps")
    flag = {c: F.col(c) for c in ("kept", "removed", "redundant", "unique_fails")}
    sums = [F.sum(flag[c] * F.col("docs")).alias(c) for c in flag] + [F.sum(flag["removed"] * F.col("good")).alias("good_lost"), F.sum(flag["removed"] * F.col("toxic")).alias("toxic_lost")]
    each = cell.join(F.broadcast(steps.withColumnRenamed("filter_order", "prefix")), "mask").groupBy("part", "prefix", "letter").agg(*sums)
    whole = steps.filter(F.col("step") == len(letters)).select("filter_order").distinct()
    places = whole.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step")).withColumn("prefix", F.expr("substring(filter_order, 1, step)"))
    rows = each.join(F.broadcast(places), "prefix")
    total = rows.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    return rows.join(total, ["part", "letter"]).select("part", "filter_order", "step", *COUNTS, "shapley")


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """One row for each part, order of the five filters and step, with counts of documents."""
    return orders(cells(masks(docs, labels, **columns)))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of five filters over all documents, by language."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE_SQL = r"""
WITH RECURSIVE texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
worded AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM texts),
known AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
marked AS (
  SELECT part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
    100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * len(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM worded LEFT JOIN known USING (doc_id)),
cells AS (
  SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS docs, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM marked GROUP BY ALL),
letters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
perms AS (SELECT '' AS o UNION ALL SELECT o || letter FROM perms, letters WHERE NOT contains(o, letter)),
steps AS (
  SELECT o AS filter_order, s.step, l.letter, l.bit,
    (SELECT coalesce(sum(x.bit), 0) FROM letters x WHERE contains(substr(o, 1, s.step - 1), x.letter))::INT AS before
  FROM perms, (SELECT unnest(range(1, 6)) AS step) s JOIN letters l ON l.letter = substr(o, s.step, 1) WHERE len(o) = 5),
counted AS (
  SELECT part, filter_order, step, letter,
    sum(docs * (mask & (before | bit) = 0)::INT) AS kept, sum(docs * (mask & before = 0 AND mask & bit > 0)::INT) AS removed,
    sum(docs * (mask & before > 0 AND mask & bit > 0)::INT) AS redundant, sum(docs * (mask = bit)::INT) AS unique_fails,
    sum(good * (mask & before = 0 AND mask & bit > 0)::INT) AS good_lost, sum(toxic * (mask & before = 0 AND mask & bit > 0)::INT) AS toxic_lost
  FROM cells, steps GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM counted
"""
