"""Text functions over columns. Offsets are code points from 0, ends exclusive; lines count from 1.

All of them stay inside the JVM. Regular expressions are Java's; patterns that must end at the end of the
text use `\\z`, and repeated groups are possessive so that long inputs do not exhaust the stack.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements that running sums take at once.
RUN = 256
#: A code point that is no character, set around matches.
MARK = "\ufdd0"

#: Comments, text blocks, strings and characters of Java; an open string ends with its line.
JAVA_LITERALS = r"""//[^\n]*+|/\*[\s\S]*?(?:\*/|\z)|\"""[\s\S]*?(?:\"""|\z)|"(?:[^"\\\n]++|\\(?:[\s\S]|\z))*+"?|'(?:[^'\\\n]++|\\(?:[\s\S]|\z))*+'?"""
#: Comments, text blocks or strings aside.
JAVA_COMMENTS = r"//[^\n]*+|/\*[\s\S]*?(?:\*/|\z)"
XML_COMMENTS = r"<!--(?:[^-]++|-(?!->))*+(?:-->|\z)"

#: White space of any kind; most characters are told by the range that none of it lies in.
BLANKS = r"[[^!-~]&&[\s   -     　﻿]]+"


def normalize_newlines(text: Column) -> Column:
    """CR LF and lone CR become LF."""
    return F.regexp_replace(text, "\r\n?", "\n")


def trim(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, rf"\A{BLANKS}|{BLANKS}\z", "")


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def explode_lines(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """(keep..., line, text): one row for each line."""
    return df.select(*keep, F.posexplode(lines_of(F.col(text))).alias("line", "text")).withColumn("line", F.col("line") + 1)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """What `use` makes of a value that is worked out once, however often `use` names it: the engine
    works an expression out anew wherever a lambda names it, but not a lambda's own variable."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column) -> Column:
    """The sum of an integer array up to and with each element: blocks first, then the sums before each block."""

    def sums(part: Column) -> Column:
        start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("all"))
        add = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["all"], F.array(acc["sum"] + x)).alias("all"))
        return F.aggregate(part, start, add, lambda acc: acc["all"])

    last = lambda b: F.coalesce(F.get(b, F.size(b) - 1), F.lit(0))
    cut = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(v), F.lit(1)) - 1) / RUN).cast("int")), lambda k: sums(F.slice(v, k * RUN + 1, RUN)))
    join = lambda blocks: F.flatten(F.zip_with(blocks, sums(F.transform(blocks, last)), lambda b, top: bound(top - last(b), lambda before: F.transform(b, lambda x: x + before))))
    return bound(values, lambda v: F.when(F.size(v) <= RUN, sums(v)).otherwise(bound(cut(v), join)))


def matches(text: Column, pattern: str) -> Column:
    """All matches from left to right as (start, end, text, line): offsets and lines are running sums over gaps and matches."""

    def measured(x: Column) -> Column:
        m, gap = x["m"], x["gap"]
        return F.struct(m.alias("m"), F.length(m).alias("n"), line_breaks(m).alias("b"), (F.length(gap) + F.length(m)).alias("chars"), (line_breaks(gap) + line_breaks(m)).alias("breaks"))

    def placed(found: Column) -> Column:
        zipped = F.arrays_zip(found.alias("x"), running(F.transform(found, lambda x: x["chars"])).alias("end"), running(F.transform(found, lambda x: x["breaks"])).alias("breaks"))
        return F.transform(zipped, lambda p: F.struct((p["end"] - p["x"]["n"]).alias("start"), p["end"].alias("end"), p["x"]["m"].alias("text"), (p["breaks"] - p["x"]["b"] + 1).alias("line")))

    return bound(F.transform(F.filter(gaps_and_matches(text, pattern), lambda x: x["m"].isNotNull()), measured), placed)


def matched_lines(text: Column, pattern: str) -> Column:
    """All matches from left to right as (text, line): `matches` without offsets."""

    def placed(found: Column) -> Column:
        ends = running(F.transform(found, lambda x: line_breaks(x["gap"]) + line_breaks(x["m"])))
        return F.zip_with(found, ends, lambda x, end: F.struct(x["m"].alias("text"), (end - line_breaks(x["m"]) + 1).alias("line")))

    return bound(F.filter(gaps_and_matches(text, pattern), lambda x: x["m"].isNotNull()), placed)


def pieces(text: Column, pattern: str) -> Column:
    """The text cut at both ends of each match: gaps at even places, matches at odd ones, a gap first and last.

    Matches are set between marks, and the text is split at those: a mark is one character, at which a text is split
    without a pattern (one that is split by a pattern pays for its compilation in every row). Texts that hold the
    character take a longer mark, made of their digest.
    """
    mark = F.when(text.contains(MARK), F.concat(F.lit(MARK), F.md5(text.cast("binary")))).otherwise(F.lit(MARK))
    return bound(mark, lambda k: F.split(F.regexp_replace(text, F.lit(pattern), F.concat(k, F.lit("$0"), k)), k, -1))


def gaps_and_matches(text: Column, pattern: str) -> Column:
    """The text from left to right as (gap, m): what stands before each match, and the match; m is null at the end."""
    pair = lambda all_, k: F.named_struct(F.lit("gap"), F.get(all_, 2 * k), F.lit("m"), F.get(all_, 2 * k + 1))
    return bound(pieces(text, pattern), lambda all_: F.when(all_.isNotNull(), F.transform(F.sequence(F.lit(0), F.shiftright(F.size(all_), 1)), lambda k: pair(all_, k))))


def blank(text: Column, pattern: str) -> Column:
    """Matches overwritten by spaces, line breaks kept, so that offsets and lines stay."""
    return F.array_join(F.transform(gaps_and_matches(text, pattern), lambda x: F.concat(F.coalesce(x["gap"], F.lit("")), F.coalesce(F.regexp_replace(x["m"], r"[^\n]", " "), F.lit("")))), "")


def mask_java(text: Column) -> Column:
    """Comments and literals blanked."""
    return blank(text, JAVA_LITERALS)


def mask_java_comments(text: Column) -> Column:
    """Comments blanked, literals as they are; what looks like a comment inside a literal is blanked too."""
    return blank(text, JAVA_COMMENTS)


def mask_xml_comments(text: Column) -> Column:
    return F.when(text.contains("<!--"), blank(text, XML_COMMENTS)).otherwise(text)


def line_breaks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def line_at(text: Column, offset: Column) -> Column:
    """The line of an offset."""
    return (line_breaks(F.substring(text, F.lit(1), offset)) + 1).cast("int")


def slice_of(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


def flat(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.btrim(F.regexp_replace(text, BLANKS, " "))


def snippet(lines: Column, start: Column, end: Column) -> Column:
    """Trimmed non-empty lines joined by line breaks, cut at 400 characters."""
    size = F.size(lines)
    a, z = F.greatest(start, F.lit(1)), F.least(end, size)
    own = F.when(z >= a, F.slice(lines, a, F.greatest(z - a + 1, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    text = F.array_join(F.filter(F.transform(own, trim), lambda x: x != ""), "\n")
    return F.when(F.length(text) > 400, F.concat(F.substring(text, 1, 400), F.lit("…"))).otherwise(text)


def shorten_path(path: Column) -> Column:
    """The last two parts of a longer path."""
    parts = F.split(path, "/", -1)
    return F.when(F.size(parts) <= 2, path).otherwise(F.concat(F.lit("…/"), F.array_join(F.slice(parts, -2, 2), "/")))


def escape_message(text: Column) -> Column:
    """Workflow command data: percent, CR, LF."""
    return F.replace(F.replace(F.replace(text, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def escape_property(text: Column) -> Column:
    """Workflow command properties: colon and space besides."""
    return F.replace(F.replace(escape_message(text), F.lit(":"), F.lit("%3A")), F.lit(" "), F.lit("%20"))


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "error", 3).when(severity == "warn", 2).when(severity == "info", 1)


def brace_pairs(df: DataFrame, text: str, *keys: str, opener: str = "{", closer: str = "}") -> DataFrame:
    """(keys..., open, close): offsets of brackets and of their partners, -1 where there is none.

    Level of an opener is the depth after it, of a closer the depth before it; the partner is the next bracket of
    the level, if that is a closer.
    """
    from pyspark.sql import Window

    chars = df.select(*keys, F.posexplode(F.split(F.col(text), "")).alias("pos", "ch")).filter(F.col("ch").isin(opener, closer))
    step = F.when(F.col("ch") == opener, 1).otherwise(-1)
    run = Window.partitionBy(*keys).orderBy("pos")
    deep = chars.withColumn("depth", F.sum(step).over(run.rowsBetween(Window.unboundedPreceding, 0)))
    deep = deep.withColumn("level", F.when(F.col("ch") == opener, F.col("depth")).otherwise(F.col("depth") + 1))
    level = Window.partitionBy(*keys, "level").orderBy("pos")
    ahead = deep.withColumns({"next": F.lead("ch").over(level), "at": F.lead("pos").over(level)})
    return ahead.filter(F.col("ch") == opener).select(*keys, F.col("pos").alias("open"), F.when(F.col("next") == closer, F.col("at")).otherwise(-1).alias("close"))
