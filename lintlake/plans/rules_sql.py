"""Rules over SQL scopes: interpolation, wildcards, all columns, unbounded reads. Every one is a projection or an
explode of the scope table; only the check for paged queries joins, on the file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions import text as X
from lintlake.plans.drafting import drafts

# Fixed patterns: placeholders that frameworks fill in.
FRAMEWORK = r"\A(?:ew\.\w+|criterion\.\w+|orderByClause|distinct|_parameter\.\w+)\z"
# Fixed patterns: names of sort parameters, and the context that makes them so.
SORT_NAME = r"(?i)\A(?:sort|order|dir|direction|column|field|table|by|asc|desc)"
SORT_CONTEXT = r"(?i)order\s+by|group\s+by|\blimit\b|\boffset\b|\bset\b|from\s*\z|select\s+[\w.,*\s]*\z"
# Fixed patterns: what stands around a placeholder.
MARKUP = r"\A(?:<[^>]*>|\s)*+\z"
AFTER_CLAUSE = r"(?i)\b(?:order|group)\s+by\s+[\w.,*\s]*(?:(?:asc|desc)\s*)?\z"
COMPARED = r"(?i)\A\s*(?:=|!=|<>|>=|<=|<|>|\blike\b|\bin\b|\bbetween\b)"
SELECTED = r"(?i)\b(?:select|distinct)\b[\s\w.,*]*\z"
OBJECT = r"(?i)\b(?:from|join|into|update|table|index|sequence)\b[\s\w.,]*\z"
VALUE = r"""(?i)(?:['"%=<>!(,]|\b(?:like|in|set|values|limit|offset|when|then|else|using|having)\b\s*)\z"""
# Fixed patterns: leading wildcards, in the order of their drafts.
WILDCARDS = [
    (r"(?i)\blike\s*\(?\s*'\s*%", "a literal that begins with %"),
    (r"(?i)\blike\s*\(?\s*concat\s*\(\s*'%'", "concat('%', ...)"),
    (r"(?i)\bconcat\s*\(\s*'%'\s*,", "a parameter with % put before it"),
    (r"""(?i)<bind\b[^>]*value\s*=\s*["']\s*'%'\s*\+""", "a bind that puts % before the parameter"),
]
QUOTED = r"'\s*#\{[^}]*\}\s*'"
STAR = r"(?i)\bselect\s+(?:distinct\s+)?(?:`?\w+`?\s*\.\s*)?\*"
AGGREGATED = r"(?i)\A\s*select\s+(?:distinct\s+)?(?:count|sum|avg|max|min|group_concat|json_arrayagg|json_objectagg)\s*\("
AGGREGATE = r"(?i)\b(?:count|sum|avg|max|min|group_concat)\s*\("
BOUNDED = r"\bwhere\b|\blimit\b|\boffset\b|\btop\s+\d|\bhaving\b|\bexists\s*\(|\bin\s*\("
DYNAMIC = r"(?i)<\s*(?:where|if|foreach|trim|choose|when)\b"


def label() -> Column:
    return F.when(F.col("source") == "xml", F.concat_ws("#", "kind", "id")).otherwise(F.concat(F.lit("annotation "), F.col("kind")))


def scope_line(offset: Column) -> Column:
    """The line of an offset into the raw text; annotation SQL is flat and stays on its line."""
    return F.col("base") + X.line_breaks(F.substring(F.col("raw"), F.lit(1), offset))


def first_match(text: Column, pattern: str) -> Column:
    """The offset of the first match, null where there is none."""
    at = F.regexp_instr(text, F.lit(pattern))
    return F.when(at > 0, at - 1)


def placeholders(scopes: DataFrame) -> DataFrame:
    """Interpolations that are not exempt: scope columns with ph_ord, offset, fragment, head, position and sort_like."""
    raw = F.col("raw")
    each = scopes.filter(raw.contains("${")).select("*", F.posexplode(X.matches(raw, r"\$\{[^}]*\}")).alias("ph_ord", "m"))
    fragment = X.trim(F.regexp_extract(F.col("m.text"), r"\A\$\{([\s\S]*)\}\z", 1))
    each = each.withColumns({"offset": F.col("m.start"), "fragment": fragment}).filter("fragment != ''")
    each = each.withColumn("head", F.regexp_extract("fragment", r"\A[^.\s(\[]*", 0))
    bound = F.regexp_extract_all(raw, F.lit(r"""<property\s+name=["'](\w+)["']"""), F.lit(1))
    prefix = X.slice_of(raw, F.lit(0), F.col("offset"))
    opened = F.substring_index(prefix, "#{", -1)
    binding = prefix.contains("#{") & ~opened.contains("}")
    each = each.filter(~F.array_contains(bound, F.col("head")) & ~F.col("fragment").rlike(FRAMEWORK) & ~binding)

    context = X.slice_of(raw, F.greatest(F.lit(0), F.col("offset") - 60), F.col("offset") + F.length("fragment") + 20)
    near_before = F.substring_index(prefix, "\n", -1)
    near_after = F.substring_index(F.substr(raw, F.col("m.end") + 1), "\n", 1)
    each = each.withColumns({"nb": near_before, "na": near_after, "prefix": prefix, "sort_like": F.col("head").rlike(SORT_NAME) & context.rlike(SORT_CONTEXT)})
    before, after = F.regexp_replace("nb", rf"{X.BLANKS}\z", ""), X.trim(F.col("na"))
    tail = F.regexp_replace(F.substr("prefix", F.lit(1), F.length("prefix") - F.length("nb")), rf"{X.BLANKS}\z", "")
    each = each.withColumns({"before": before, "after": after, "tail": F.when(before == "", F.right(tail, F.lit(80))).otherwise("")})
    b, a = F.col("before"), F.col("after")
    in_tag = b.contains("<") & ~F.substring_index(b, "<", -1).contains(">") & b.rlike("[\"']\\z")
    position = (
        F.when(b.rlike(r"(?i)<include\b[^>]*\z"), "include")
        .when(b.rlike(AFTER_CLAUSE), "clause")
        .when(b.rlike(MARKUP) & a.rlike(MARKUP), "fragment")
        .when(in_tag, "attribute")
        .when(a.rlike(COMPARED) | F.col("nb").rlike(r"[\w$]\z") | F.col("na").rlike(r"\A[\w$]") | b.rlike(OBJECT) | b.rlike(SELECTED), "identifier")
        .when(F.col("prefix").rlike(r"(?i)\bselect\b") & ~F.col("prefix").rlike(r"(?i)\bfrom\b"), "identifier")
        .when(b.rlike(VALUE) | ((F.col("tail") != "") & F.col("tail").rlike(VALUE)), "value")
        .otherwise("fragment")
    )
    return each.withColumn("position", position).drop("m", "nb", "na", "prefix", "before", "after", "tail")


def myb001(scopes: DataFrame) -> DataFrame:
    own = placeholders(scopes)
    p, name = F.col("position"), F.concat(F.lit("${"), F.col("fragment"), F.lit("}"))
    path = F.col("fragment").rlike(r"\A[\w$]+(?:\.[\w$]+)*\z")
    hint = (
        F.when(p == "include", "Fix the property when building, or write the fragment's name.")
        .when(p == "attribute", "Test the parameter itself in the attribute; map dynamic names on the server.")
        .when(p == "fragment", "A whole piece of SQL cannot be bound: make sure that no request reaches its source.")
        .when(p.isin("clause", "identifier"), "Map identifiers through a list of allowed ones on the server; keep values bound.")
        .when(path, F.concat(F.lit("Bind it as #{"), F.col("fragment"), F.lit("}.")))
        .otherwise("Work the value out in Java first, then bind it.")
    )
    message = F.concat(label(), F.lit(" puts "), name, F.lit(" into the SQL text as "), p)
    severity = F.when(F.col("sort_like") | (p == "include"), "warn").otherwise("error")
    return drafts(own, "MYB001", scope_line(F.col("offset")), ["scope_ix", "ph_ord"], message, hint, severity)


def myb003(scopes: DataFrame) -> DataFrame:
    text = F.when(F.col("source") == "xml", F.col("raw")).otherwise(F.col("resolved"))
    own = scopes.withColumn("text", text)
    quoted = (F.col("source") == "xml") & F.col("text").rlike(QUOTED) & F.col("text").rlike(r"(?i)\blike\b")
    own = own.withColumn("quoted", quoted)
    one = own.filter("quoted").withColumns({"offset": first_match(F.col("text"), QUOTED), "why_ix": F.lit(-1), "why": F.lit("")})
    parts = [own.filter("not quoted").withColumns({"offset": first_match(F.col("text"), rx), "why_ix": F.lit(k), "why": F.lit(why)}) for k, (rx, why) in enumerate(WILDCARDS)]
    all_ = reduce(DataFrame.unionByName, [one, *parts]).filter("offset is not null")
    message = F.when(F.col("quoted"), F.concat(label(), F.lit(" quotes a placeholder, so it is not bound"))).otherwise(F.concat(label(), F.lit(" searches with "), F.col("why")))
    hint = F.when(F.col("quoted"), "Take the quotes away and build the pattern with concat.").otherwise("Search by prefix, or use a full-text index.")
    return drafts(all_, "MYB003", scope_line(F.col("offset")), ["scope_ix", F.col("why_ix") + 1], message, hint, F.when(F.col("quoted"), "error").otherwise("warn"))


def myb004(scopes: DataFrame) -> DataFrame:
    own = scopes.filter((F.col("kind") == "select") & ~F.col("resolved").rlike(AGGREGATED) & F.col("resolved").rlike(STAR))
    at = first_match(F.col("raw"), STAR)
    line = F.when(at.isNotNull(), scope_line(at)).otherwise(F.col("line"))
    return drafts(own, "MYB004", line, ["scope_ix"], F.concat(label(), F.lit(" selects all columns")), "List the columns that are needed, in a shared fragment.")


def bounded() -> Column:
    """Whether a scope has, or may have through what cannot be seen, a condition or a limit."""
    return (F.size("unresolved") > 0) | F.lower("resolved").rlike(BOUNDED) | F.col("raw").rlike(DYNAMIC) | F.col("raw").rlike(r"\$\{\s*ew\.")


def paged(scopes: DataFrame, companions: DataFrame) -> DataFrame:
    """Scopes with `paged`: a paging helper in the SQL, or a page parameter of the companion's method of that name."""
    joined = scopes.join(companions.select("path", "companion_content"), "path", "left")
    both = F.lower(F.concat_ws(" ", "raw", "resolved"))
    named = F.concat(F.lit(r"(?i)\b\Q"), F.replace("id", F.lit(r"\E"), F.lit("")), F.lit(r"\E\s*\(([^)]*)\)"))
    params = F.lower(F.call_function("regexp_extract", F.coalesce("companion_content", F.lit("")), named, F.lit(1)))
    return joined.withColumn("paged", both.rlike("rowbounds|pagehelper|startpage") | params.rlike(r"\b(?:ipage|page)\s*<|pagehelper|startpage|rowbounds")).drop("companion_content")


def myb005(scopes: DataFrame, companions: DataFrame) -> DataFrame:
    open_ = scopes.filter((F.col("kind") == "select") & F.col("resolved").rlike(r"(?i)\bfrom\b") & ~bounded())
    own = paged(open_, companions).filter("not paged")
    grouped = F.col("resolved").rlike(r"(?i)\bgroup\s+by\b")
    bare = F.regexp_replace("resolved", r"(?i)\A\s*select\s+(?:distinct\s+)?", "")
    own = own.filter(~(bare.rlike(AGGREGATE) & ~grouped))
    message = F.concat(label(), F.when(grouped, " scans the whole table before it groups").otherwise(" reads a whole table, without a condition or a limit"))
    hint = F.when(grouped, "Index the grouped columns or narrow the range.").otherwise("Add a condition and paging, or read in batches.")
    return drafts(own, "MYB005", "line", ["scope_ix"], message, hint, F.when(grouped, "warn").otherwise("error"))


def nested_selects(nested: DataFrame) -> DataFrame:
    return drafts(nested, "MYB002", "line", [F.lit(1), "map_ord", "el_ord", F.lit(0)], F.concat(F.lit("result map "), F.col("map_id"), F.lit(" runs a nested select for each row")), "Join once and map the columns.")
