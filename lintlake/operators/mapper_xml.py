"""Mapper XML as tables: statements, fragments, nested selects, SQL scopes.

One alternation finds, from left to right, whole statements, whole fragments and single tags; what lies inside
a statement is not looked at again. A file is one row with an array of its elements, on which everything is
worked out by array functions: nothing is shuffled, and rows are exploded last. A statement's text starts after its
opening tag, so lines are counted from the line where that tag ends. A file may hold any number of tags.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.functions import text as X

# Statements, and attributes that only statements of mappers carry.
STATEMENTS = ("select", "insert", "update", "delete")
SIGNS = ("resultType", "resultMap", "parameterType", "useGeneratedKeys")
#: The inside of a tag; quoted values may hold ">". Possessive, so that long tags do not use up the stack.
INSIDE = r"""(?:[^"'>]++|"[^"]*+"|'[^']*+')*+"""
NAME = r"[A-Za-z_][\w:.-]*+"
TAG = rf"</?{NAME}{INSIDE}>"


def _up_to_end(name: str, group: str = "?:") -> str:
    """The text up to the first closing tag of a name, and that tag, in runs instead of one by one."""
    end = rf"/\s*(?i:{name})\s*>"
    return rf"({group}(?:[^<]++|<(?!{end}))*+)<{end}"


#: A statement ends with the tag of its own name.
ELEMENT = "|".join(
    [rf"<{k}(?![\w:.-]){INSIDE}(?:(?<=/)>|>{_up_to_end(k)})" for k in STATEMENTS]
    + [rf"<sql(?![\w:.-]){INSIDE}(?<!/)>{_up_to_end('sql')}", rf"</?(?:resultMap|mapper|collection|association)(?![\w:.-]){INSIDE}>"]
)
#: A quoted value without blanks, quotes and ends of tags; attributes of which the only id, and the first, is such a value.
PLAIN = r'"([!#-&(-;=?-~]++)"'
PLAIN_ID = rf"""\s++id={PLAIN}(?:\s++(?!id=)[\w:.-]++="[^"'=]*+")*+\s*+/?+(?=>)"""
#: The same elements; groups hold names (1, 5, 9), attributes (2, 6, 10), plain ids (3, 7) and bodies (4, 8) of statements, fragments and mapper tags.
GROUPED = "<(?:" + "|".join(
    [rf"({'|'.join(STATEMENTS)})(?![\w:.-])({PLAIN_ID}|{INSIDE})(?:(?<=/)>|>{_up_to_end(r'\1', '')})", rf"(sql)(?![\w:.-])({PLAIN_ID}|{INSIDE})(?<!/)>{_up_to_end('sql', '')}"]
    + [rf"(/?mapper)(?![\w:.-])({INSIDE})>", rf"/?(?:resultMap|collection|association)(?![\w:.-]){INSIDE}>"]
) + ")"
#: Characters that XML does not know: around elements and bodies, between parts, around includes, in place of commas; around what stands for them.
AROUND, BETWEEN, INCLUDED, COMMA, STANDS = "\x01", "\x02", "\x03", "\x04", "\x05"
_OPEN = rf"\A<(/?)({NAME})({INSIDE})>"
INCLUDE = rf"(?i)<include\b{INSIDE}>"
#: Where a tag begins that leaves words in the SQL.
WORDED = r"<(?i:where|set|trim)(?![\w:.-])"
# Fixed value: how deep includes are followed.
INCLUDE_LEVELS = 3
TEMPLATE = r"<#\[\[|</?#"


def is_mapper(masked: Column) -> Column:
    """By a mapper tag or by what only mapper statements carry, so that fragments of a file count too."""
    return masked.rlike(rf"<mapper[\s>]|<(?:{'|'.join(STATEMENTS)})\s[^>]*?(?:{'|'.join(SIGNS)})\s*=")


def root_element(masked: Column) -> Column:
    """The name of the first element, null where there is none."""
    name = F.regexp_extract(masked, f"<({NAME})", 1)
    return F.when(name != "", name)


def attribute(attrs: Column, name: str) -> Column:
    """The value of an attribute (the last of its name), trimmed; null where it is missing."""
    blanks = X.BLANKS.removesuffix("+") + "*+"
    # most values are plain words, which end at the first quote
    rx = rf"""{name}(?<![\w:.-]{name})\s*=\s*(["']){blanks}([!#-&(-~]++(?=\1)|(?s:.)*?){blanks}\1"""
    return F.try_element_at(F.regexp_extract_all(attrs, F.lit(rx), F.lit(2)), F.lit(-1))


def unwrap_cdata(text: Column) -> Column:
    return F.when(text.contains("<![CDATA["), F.regexp_replace(text, r"<!\[CDATA\[([\s\S]*?)\]\]>", "$1")).otherwise(text)


def _woven(text: Column, pattern: str, put) -> Column:
    """Text with each match replaced by what `put` makes of it."""
    one = lambda x: F.concat(F.coalesce(x["gap"], F.lit("")), F.when(x["m"].isNotNull(), put(x["m"])).otherwise(""))
    return F.array_join(F.transform(X.gaps_and_matches(text, pattern), one), "")


def strip_tags(text: Column) -> Column:
    """Tags become spaces, but where, set and a trim's prefix leave the words that they put into the SQL."""

    def words(tag: Column) -> Column:
        name = F.lower(F.regexp_extract(tag, f"<({NAME})", 1))
        return F.when(name.isin("where", "set"), F.concat(F.lit(" "), name, F.lit(" "))).when(name == "trim", F.concat(F.lit(" "), F.coalesce(attribute(tag, "prefix"), F.lit("")), F.lit(" "))).otherwise(" ")

    # where no tag leaves words, one pass without arrays does it
    return F.when(~text.contains("<"), text).when(text.rlike(WORDED), _woven(text, TAG, words)).otherwise(F.regexp_replace(text, TAG, " "))


def element_array(masked: Column) -> Column:
    """Elements of a masked text: el_ord, closing, name, attrs, self_closing, body, line of the tag, line where it ends."""

    def one(m: Column, k: Column) -> Column:
        # a match starts with its tag: each part is cut off what the one before left, and worked out once
        tag = X.bound(F.regexp_extract(m["text"], _OPEN, 0), lambda tag: F.struct(tag.alias("tag"), F.regexp_extract(tag, rf"\A</?{NAME}", 0).alias("head")))
        return X.bound(tag, lambda x: parts(m, k, x["tag"], x["head"]))

    def parts(m: Column, k: Column, tag: Column, head: Column) -> Column:
        closing = F.startswith(head, F.lit("</"))
        attrs = F.substr(tag, F.length(head) + 1, F.length(tag) - F.length(head) - 1)
        rest = F.substr(m["text"], F.length(tag) + 1)
        # what is left ends with the closing tag, in which no other begins
        inner = F.when(rest != "", F.substr(rest, F.lit(1), F.length(rest) - F.length(F.substring_index(rest, "</", -1)) - 2)).otherwise("")
        return F.struct(
            k.alias("el_ord"), closing.alias("closing"), F.substr(head, F.when(closing, 3).otherwise(2)).alias("name"), attrs.alias("attrs"), attrs.rlike(r"/\s*\z").alias("self_closing"),
            unwrap_cdata(inner).alias("body"), m["line"].alias("line"), (m["line"] + X.line_breaks(tag)).alias("body_line"),
        )

    return F.transform(X.matched_lines(masked, ELEMENT), one)


def elements(units: DataFrame, *keep: str) -> DataFrame:
    """(keep..., els): each mapper file with its elements."""
    masked = units.filter(F.col("lang") == "xml").select(*keep, X.mask_xml_comments(F.col("content")).alias("masked"))
    return masked.filter(is_mapper(F.col("masked"))).select(*keep, element_array(F.col("masked")).alias("els"))


def holding(units: DataFrame, pattern: str) -> DataFrame:
    """Units in whose mappers some body or tag may match a pattern that is matched by text without a gap.

    Comments and tags leave spaces, so nothing is put together across them; only the edges of CDATA vanish, so files with CDATA stay.
    """
    return units.filter(F.col("content").rlike(rf"(?:{pattern})|<!\[CDATA\["))


def _opened(*names: str) -> Column:
    return F.filter("els", lambda e: e["name"].isin(*names) & ~e["closing"])


def statements() -> Column:
    """Statements of `els` by line."""
    one = lambda e: F.struct(F.lit(0).alias("part"), e["line"].alias("at"), e["el_ord"].alias("el_ord"), e["name"].alias("kind"), F.coalesce(attribute(e["attrs"], "id"), F.lit("")).alias("id"), e["body"].alias("raw"), e["line"].alias("line"), e["body_line"].alias("base"))
    return F.array_sort(F.transform(_opened(*STATEMENTS), one))


def fragments() -> Column:
    """Named fragments of `els`; of equal names the last, in the place of the first."""
    named = F.filter(F.transform(_opened("sql"), lambda e: F.struct(F.coalesce(attribute(e["attrs"], "id"), F.lit("")).alias("id"), e["el_ord"].alias("el_ord"), e["body"].alias("raw"), e["line"].alias("line"), e["body_line"].alias("base"))), lambda f: f["id"] != "")
    one = lambda a, z: F.struct(F.lit(1).alias("part"), a["el_ord"].alias("at"), a["el_ord"].alias("el_ord"), F.lit("sql").alias("kind"), z["id"].alias("id"), z["raw"].alias("raw"), z["line"].alias("line"), z["base"].alias("base"))
    edge = lambda by_id, step: F.filter(by_id, lambda f, k: F.coalesce(F.get(by_id, k + step)["id"] != f["id"], F.lit(True)))
    return F.array_sort(X.bound(F.array_sort(named), lambda by_id: F.zip_with(edge(by_id, -1), edge(by_id, 1), one)))


def nested_selects(el: DataFrame, *keep: str) -> DataFrame:
    """(keep..., map_ord, map_id, line): associations and collections with a select, inside a closed result map."""
    maps = F.filter("els", lambda e: e["name"].isin("resultMap", "collection", "association"))
    rows = el.select(*keep, maps.alias("all"))
    closer = lambda x: (x["name"] == "resultMap") & x["closing"]
    chosen = lambda x: F.coalesce(attribute(x["attrs"], "select"), F.lit("")) != ""
    last = F.array_max(F.transform(F.filter("all", closer), lambda x: x["el_ord"]))
    each = rows.select(*keep, "all", last.alias("last"), F.explode(F.filter("all", lambda x: (x["name"] != "resultMap") & ~x["closing"] & chosen(x))).alias("x"))
    before = F.filter("all", lambda y: (y["name"] == "resultMap") & ~y["self_closing"] & (y["el_ord"] < F.col("x.el_ord")))
    each = each.withColumn("b", F.try_element_at(before, F.lit(-1)))
    inside = each.filter(F.col("b").isNotNull() & ~F.col("b.closing") & (F.col("last") > F.col("x.el_ord")))
    return inside.select(*keep, F.col("b.el_ord").alias("map_ord"), F.coalesce(attribute(F.col("b.attrs"), "id"), F.lit("")).alias("map_id"), F.col("x.el_ord").alias("el_ord"), F.col("x.line").alias("line"))


def namespace() -> Column:
    """The namespace of the last mapper tag of `els`."""
    return attribute(F.try_element_at(_opened("mapper"), F.lit(-1))["attrs"], "namespace")


def namespace_of(el: DataFrame, *keep: str) -> DataFrame:
    return el.filter(F.size(_opened("mapper")) > 0).select(*keep, namespace().alias("namespace"))


def namespaces(units: DataFrame, *keep: str) -> DataFrame:
    """`namespace_of` the elements of mapper files, of which nothing else is worked out."""
    masked = units.filter(F.col("lang") == "xml").select(*keep, X.mask_xml_comments(F.col("content")).alias("masked"))
    opened = F.filter(F.regexp_extract_all("masked", F.lit(ELEMENT), F.lit(0)), lambda x: F.startswith(x, F.lit("<mapper")))
    # exploded, not filtered: a filter would search the text once more
    tags = masked.filter(is_mapper(F.col("masked"))).select(*keep, F.explode(F.slice(opened, -1, 1)).alias("tag"))
    attrs = F.substr("tag", F.lit(len("<mapper") + 1), F.length("tag") - len("<mapper>"))
    return tags.select(*keep, attribute(attrs, "namespace").alias("namespace"))


def _lookup(refid: Column, frags: Column) -> Column:
    """The text of a fragment by its id, or by its id after the mapper's own namespace; null where there is none."""
    prefix = F.concat(F.col("namespace"), F.lit("."))
    short = lambda r: F.when(F.startswith(r, prefix), F.substr(r, F.length(prefix) + 1))
    return X.bound(refid, lambda r: F.coalesce(F.try_element_at(frags, r), F.try_element_at(frags, F.coalesce(short(r), F.lit("")))))


def inlined(text: Column, frags: Column) -> Column:
    """Includes replaced by their fragments, unknown ones by a space."""
    put = lambda tag: F.coalesce(F.concat(F.lit(" "), _lookup(attribute(tag, "refid"), frags), F.lit(" ")), F.lit(" "))
    return F.when(text.rlike("(?i)<include"), _woven(text, INCLUDE, put)).otherwise(text)


def resolved_fragments(levels: int) -> Column:
    """Fragments of `frs` by id, with the includes in them replaced down to so many levels: each level names the one before.

    A fragment is resolved once for all that include it, by however many ways; in a cycle the includes that
    are left at the last level become spaces.
    """
    raw = F.map_from_entries(F.transform("frs", lambda f: F.struct(f["id"], f["raw"])))
    known = raw
    for _ in range(levels):
        known = X.bound(known, lambda k: F.transform_values(raw, lambda _, text: inlined(text, k)))
    return known


def unresolved(raw: Column) -> Column:
    refs = F.array_distinct(F.transform(F.regexp_extract_all(raw, F.lit(INCLUDE), F.lit(0)), lambda tag: attribute(tag, "refid")))
    unknown = F.filter(refs, lambda r: r.isNotNull() & (r != "") & _lookup(r, F.col("frags")).isNull())
    return F.when(raw.rlike("(?i)<include"), unknown).otherwise(F.array().cast("array<string>"))


def xml_scopes(el: DataFrame, *keep: str) -> DataFrame:
    """SQL scopes of mapper files, numbered: statements by line, then fragments; includes inlined up to three levels."""
    known = el.select(*keep, namespace().alias("namespace"), statements().alias("sts"), fragments().alias("frs"))
    # a statement's includes are replaced by fragments whose own includes are, two levels down: three levels in all. What
    # stands beside an explode is worked out for each of its rows, and fields picked from an exploded struct each work the array out
    # anew, so fragments and includes come first, and `inline` makes the columns
    rows = known.withColumn("frags", resolved_fragments(INCLUDE_LEVELS - 1))
    same = ("kind", "id", "raw", "line", "base")
    one = lambda s, k: F.struct((k + 1).alias("scope_ix"), *[s[c].alias(c) for c in same], inlined(s["raw"], F.col("frags")).alias("t"), unresolved(s["raw"]).alias("unresolved"))
    each = rows.select(*keep, F.inline(F.transform(F.concat("sts", "frs"), one)))
    return each.select(*keep, "scope_ix", "kind", "id", "raw", X.flat(strip_tags(F.col("t"))).alias("resolved"), "line", "base", F.lit("xml").alias("source"), "unresolved")


def resolved_statements(units: DataFrame, *keep: str) -> DataFrame:
    """(keep..., kind, id, resolved): statements of mapper files as in `xml_scopes`, of which nothing else is worked out.

    Patterns go over whole files: elements and their parts are told by one pass, includes in all bodies by another. A body is
    cut at its includes once, each of which names a fragment by its place, so a level only puts strings together.
    """
    masked = units.filter(F.col("lang") == "xml").select(*keep, X.mask_xml_comments(F.col("content")).alias("masked"))
    # files are gated in the column: a filter would go below `spread`, where texts are made a second time by few tasks
    marks = (AROUND, BETWEEN, INCLUDED, COMMA)
    some = functools.reduce(operator.or_, (F.col("masked").contains(m) for m in marks))
    texts = masked.select(*keep, F.when(is_mapper(F.col("masked")), F.col("masked")).alias("text"), F.when(some, F.md5(F.col("masked").cast("binary"))).alias("digest"))

    def swapped(text: Column, back: bool) -> Column:
        """Marks that a file holds by itself give way to what its digest stands for, and come back."""
        other = text
        for k, m in enumerate(marks):
            pair = (F.lit(m), F.concat(F.lit(STANDS), "digest", F.lit(f"{k}{STANDS}")))
            other = F.replace(other, *(reversed(pair) if back else pair))
        return F.when(F.col("digest").isNull(), text).otherwise(other)

    # each match as name, plain id, attributes and body; what is not matched, at even places, is left out
    parts = F.regexp_replace(swapped(F.col("text"), False), GROUPED, AROUND + BETWEEN.join(("$1$5$9", "$3$7", "$2$6$10", "$4$8")) + AROUND)
    found = F.filter(F.split(parts, AROUND, -1), lambda _, k: k % 2 == 1)
    els = texts.select(*keep, "digest", F.transform(found, lambda x: F.split(x, BETWEEN, -1)).alias("els"))
    mapper = F.try_element_at(F.filter("els", lambda e: e[0] == "mapper"), F.lit(-1))
    id_of = lambda e: F.when(e[1] != "", e[1]).otherwise(F.coalesce(attribute(e[2], "id"), F.lit("")))
    own = F.transform(F.filter("els", lambda e: e[0].isin(*STATEMENTS, "sql")), lambda e: F.struct(e[0].alias("kind"), id_of(e).alias("id"), unwrap_cdata(e[3]).alias("raw")))
    own = els.select(*keep, "digest", F.concat(attribute(F.get(mapper, F.lit(2)), "namespace"), F.lit(".")).alias("prefix"), own.alias("own"))

    # no include reaches from one body into the next
    inside = INSIDE.replace("""[^"'>]""", f"""[^"'>{AROUND}]""").replace('[^"]', f'[^"{AROUND}]').replace("[^']", f"[^'{AROUND}]")
    include = rf"(?i)<include\b(?:\s++(?-i:refid)={PLAIN}\s*+/?+(?=>)|{inside})>"
    cuts = F.split(F.regexp_replace(F.array_join(F.col("own.raw"), AROUND), include, f"{INCLUDED}$1{BETWEEN}$0{INCLUDED}"), AROUND, -1)
    scopes = own.select(*keep, "digest", "prefix", F.zip_with("own", F.when(F.size("own") > 0, cuts), lambda e, cut: F.struct(e["kind"].alias("kind"), e["id"].alias("id"), e["raw"].alias("raw"), F.split(cut, INCLUDED, -1).alias("cuts"))).alias("scopes"))

    # of equal names the last: the first from behind
    named = F.reverse(F.filter("scopes", lambda s: (s["kind"] == "sql") & (s["id"] != "")))
    known = scopes.select(*keep, "digest", "prefix", named.alias("named"), F.filter("scopes", lambda s: s["kind"] != "sql").alias("sts"))
    bare = lambda text: F.replace(text, F.lit(","), F.lit(COMMA))
    ids = F.replace(bare(F.array_join(F.col("named.id"), AROUND)), F.lit(AROUND), F.lit(","))
    known = known.select("*", F.nullif(ids, F.lit("")).alias("ids"))

    def place(cut: Column) -> Column:
        """The place of the fragment that an include names, 0 where there is none."""
        at = lambda r: F.find_in_set(bare(r), F.col("ids"))
        after = lambda r: F.coalesce(F.nullif(at(r), F.lit(0)), at(F.substr(r, F.length("prefix") + 1)))
        refid = F.when(F.startswith(cut, F.lit(BETWEEN)), attribute(cut, "refid")).otherwise(F.substring_index(cut, BETWEEN, 1))
        return X.bound(refid, lambda r: F.coalesce(F.when(F.startswith(r, F.col("prefix")), after(r)).otherwise(at(r)), F.lit(0)))

    pieces = lambda s: F.transform(s["cuts"], lambda x, k: F.struct(F.when(k % 2 == 0, x).alias("text"), F.when(k % 2 == 1, place(x)).alias("at")))
    one = lambda s: F.struct(s["kind"].alias("kind"), s["id"].alias("id"), pieces(s).alias("pieces"))
    cut = known.select(*keep, "digest", F.col("named.raw").alias("raw"), F.transform("named", pieces).alias("frs"), F.transform("sts", one).alias("own"))

    def put(pieces: Column, frags: Column) -> Column:
        text = lambda x: F.when(x["at"].isNull(), x["text"]).when(x["at"] == 0, F.lit(" ")).otherwise(F.concat(F.lit(" "), F.get(frags, x["at"] - 1), F.lit(" ")))
        return F.array_join(F.transform(pieces, text), "")

    level = F.col("raw")
    for _ in range(INCLUDE_LEVELS - 1):
        level = X.bound(level, lambda k: F.transform("frs", lambda f: put(f, k)))
    rows = X.bound(level, lambda k: F.transform("own", lambda s: F.struct(s["kind"].alias("kind"), s["id"].alias("id"), put(s["pieces"], k).alias("t"))))
    each = cut.select(*keep, "digest", F.inline(rows))
    return each.select(*keep, "kind", swapped(F.col("id"), True).alias("id"), swapped(X.flat(strip_tags(F.col("t"))), True).alias("resolved"))
