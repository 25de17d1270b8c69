"""Secret scans that weigh candidates by corpus-wide ownership.

Fixed patterns give base spans. Every candidate value (those of base spans, and any other long string
that mixes letters and digits) is hashed; the hashes are aggregated over the corpus into the numbers of
distinct repositories and owners. A value that many owners hold is an example that was copied around; one
that few owners hold and that has enough different characters looks live. Live values outside base spans
add spans of kind `live`; base spans always stay.

Null texts count as empty. Null owners or repositories count as one further owner or repository. Rows with
the same id and text get the same result each. Only DataFrame and SQL functions run here: the hot path is
one scan with early exits, and what is shuffled are candidate hashes, first deduplicated map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.functions.text import RUN, bound, running
from lintlake.llm.common import stored, table

#: A value held by more owners than this is a widely copied example.
MAX_OWNERS = 2
#: Different characters that a live-looking value has at least.
MIN_DISTINCT = 8
#: Characters that a candidate outside the base patterns has at least.
MIN_TOKEN = 20

# Fixed patterns.
_NAMES = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
TOKEN = f"[A-Za-z0-9+/_-]{{{MIN_TOKEN},}}"
KINDS = ("assign", "access", "hex", "live")
_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _found(text: Column, pattern: str, kind: int, maybe: Column, group: int = 0, least: int = 0) -> Column:
    """Matches of a pattern as (start, kind, end, value): lengths of gaps and matches, summed from the left."""
    rx = F.lit(pattern)
    hits = F.arrays_zip(F.regexp_extract_all(text, rx, F.lit(0)).alias("m"), F.regexp_extract_all(text, rx, F.lit(group)).alias("v"), F.split(text, pattern, -1).alias("gap"))

    one = lambda p: F.struct((p["end"] - F.length(p["x"]["m"])).alias("start"), F.lit(kind).alias("kind"), p["end"].alias("end"), p["x"]["v"].alias("value"))
    ended = lambda h: F.arrays_zip(h.alias("x"), running(F.transform(h, lambda x: F.length(x["gap"]) + F.length(x["m"]))).alias("end"))
    # the last gap has no match: arrays_zip pads it with nulls
    placed = bound(F.filter(hits, lambda x: x["m"].isNotNull()), ended)
    spans = F.filter(F.transform(placed, one), lambda s: F.length(s["value"]) >= least)
    return F.when(maybe, spans).otherwise(F.array().cast(_SPAN))


def apart(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others: these are sorted into runs with their outer bounds, and only runs whose bounds overlap are looked at."""
    ordered = F.array_sort(F.transform(others, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    def run(part: Column) -> Column:
        return F.struct(F.get(part, F.lit(0))["start"].alias("lo"), F.array_max(F.transform(part, lambda s: s["end"])).alias("hi"), part.alias("spans"))

    cut = lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(all_), F.lit(1)) - 1) / RUN).cast("int")), lambda k: bound(F.slice(all_, k * RUN + 1, RUN), run))
    meets = lambda a, b, lo, hi: (b[lo] < a["end"]) & (a["start"] < b[hi])
    near = lambda c, runs: F.exists(runs, lambda r: meets(c, r, "lo", "hi") & F.exists(r["spans"], lambda b: meets(c, b, "start", "end")))
    return bound(bound(ordered, cut), lambda runs: F.filter(spans, lambda c: ~F.coalesce(near(c, runs), F.lit(False))))


def joined(spans: Column) -> Column:
    """kind:start:end of spans, by start, then kind."""
    names = F.array(*map(F.lit, KINDS))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def live_looking(value: Column) -> Column:
    """Letters, digits and enough different characters."""
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= MIN_DISTINCT)


def candidates(docs: DataFrame, doc_id: str, text: str, owner: str, repository: str) -> DataFrame:
    """Base spans and further candidates of each row, found in one scan; `found` is written to the shared folder."""
    body = F.coalesce(F.col(text), F.lit(""))
    low = F.lower(F.col("__t"))
    hinted = F.lit(False)
    for h in _HINTS:
        hinted = hinted | low.contains(h)
    t = F.col("__t")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(owner).cast("string").alias("__owner"), F.col(repository).cast("string").alias("__repo"), body.alias("__t"))
    rows = rows.select(
        "doc_id", "__owner", "__repo", F.xxhash64("__t").alias("__key"),
        _found(t, ASSIGN, 0, hinted, 2, 12).alias("__assign"),
        _found(t, ACCESS, 1, t.contains("AKIA")).alias("__access"),
        _found(t, HEX, 2, t.rlike(HEX)).alias("__hex"),
        _found(t, TOKEN, 3, t.rlike(TOKEN)).alias("__token"),
    )
    base = F.concat("__assign", "__access", "__hex")
    more = apart(F.filter("__token", lambda c: live_looking(c["value"])), F.col("__base"))
    return stored(rows.withColumn("__base", base).withColumn("__more", more).drop("__assign", "__access", "__hex", "__token"), "secrets")


def ownership(found: DataFrame, max_owners: int = MAX_OWNERS) -> DataFrame:
    """value_hash, n_repositories, n_owners, live: over all candidates of the corpus."""
    who = F.coalesce(F.concat(F.lit("="), "__owner"), F.lit(""))
    where = F.coalesce(F.concat(F.lit("="), "__repo"), F.lit(""))
    each = found.select(F.explode(F.concat("__base", "__more")).alias("c"), who.alias("__o"), where.alias("__r"))
    each = each.select(F.xxhash64("c.value").alias("value_hash"), live_looking(F.col("c.value")).alias("looks"), "__o", F.xxhash64("__o", "__r").alias("__r"))
    places = each.groupBy("value_hash", "__o", "__r").agg(F.max("looks").alias("looks"))
    owners = places.groupBy("value_hash", "__o").agg(F.count("*").alias("n"), F.max("looks").alias("looks"))
    total = owners.groupBy("value_hash").agg(F.sum("n").alias("n_repositories"), F.count("*").alias("n_owners"), F.max("looks").alias("looks"))
    return total.select("value_hash", "n_repositories", "n_owners", ((F.col("n_owners") <= max_owners) & F.col("looks")).alias("live"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repository: str = "doc_id", max_owners: int = MAX_OWNERS) -> DataFrame:
    """One row for each row of `docs`: counts, spans, and the live values of the text (`live_values`)."""
    found = candidates(docs, doc_id, text, owner, repository)
    owned = ownership(found, max_owners)
    each = found.select("doc_id", "__key", F.explode(F.concat(F.transform("__base", lambda s: s.withField("more", F.lit(False))), F.transform("__more", lambda s: s.withField("more", F.lit(True))))).alias("c"))
    each = each.withColumn("value_hash", F.xxhash64("c.value")).join(owned.filter("live").select("value_hash"), "value_hash")
    live = each.groupBy("doc_id", "__key").agg(
        F.collect_set(F.when(F.col("c.more"), F.struct("c.start", F.lit(3).alias("kind"), "c.end", "c.value"))).alias("__live"),
        F.collect_set("c.value").alias("live_values"),
    )
    live = live.withColumnsRenamed({"doc_id": "__id", "__key": "__k"})
    out = found.join(live, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__k")), "left")
    extra = F.coalesce("__live", F.array().cast(_SPAN))
    count = lambda kind: F.size(F.filter("__base", lambda s: s["kind"] == kind)).cast("long")
    return out.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined(F.col("__base")), 256).alias("base_sha256"),
        joined(F.concat(F.col("__base"), extra)).alias("spans"), F.size(extra).cast("long").alias("n_live_added"),
        F.coalesce("live_values", F.array().cast("array<string>")).alias("live_values"), F.col("__key").alias("text_key"),
    )


def redact(docs: DataFrame, mask: str = "[secret]", **options) -> DataFrame:
    """`docs` with the live values inside its texts replaced, longest first; null texts stay null."""
    found = scan(docs, **options).filter(F.size("live_values") > 0).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__k"), "live_values").dropDuplicates(["__id", "__k"])
    longest = F.array_sort(F.transform("live_values", lambda v: F.struct((-F.length(v)).alias("n"), v.alias("v"))))
    text = options.get("text", "text")
    clean = F.aggregate(longest, F.col(text), lambda t, v: F.replace(t, v["v"], F.lit(mask)))
    doc_id = options.get("doc_id", "doc_id")
    out = docs.join(found, F.col(doc_id).eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col("__k")), "left")
    return out.withColumn(text, F.when(F.col("live_values").isNull(), F.col(text)).otherwise(clean)).select(*docs.columns)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; a document is its own repository and its source the owner."""
    return scan(table(spark, sf_dir, "documents")).drop("live_values", "text_key")


def _sql_spans(pattern: str, kind: int, group: int = 0, least: int = 0) -> str:
    """DuckDB: the spans of a pattern, from the lengths of gaps and matches."""
    p = pattern.replace("'", "''").replace(r"\x20", " ")
    size = "lambda s: length(s)"
    gaps, hits, values = f"string_split_regex(t, '{p}')", f"regexp_extract_all(t, '{p}')", f"regexp_extract_all(t, '{p}', {group})"
    start = f"list_sum(list_transform(({gaps})[1:i], {size})) + coalesce(list_sum(list_transform(({hits})[1:i - 1], {size})), 0)"
    one = f"{{'start': CAST({start} AS INTEGER), 'kind': {kind}, 'e': CAST({start} + length(({hits})[i]) AS INTEGER), 'v': ({values})[i]}}"
    return f"list_filter(list_transform(range(1, len({hits}) + 1), lambda i: {one}), lambda s: length(s.v) >= {least})"


def _sql_joined(spans: str) -> str:
    return f"array_to_string(list_transform(list_sort(list_transform({spans}, lambda s: {{'a': s.start, 'b': s.kind, 'c': s.e}})), lambda s: (['{"', '".join(KINDS)}'])[s.b + 1] || ':' || s.a || ':' || s.c), ',')"


_SQL_LOOKS = f"(regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND len(list_distinct(string_split(v, ''))) >= {MIN_DISTINCT})"
#: The rows of op8 in DuckDB.
ORACLE_SQL = f"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, source, {_sql_spans(ASSIGN, 0, 2, 12)} AS a, {_sql_spans(ACCESS, 1)} AS k, {_sql_spans(HEX, 2)} AS h, {_sql_spans(TOKEN, 3)} AS x FROM d),
g AS (SELECT doc_id, source, a, k, h, list_concat(list_concat(a, k), h) AS base, x FROM f),
m AS (SELECT *, list_filter(x, lambda c: len(list_filter(base, lambda b: b.start < c.e AND c.start < b.e)) = 0) AS apart FROM g),
u AS (SELECT doc_id, source, c, c.v AS v, more FROM (SELECT doc_id, source, unnest(base) AS c, false AS more FROM m UNION ALL SELECT doc_id, source, unnest(apart), true FROM m)),
w AS (SELECT * FROM u WHERE NOT more OR {_SQL_LOOKS}),
live AS (SELECT v FROM w GROUP BY v HAVING count(DISTINCT coalesce('=' || source, '')) <= {MAX_OWNERS} AND bool_or{_SQL_LOOKS}),
extra AS (SELECT doc_id, list(DISTINCT {{'start': c.start, 'kind': 3, 'e': c.e, 'v': c.v}}) AS xs FROM w WHERE more AND v IN (SELECT v FROM live) GROUP BY doc_id)
SELECT m.doc_id, CAST(len(a) AS BIGINT) AS n_assign, CAST(len(k) AS BIGINT) AS n_access, CAST(len(h) AS BIGINT) AS n_hex, sha256({_sql_joined("base")}) AS base_sha256, {_sql_joined("CASE WHEN xs IS NULL THEN base ELSE list_concat(base, xs) END")} AS spans, CAST(coalesce(len(xs), 0) AS BIGINT) AS n_live_added
FROM m LEFT JOIN extra ON extra.doc_id = m.doc_id"""
