"""Resolution of not-modified revisit records in web archives.

A revisit record says that a server answered 304. It is resolved to the latest earlier
full response of the same canonical URL. Validators decide whether that response is
the one meant: a strong or weak entity tag where the revisit has one, else its
Last-Modified. The revisit's headers then update the stored ones, except those that
describe the stored body or one connection.

The as-of join is by windows on two levels. Time is cut at quantiles, so a group of
(URL, slice) holds about 1/slices of all rows at most even if one URL holds a third of
them. Within a slice the latest earlier response is a running maximum; where there is
none, the last response of earlier slices is carried over from one row a slice.
Bodies are never moved: a result names the record whose body it shares.

Defined cases. A revisit with a null or unusable URL or a null time is an orphan.
Responses with null times are ignored. Of several responses at one time the largest
record_id counts; a response at the revisit's own time is not earlier. A revisit
without validators, or whose response lacks the one it names: no_validator. Repeated
rows give repeated rows. Null headers are empty. Header names that differ in case only
are one header; its values are joined by ", " in the order of the spellings. Very long
URLs and values are kept whole. Extra columns, whatever their names, are ignored. Empty
tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calspark.llm.storage import materialize, partitions

NOT_MODIFIED = 304
#: Headers of a 304 that never replace the stored ones.
KEPT_FROM_STORED = (
    "connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "keep-alive", "proxy-authenticate",
    "proxy-authentication-info", "proxy-authorization", "proxy-connection", "set-cookie", "te", "trailer", "transfer-encoding", "upgrade",
)
#: Query parameters that only track.
TRACKING = "utm_[a-z]+|gclid|fbclid|sessionid|phpsessid|jsessionid"
UNRESERVED = "^[A-Za-z0-9._~-]"


def _percent(part: Column) -> Column:
    """Percent codes of unreserved characters decoded, the others in upper case."""

    def code(p: Column) -> Column:
        digits = F.substring(p, 1, 2)
        letter, rest = F.char(F.conv(digits, 16, 10).cast("int")), F.substring(p, 3, F.length(p))
        return F.when(~p.rlike("^[0-9A-Fa-f]{2}"), F.concat(F.lit("%"), p)).when(letter.rlike(UNRESERVED), F.concat(letter, rest)).otherwise(F.concat(F.lit("%"), F.upper(digits), rest))

    parts = F.split(part, "%", -1)
    return F.when(F.instr(part, "%") == 0, part).otherwise(F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), code), "")))


def _without_dots(path: Column) -> Column:
    """The path with its segments . and .. resolved."""

    def step(acc: Column, s: Column) -> Column:
        return F.when(s == ".", acc).when(s == "..", F.slice(acc, 1, F.greatest(F.lit(1), F.size(acc) - 1))).otherwise(F.array_append(acc, s))

    done = F.aggregate(F.split(path, "/", -1), F.array().cast("array<string>"), step)
    return F.when(F.instr(path, "/.") == 0, path).otherwise(F.array_join(done, "/"))


def canonical_url(url: Column) -> Column:
    """Scheme, user, www., default port, fragment, tracking parameters and a trailing slash go; host in lower case; percent codes and dot segments normalised; parameters sorted. Null if unusable."""
    part = lambda n: F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?", n)
    host = F.regexp_replace(F.lower(part(2)), r"^www\.", "")
    port = F.when(part(3).isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), part(3)))
    path = F.regexp_replace(_without_dots(_percent(part(4))), "/+$", "")
    kept = F.array_sort(F.filter(F.split(_percent(part(5)), "&"), lambda p: (p != "") & ~F.lower(p).rlike(f"^({TRACKING})=")))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(F.length(host) > 0, F.concat(host, port, path, query))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def lower_names(headers: Column) -> Column:
    """A header map with names in lower case; values of names that differ in case only are joined."""
    entries = F.array_sort(F.map_entries(headers))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))

    def one(name: Column) -> Column:
        same = F.filter(entries, lambda e: F.lower(e["key"]) == name)
        value = F.when(F.size(same) == 1, same[0]["value"]).otherwise(F.array_join(F.transform(same, lambda e: e["value"]), ", "))
        return F.struct(name.alias("key"), value.alias("value"))

    return F.map_from_entries(F.transform(names, one))


def merged_headers(stored: Column, fresh: Column) -> Column:
    """Header maps with lower-case names: the fresh ones win unless they are KEPT_FROM_STORED."""
    permitted = F.map_filter(fresh, lambda k, v: ~k.isin(*KEPT_FROM_STORED))
    untouched = F.map_filter(stored, lambda k, v: ~F.map_contains_key(permitted, k))
    return F.map_concat(untouched, permitted)


def header_lines(headers: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def resolve_revisits(records: DataFrame, slices: int | None = None) -> DataFrame:
    """One row a revisit: record_id, canonical_url, refers_to, refers_ts, verdict (matched, mismatch, no_validator, orphan), headers (map).

    ``records``: record_id long, url string, ts long, status int, etag, last_modified string, headers map<string,string>.
    """
    spark = records.sparkSession
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    lowered = lower_names(F.coalesce("headers", none))
    rows = records.select(
        F.col("record_id").cast("long"), canonical_url(F.col("url").cast("string")).alias("key"), F.col("ts").cast("long"), F.col("status").cast("int"),
        F.col("etag").cast("string"), F.col("last_modified").cast("string"), lowered.alias("headers"),
    ).where("status = 304 or (status between 200 and 299 and ts is not null and key is not null)")
    rows = materialize(rows, "warc")
    count = slices or max(16, partitions(spark))
    cuts = sorted(set(rows.approxQuantile("ts", [k / count for k in range(1, count)], 0.25 / count))) if count > 1 else []
    slice_of = F.size(F.filter(F.array(*[F.lit(int(c)) for c in cuts]), lambda c: c <= F.col("ts"))) if cuts else F.lit(0)
    full = F.col("status") != NOT_MODIFIED
    payload = F.when(full, F.struct("record_id", "ts", "etag", "last_modified", "headers"))
    order = F.when(full, F.struct("ts", "record_id"))
    dated = rows.where("key is not null and ts is not null").withColumn("slice", slice_of.cast("int")).withColumn("payload", payload).withColumn("order", order)
    earlier = Window.partitionBy("key", "slice").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    within = dated.withColumn("found", F.max_by("payload", "order").over(earlier)).where(~full)
    lasts = dated.where(full).groupBy("key", "slice").agg(F.max_by("payload", "order").alias("last"))
    # one row a slice and URL: the carry runs over at most ``count`` rows a URL
    asked = within.where("found is null").select("key", "slice").distinct()
    steps = lasts.select("key", "slice", "last").unionByName(asked.withColumn("last", F.lit(None).cast(lasts.schema["last"].dataType)))
    carry = steps.groupBy("key", "slice").agg(F.max_by("last", F.col("last.ts")).alias("last"))
    carry = carry.withColumn("carried", F.last("last", True).over(Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))).select("key", "slice", "carried")
    joined = within.join(carry, ["key", "slice"], "left").withColumn("hit", F.coalesce("found", "carried"))
    lost = rows.where("status = 304 and (key is null or ts is null)").withColumn("hit", F.lit(None).cast(joined.schema["hit"].dataType))
    columns = ["record_id", "key", "etag", "last_modified", "headers", "hit"]
    both = joined.select(*columns).unionByName(lost.select(*columns))
    verdict = (
        F.when(F.col("hit").isNull(), "orphan")
        .when(F.col("etag").isNotNull() & F.col("hit.etag").isNotNull(), F.when(_weak(F.col("etag")) == _weak(F.col("hit.etag")), "matched").otherwise("mismatch"))
        .when(F.col("etag").isNull() & F.col("last_modified").isNotNull() & F.col("hit.last_modified").isNotNull(), F.when(F.col("last_modified") == F.col("hit.last_modified"), "matched").otherwise("mismatch"))
        .otherwise("no_validator")
    )
    both = both.withColumn("verdict", verdict)
    merged = F.when(F.col("verdict") == "matched", merged_headers(F.col("hit.headers"), F.col("headers"))).otherwise(F.col("headers"))
    return both.select("record_id", F.col("key").alias("canonical_url"), F.col("hit.record_id").alias("refers_to"), F.col("hit.ts").alias("refers_ts"), "verdict", merged.alias("headers"))


def archive_of(pages: DataFrame) -> DataFrame:
    """Records of an archive that crawled every page and later asked for it again.

    The page is a full response at time 10 * page_id. It is asked for again at 10 *
    page_id + 25 by a variant of its URL, with its tag (weak in every third page), a
    tag of another version (every seventh), only a date (every fifth) or nothing (every
    eleventh); pages whose id ends in 9 are asked for before they were seen.
    """
    tag = F.concat(F.lit('"'), F.md5(F.coalesce(F.col("html").cast("string"), F.lit(""))), F.lit('"'))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), tag.alias("tag"))
    date = F.concat(F.lit("day "), (F.col("page_id") % 1000).cast("string"))
    header = lambda *pairs: F.map_from_arrays(F.array(*[F.lit(k) for k, _ in pairs]), F.array(*[v for _, v in pairs]))
    n = F.col("page_id")
    response = p.select(
        (2 * n).alias("record_id"), "url", (10 * n).alias("ts"), F.lit(200).alias("status"), F.col("tag").alias("etag"), date.alias("last_modified"),
        header(("Content-Type", F.lit("text/html")), ("Cache-Control", F.lit("max-age=60")), ("Date", F.concat(F.lit("t"), (10 * n).cast("string")))).alias("headers"),
    )
    asked = (10 * n + F.when(n % 10 == 9, -5).otherwise(25)).cast("long")
    etag = F.when(n % 11 == 0, None).when(n % 7 == 0, F.concat(F.lit('"'), F.md5(n.cast("string")), F.lit('"'))).when(n % 5 == 0, None).when(n % 3 == 0, F.concat(F.lit("W/"), F.col("tag"))).otherwise(F.col("tag"))
    revisit = p.select(
        (2 * n + 1).alias("record_id"), F.concat(F.regexp_replace(F.regexp_replace("url", "^https?", "HTTP"), "#.*$", ""), F.lit("#again")).alias("url"), asked.alias("ts"), F.lit(NOT_MODIFIED).alias("status"),
        etag.alias("etag"), F.when((n % 5 == 0) & (n % 11 != 0), date).alias("last_modified"),
        header(("content-type", F.lit("text/plain")), ("date", F.concat(F.lit("t"), asked.cast("string")))).alias("headers"),
    )
    return response.unionByName(revisit)


def op1_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_revisits(archive_of(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return found.withColumn("headers", header_lines(F.col("headers")))


_KEY = r"""
case when length(h) > 0 then h || case when port in ('', '80', '443') then '' else ':' || port end || regexp_replace(list_aggregate(segments, 'string_agg', '/'), '/+$', '') ||
  case when len(q) > 0 then '?' || array_to_string(list_sort(q), '&') else '' end end"""
_PARTS = r"'^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?'"


def _percent_sql(part: str) -> str:
    letter = "chr(cast('0x' || p[1:2] as int))"
    code = f"case when not regexp_matches(p, '^[0-9A-Fa-f]{{2}}') then '%' || p when regexp_matches({letter}, '{UNRESERVED}') then {letter} || p[3:] else '%' || upper(p[1:2]) || p[3:] end"
    return f"(string_split({part}, '%')[1] || array_to_string(list_transform(string_split({part}, '%')[2:], lambda p: {code}), ''))"


_SEGMENTS = f"""list_reduce(list_transform(string_split({_percent_sql(f"regexp_extract(url, {_PARTS}, 4)")}, '/'), lambda x: [x]),
  lambda a, x: case when x[1] = '.' then a when x[1] = '..' then a[1:greatest(1, len(a) - 1)] else list_concat(a, x) end)"""

QUERIES = {"op1_warc_revisit": op1_warc_revisit}
ORACLES = {
    "op1_warc_revisit": rf"""
with p as (select page_id n, '"' || md5(coalesce(html, '')) || '"' tag, 'day ' || (page_id % 1000) d,
  regexp_replace(lower(regexp_extract(url, {_PARTS}, 2)), '^www\.', '') h, regexp_extract(url, {_PARTS}, 3) port, {_SEGMENTS} segments,
  list_filter(string_split({_percent_sql(f"regexp_extract(url, {_PARTS}, 5)")}, '&'), lambda x: x <> '' and not regexp_matches(lower(x), '^({TRACKING})=')) q from pages),
r as (select n, tag, d, {_KEY} k, 10 * n t from p),
v as (select *, 10 * n + case when n % 10 = 9 then -5 else 25 end rt,
  case when n % 11 = 0 then null when n % 7 = 0 then '"' || md5(cast(n as varchar)) || '"' when n % 5 = 0 then null else tag end et,
  case when n % 5 = 0 and n % 11 <> 0 then d end lm from r),
j as (select v.*, r.n rn, r.t rts, r.tag rtag, r.d rd from v asof left join r on v.k = r.k and v.rt > r.t),
w as (select *, case when rn is null then 'orphan' when et is not null then case when et = rtag then 'matched' else 'mismatch' end
  when lm is not null then case when lm = rd then 'matched' else 'mismatch' end else 'no_validator' end verdict from j)
select 2 * n + 1 record_id, k canonical_url, 2 * rn refers_to, rts refers_ts, verdict,
  case when verdict = 'matched' then 'cache-control: max-age=60' || chr(10) || 'content-type: text/html' || chr(10) || 'date: t' || rt
  else 'content-type: text/plain' || chr(10) || 'date: t' || rt end headers from w
"""
}
