"""Web archive captures: not-modified revisits resolved to the latest earlier full response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.operators.graph import with_ranges

#: Headers of a 304 answer that replace those of the stored response (a 304 may not restate the others).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that don't name a resource.
DROPPED = ("utm_", "ref=", "sessionid=", "fbclid=", "gclid=")
ROWS = 4096


def canonical(url: Column) -> Column:
    """Host and path without scheme, default port, www, fragment, trailing slash and tracking parameters, which are sorted."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    rest = F.regexp_replace(u, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, "^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, ":(80|443)$", ""), r"^www[0-9]*\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(rest, r"^[^?]*\?(.*)$", 1)
    keep = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike("^(" + "|".join(DROPPED) + ")"))
    query = F.array_join(F.array_sort(keep), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _lowered(headers: Column) -> Column:
    """Names in lower case; of several that differ in case the last stands."""
    entries = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    names = F.transform(entries, lambda e: F.lower(e["key"]))
    last = F.filter(F.transform(entries, lambda e, i: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"), i.alias("i"))), lambda e: e["i"] == F.size(names) - F.array_position(F.reverse(names), e["key"]))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"])))


def resolve(records: DataFrame, rows: int = ROWS) -> DataFrame:
    """Per record: record_id, url_key, kind, resolution, source_id, payload_digest, headers.

    records: record_id, url, ts (long), kind ('response' or 'revisit'), headers (map), payload_digest. A revisit refers to the
    latest response of its canonical URL that is earlier by (ts, record_id); of captures that agree in both, responses come before revisits, and several
    responses in the order of their digests. Its validators are then checked: the
    weak comparison of ETags if both have one, else Last-Modified if both have that, else nothing to compare. Headers
    are those of the response, with the permitted ones of the revisit over them.
    resolution: 'response'; 'resolved'; 'mismatch' (a validator differs: no source is taken); 'unvalidated' (nothing to
    compare: the source is taken); 'missing' (no earlier response). Unmatched revisits keep their own headers and digest.
    Null URLs never match; null times come first; null kinds are passed on as they are; repeated rows are resolved alike;
    an empty table gives an empty one; other columns are ignored.

    The as-of join runs in blocks of time: within a block by a window, and from earlier blocks by the last response of
    each, so that a URL with very many captures, or none at all, is spread over tasks. The blocks are ranges of (ts, record_id) that about
    `rows` rows share (more where there would be over 16,384 blocks), however unevenly times are spread; rows equal in both are told apart by their URLs.
    """
    narrow = records.select("record_id", "url", F.col("ts").cast("long").alias("ts"), "kind", "headers", "payload_digest")
    keyed = with_ranges(narrow, ["ts", "record_id"], rows, ["record_id", "url"]).withColumnRenamed("_range", "_b").drop("_order")
    keyed = keyed.select("record_id", canonical(F.col("url")).alias("url_key"), "ts", "kind", _lowered(F.col("headers")).alias("headers"), "payload_digest", "_b")
    full = F.when(F.col("kind") == "response", F.struct("record_id", "headers", "payload_digest"))
    strictly = Window.partitionBy("url_key", "_b").orderBy("ts", "record_id", "kind", "payload_digest").rowsBetween(Window.unboundedPreceding, -1)
    inside = keyed.withColumn("_in", F.last(full, ignorenulls=True).over(strictly))
    key = F.struct("ts", "record_id", "payload_digest")
    ends = keyed.where("kind = 'response'").groupBy("url_key", "_b").agg(F.max_by(F.struct("record_id", "headers", "payload_digest"), key).alias("_last"))
    blocks = keyed.groupBy("url_key", "_b").agg(F.lit(1).alias("_x")).drop("_x").join(ends, ["url_key", "_b"], "left")
    earlier = Window.partitionBy("url_key").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("url_key", "_b", F.last("_last", ignorenulls=True).over(earlier).alias("_carry"))
    joined = inside.join(carried, ["url_key", "_b"], "left")
    source = F.when(F.col("url_key").isNotNull() & (F.col("kind") == "revisit"), F.coalesce("_in", "_carry"))
    joined = joined.withColumn("_s", source)
    weak = lambda c: F.regexp_replace(F.trim(c), "^[Ww]/", "")
    own_tag, its_tag = weak(F.col("headers")["etag"]), weak(F.col("_s.headers")["etag"])
    own_time, its_time = F.trim(F.col("headers")["last-modified"]), F.trim(F.col("_s.headers")["last-modified"])
    same = F.coalesce(own_tag == its_tag, own_time == its_time)
    resolution = (
        F.when(F.col("kind") == "response", "response").when(F.col("kind").isNull() | (F.col("kind") != "revisit"), F.col("kind"))
        .when(F.col("_s").isNull(), "missing").when(same.isNull(), "unvalidated").when(same, "resolved").otherwise("mismatch")
    )
    taken = F.col("resolution").isin("resolved", "unvalidated")
    permitted = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(F.col("_s.headers"), lambda k, v: ~F.map_contains_key(permitted, k)), permitted)
    out = joined.withColumn("resolution", resolution)
    return out.select(
        "record_id", "url_key", "kind", "resolution", F.when(taken, F.col("_s.record_id")).alias("source_id"),
        F.when(taken, F.col("_s.payload_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.when(taken, merged).otherwise(F.col("headers")).alias("headers"),
    )


def header_lines(headers: Column) -> Column:
    """name: value lines by name."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")


def captures(pages: DataFrame) -> DataFrame:
    """A crawl history made of pages: from one to five captures each, told by the id's checksum, in rounds.

    Round 0 brings a full response (one page in sixteen is only asked whether it has changed, with nothing stored), round 3
    a response of the next version, the others not-modified answers under other spellings of the URL. The
    length of the HTML mod 3 is the version; it makes the ETag, which pages with ids divisible by 7 lack, and Last-Modified,
    which version 1 lacks. One answer in four carries the next version's validators. Payloads are named by SHA-256.
    """
    digit = F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(F.col("page_id").cast("string")), 1, 1)) - 1
    rows = pages.withColumn("_d", digit).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_d") % 5)))
    i, d = F.col("_i"), F.col("_d")
    full = ((i == 0) & (d != 7)) | (i == 3)
    later = F.when(full, (i == 3).cast("int")).otherwise((((d + i) % 4 == 0) != (i > 3)).cast("int"))
    version = ((F.length("html") + later) % 3).cast("string")
    url, bare = F.col("url"), F.regexp_replace("url", "#.*$", "")
    spelled = (
        F.when(i == 1, F.regexp_replace(url, "^http:", "https:")).when(i == 2, F.concat(url, F.lit("#again")))
        .when(i == 3, F.concat(bare, F.when(bare.contains("?"), "&").otherwise("?"), F.lit("utm_campaign=x"))).otherwise(url)
    )
    pair = lambda name, value: F.struct(F.lit(name).alias("key"), value.alias("value"))
    pairs = F.array(
        pair("ETag", F.when(F.col("page_id") % 7 != 0, F.concat(F.when(full, "").otherwise("W/"), F.lit('"v'), version, F.lit('"')))),
        pair("Last-Modified", F.when(version != "1", F.concat(F.lit("day "), version))), pair("Date", F.concat(F.lit("round "), i.cast("string"))),
        pair("Content-Length", F.when(full, F.octet_length("html").cast("string")).otherwise("0")), pair("Content-Type", F.when(full, "text/html")),
    )
    headers = F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull()))
    return rows.select(
        (F.col("page_id") * 8 + i).alias("record_id"), spelled.alias("url"), (i.cast("long") * 1_000_000_000_000 + F.col("page_id")).alias("ts"), F.when(full, "response").otherwise("revisit").alias("kind"),
        headers.alias("headers"), F.when(full, F.sha2(F.when(i == 3, F.concat("html", F.lit("+"))).otherwise(F.col("html")), 256)).alias("payload_digest"),
    )
