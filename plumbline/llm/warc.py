"""Not-modified revisit records of web archives, resolved to the full responses they stand for.

Each revisit takes the latest earlier full response of the same canonical URL, if its validators agree, and its headers
with those that a not-modified answer may replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import cut

#: Headers that a 304 answer may update (RFC 9110, 15.4.5), and query parameters that name no other page.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
TRACKING = r"([?&])(utm_[A-Za-z0-9_]*|ref)=[^&]*"
#: Time slices in which the captures of one URL are matched apart from each other.
SLICES = 256

HEADERS = "array<struct<name string, value string>>"


def canonical(url: Column) -> Column:
    """A URL without scheme, www, default port, fragment, tracking parameters and final slash; the host in lower case."""
    plain = F.regexp_replace(F.regexp_replace(url, "(?s)#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_extract(plain, "^[^/?]*", 0)
    rest = F.substring(plain, F.length(host) + 1, F.length(plain))
    host = F.regexp_replace(F.regexp_replace(F.lower(host), r"^www\.", ""), ":(80|443)$", "")
    rest = F.regexp_replace(F.regexp_replace(rest, TRACKING, "$1"), "&&+", "&")
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, r"\?&", "?"), "[?&]+$", ""), "/$", "")
    return F.concat(host, rest)


def header(headers: Column, name: str) -> Column:
    """The first value of a header, by its lower-case name."""
    return F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name), F.lit(0))["value"]


def latest_before(responses: DataFrame, revisits: DataFrame) -> DataFrame:
    """``uid, target``: for each revisit the latest response of its key with a smaller time, if there is one.

    Both have ``uid`` (unique), ``record_id, key, ts``; the result is ``uid, target``, a uid too. Captures of a key are cut into time slices: a slice is matched on its own, and what
    it starts with comes from one row for each earlier slice, so no task needs all captures of a hot key.
    """
    none = F.lit(None).cast("long")
    events = responses.select("key", "ts", "record_id", F.col("uid").alias("response"), none.alias("revisit"))
    events = events.unionByName(
        revisits.select("key", "ts", none.alias("record_id"), none.alias("response"), F.col("uid").alias("revisit"))
    ).filter("key IS NOT NULL AND ts IS NOT NULL")
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    width = ((last or 0) - (first or 0)) // SLICES + 1
    sliced = events.withColumn("slice", F.floor((F.col("ts") - F.lit(first or 0)) / F.lit(width)).cast("int"))
    place = F.when(F.col("response").isNotNull(), F.struct("ts", "record_id", "response"))
    inside = Window.partitionBy("key", "slice").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    near = sliced.withColumn("near", F.max(place).over(inside)).filter("revisit IS NOT NULL")
    ends = sliced.groupBy("key", "slice").agg(F.max(place).alias("end"))
    earlier = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select(F.col("key").alias("k"), F.col("slice").alias("s"), F.max("end").over(earlier).alias("far"))
    found = near.join(starts.filter("far IS NOT NULL"), (F.col("key") == F.col("k")) & (F.col("slice") == F.col("s")), "left")
    target = F.coalesce("near", "far")["response"]
    return found.select(F.col("revisit").alias("uid"), target.alias("target")).filter("target IS NOT NULL")


def agree(own: Column, full: Column) -> Column:
    """Whether the validators of a revisit name a response: the entity tag, compared weakly, else the modification date."""
    tag = lambda h: F.regexp_replace(header(h, "etag"), "^W/", "")
    by_date = header(own, "last-modified") == header(full, "last-modified")
    same = F.when(tag(own).isNotNull(), tag(own) == tag(full)).otherwise(by_date)
    return F.coalesce(same, F.lit(False))


def merged(full: Column, own: Column) -> Column:
    """The headers of a response, those that a 304 may update replaced by those of the revisit."""
    may = F.filter(own, lambda h: F.lower(h["name"]).isin(*PERMITTED))
    names = F.transform(may, lambda h: F.lower(h["name"]))
    return F.concat(F.filter(full, lambda h: ~F.array_contains(names, F.lower(h["name"]))), may)


def resolve(records: DataFrame) -> DataFrame:
    """One row for each record: ``record_id, key, state, target, headers, payload_bytes, payload_sha256``.

    Records have ``record_id``, ``url``, ``ts`` (a long), ``kind`` ('response' or 'revisit'), ``status``,
    ``headers`` (an array of name and value) and ``payload``; other columns are left aside. Responses of status 200 are
    full. ``state``: 'full', 'other' (any other response), 'resolved', 'mismatch' (validators differ or are missing) or
    'no_response' (none earlier, or no url or ts). Of responses at one time the greatest record_id counts; a response at the
    very time of a revisit is not earlier. Repeated records count each: every one gives its row, and of repeated responses one
    is the target. Null headers count as none. An empty table gives no row.
    """
    headers = F.filter(F.coalesce(F.col("headers"), F.array().cast(HEADERS)), lambda h: h["name"].isNotNull())
    rows = cut(
        records.select(
            F.monotonically_increasing_id().alias("uid"),  # kept as it is in the written rows
            F.col("record_id").cast("long").alias("record_id"),
            canonical(F.col("url")).alias("key"),
            F.col("ts").cast("long").alias("ts"),
            (F.col("kind") == "revisit").alias("revisit"),
            ((F.col("kind") == "response") & (F.col("status") == 200)).alias("full"),
            headers.alias("headers"),
            F.octet_length("payload").cast("long").alias("payload_bytes"),
            F.sha2(F.col("payload"), 256).alias("payload_sha256"),
        )
    )
    revisits = rows.filter("revisit")
    full = rows.filter("full")
    targets = latest_before(full, revisits)
    of = full.select(
        F.col("uid").alias("target"),
        F.col("record_id").alias("full_id"),
        F.col("headers").alias("full_headers"),
        F.col("payload_bytes").alias("full_bytes"),
        F.col("payload_sha256").alias("full_sha256"),
    )
    matched = revisits.select("uid", "record_id", "key", "headers").join(targets, "uid", "left").join(of, "target", "left")
    ok = F.col("target").isNotNull() & agree(F.col("headers"), F.col("full_headers"))
    state = F.when(F.col("target").isNull(), "no_response").when(ok, "resolved").otherwise("mismatch")
    resolved = matched.select(
        "record_id",
        "key",
        state.alias("state"),
        F.col("full_id").alias("target"),
        F.when(ok, merged(F.col("full_headers"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"),
        F.when(ok, F.col("full_bytes")).alias("payload_bytes"),
        F.when(ok, F.col("full_sha256")).alias("payload_sha256"),
    )
    others = rows.filter("revisit IS NULL OR NOT revisit").select(
        "record_id",
        "key",
        F.when(F.col("full"), "full").otherwise("other").alias("state"),
        F.lit(None).cast("long").alias("target"),
        "headers",
        "payload_bytes",
        "payload_sha256",
    )
    return others.unionByName(resolved)
