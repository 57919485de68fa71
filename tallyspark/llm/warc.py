"""Not-modified revisits of a web archive: an as-of join to the latest earlier full response of the same page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyspark.session import stored

# Headers that a not-modified answer may replace in the stored response.
UPDATED_HEADERS = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
# Query parameters that only track where a reader came from.
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid)"
BLOCK = 4096  # units of time; the captures of one page in so long a time are ordered together


def canonical_url(url: Column) -> Column:
    """Scheme, ``www.`` or ``m.``, fragment, tracking parameters and a last slash do not tell pages apart."""
    text = F.regexp_replace(F.trim(url), r"#.*$", "")
    text = F.regexp_replace(text, r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(text, r"^([^/?]*)", 1)), r"^(?:www|m)\.|:(?:80|443)$", "")
    rest = F.regexp_replace(text, r"^[^/?]*", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^([^?]*)", 1), r"/+$", "")
    query = F.filter(
        F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(f"^{TRACKING}(?:=|$)")
    )
    joined = F.array_join(F.array_sort(query), "&")
    return F.concat(host, path, F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise(""))


def latest_before(records: DataFrame) -> DataFrame:
    """``records`` with ``base``: the capture number of the latest earlier full response of the same page.

    ``records`` has ``page, at, capture`` and ``full``. The captures of a page are cut into blocks of time: the
    last full response of each block is found by an aggregate and handed to the later blocks over one row per
    block, and only a block is ordered in one place. A page with any number of captures is spread over its blocks.
    """
    blocked = records.withColumn("block", F.floor(F.col("at") / BLOCK))
    point = F.struct("at", "capture")
    last = blocked.where("full").groupBy("page", "block").agg(F.max(point).alias("last"))
    # the block of a record takes what the blocks before it hold
    blocks = blocked.select("page", "block").distinct().join(last, ["page", "block"], "left")
    before = Window.partitionBy("page").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    handed = blocks.select("page", "block", F.last("last", ignorenulls=True).over(before).alias("handed"))
    inside = Window.partitionBy("page", "block").orderBy("at", "capture").rowsBetween(Window.unboundedPreceding, -1)
    own = F.last(F.when(F.col("full"), point), ignorenulls=True).over(inside)
    placed = blocked.withColumn("own", own).join(handed, ["page", "block"], "left")
    return placed.withColumn("base", F.coalesce("own", "handed").getField("capture")).drop("own", "handed", "block")


def merged_headers(stored_headers: Column, fresh: Column) -> Column:
    """The stored headers with those that a not-modified answer may replace."""
    allowed = F.map_filter(fresh, lambda name, value: name.isin(UPDATED_HEADERS) & value.isNotNull())
    return F.map_concat(F.map_filter(stored_headers, lambda name, _: ~F.map_contains_key(allowed, name)), allowed)


def resolve(records: DataFrame) -> DataFrame:
    """One row per revisit: what it refers to, and its headers.

    ``records`` has ``capture`` (a number of its own), ``url``, ``at`` (a time as a number), ``status`` (304 for a
    revisit, 200 for a full response, others are neither), ``headers`` (a map of lower-case names) and
    ``digest``. Returns ``capture, page, base, outcome, digest, headers``:

    * ``resolved``: the latest earlier full response of the page has the revisit's ``etag``, or, if the revisit has
      none, its ``last-modified``; ``digest`` is that response's, ``headers`` are merged;
    * ``changed``: there is one, but its validator differs or is missing;
    * ``unvalidated``: there is one, but the revisit carries no validator;
    * ``missing``: there is none, or the revisit has no URL or time.

    A response at the same time is earlier if its capture number is smaller. Only ``resolved`` rows have a digest and
    merged headers; the others keep their own headers. Rows that are repeated count once.
    """
    rows = stored(
        records.select(
            F.col("capture").cast("long").alias("capture"),
            canonical_url(F.col("url")).alias("page"),
            F.col("at").cast("long").alias("at"),
            F.col("status").cast("int").alias("status"),
            F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"),
            F.col("digest"),
        )
        .where("capture IS NOT NULL AND status IN (200, 304)"),
        "captures",
    )
    placed = rows.where("page IS NOT NULL AND at IS NOT NULL").groupBy("page", "at", "capture")
    placed = latest_before(placed.agg(F.max(F.col("status") == 200).alias("full")))
    bases = stored(placed.where("NOT full").select("capture", "base"), "bases")
    full = rows.where("status = 200").dropDuplicates(["capture"])
    full = stored(full.select(F.col("capture").alias("base"), F.col("headers").alias("h"), F.col("digest").alias("d")), "full")
    revisits = rows.where("status = 304").dropDuplicates(["capture"]).drop("digest", "at", "status")
    joined = revisits.join(bases, "capture", "left").join(full, "base", "left")
    etag, modified = F.col("headers")["etag"], F.col("headers")["last-modified"]
    same = F.when(etag.isNotNull(), etag == F.col("h")["etag"]).otherwise(modified == F.col("h")["last-modified"])
    outcome = (
        F.when(F.col("base").isNull(), "missing")
        .when(etag.isNull() & modified.isNull(), "unvalidated")
        .when(same, "resolved")
        .otherwise("changed")
    )
    done = F.col("outcome") == "resolved"
    return joined.withColumn("outcome", outcome).select(
        "capture",
        "page",
        "base",
        "outcome",
        F.when(done, F.col("d")).alias("digest"),
        F.when(done, merged_headers(F.col("h"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"),
    )
