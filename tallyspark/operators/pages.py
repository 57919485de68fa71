"""Operators over page tables ``pages(doc_id, page_num, page_content)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyspark import fixed
from tallyspark.functions.page_kinds import page_kind, page_use
from tallyspark.functions.text import let, snippet, strip


OFFSET_BLOCK = 256


def page_offsets(pages: DataFrame) -> DataFrame:
    """Start and end offset of every page in its document's joined text.

    Only page numbers and lengths cross the shuffle, never the text. Sums run over blocks of pages first, so a
    document of any length is spread over as many groups as it has blocks.
    """
    slim = pages.select(
        "doc_id",
        "page_num",
        F.expr(f"page_num div {OFFSET_BLOCK}").alias("_block"),
        F.length(F.coalesce("page_content", F.lit(""))).cast("bigint").alias("_n"),
    )
    earlier = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    blocks = slim.groupBy("doc_id", "_block").agg(F.sum(F.col("_n") + 1).alias("_size"))
    starts = blocks.select(
        "doc_id",
        "_block",
        F.coalesce(F.sum("_size").over(earlier("doc_id").orderBy("_block")), F.lit(0)).alias("_base"),
    )
    inside = F.coalesce(F.sum(F.col("_n") + 1).over(earlier("doc_id", "_block").orderBy("page_num")), F.lit(0))
    start = F.col("_base") + F.col("_inside")
    return (
        slim.withColumn("_inside", inside)
        .join(starts, ["doc_id", "_block"])
        .select("doc_id", "page_num", start.alias("start"), (start + F.col("_n")).alias("end"))
    )


def search_pages(pages: DataFrame, query: str) -> DataFrame:
    """Pages that contain the query, ignoring case; a blank query finds nothing."""
    needle = query.strip().lower()
    hit = F.lower("page_content").contains(needle) if needle else F.lit(False)
    return pages.where(hit).select(
        "doc_id", "page_num", snippet(F.col("page_content"), fixed.SEARCH_CHARS).alias("snippet")
    )


def outline_pages(pages: DataFrame) -> DataFrame:
    """One line per page: its kind, what to do with it, and how it begins."""
    text = F.coalesce("page_content", F.lit(""))
    return pages.select("doc_id", "page_num", page_kind(text).alias("kind"), text.alias("_t")).select(
        "doc_id",
        "page_num",
        "kind",
        page_use(F.col("kind")).alias("use"),
        snippet(F.col("_t"), fixed.OUTLINE_CHARS).alias("snippet"),
    )


def read_pages(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """Requested pages in requested order; ``requests(doc_id, page_nums array<int>)``.

    ``status`` tells a page that does not exist (``missing``) from one without text (``blank``).
    """
    wanted = requests.select("doc_id", F.posexplode("page_nums").alias("pos", "page_num"))
    found = pages.select("doc_id", "page_num", strip(F.coalesce("page_content", F.lit(""))).alias("body"))
    return wanted.join(found, ["doc_id", "page_num"], "left").select(
        "doc_id",
        "pos",
        "page_num",
        F.when(F.col("body").isNull(), "missing").when(F.col("body") == "", "blank").otherwise("text").alias("status"),
        F.when(F.col("body").isNull(), fixed.PAGE_MISSING)
        .when(F.col("body") == "", fixed.PAGE_BLANK)
        .otherwise(F.col("body"))
        .alias("body"),
    )


def route_documents(pages: DataFrame, max_pages: int | None = fixed.MAX_PAGES) -> DataFrame:
    """Decide per document between text extraction, visual extraction and rejection.

    Expects ``n_images`` and ``image_area_ratio`` per page. Counts and flags are combined before the shuffle.
    Pages are counted, whatever their numbers; a document of more than ``max_pages`` is rejected and lists none.
    """
    text = strip(F.coalesce("page_content", F.lit("")))
    has_images = F.coalesce(F.col("n_images") > 0, F.lit(False))
    visual = has_images & (
        (F.length(text) < fixed.MIN_CHARS_ON_IMAGE_PAGE)
        | (F.coalesce("image_area_ratio", F.lit(0.0)) >= fixed.MIN_IMAGE_AREA_RATIO)
    )
    marked = pages.select(
        "doc_id", "page_num", visual.alias("visual"), (text != "").alias("filled")
    )
    per_document = marked.groupBy("doc_id").agg(
        F.count("page_num").alias("n_pages"),
        F.count_if("filled").alias("n_filled"),
        F.sort_array(F.collect_list(F.when(F.col("visual"), F.col("page_num")))).alias("_visual"),
        F.sort_array(F.collect_list("page_num")).alias("_all"),
    )
    none = F.array().cast("array<int>")
    route = (
        F.when(F.col("n_pages") == 0, "reject_empty")
        .when(F.lit(False) if max_pages is None else F.col("n_pages") > max_pages, "reject_too_long")
        .when((F.col("n_filled") == 0) | (F.size("_visual") > 0), "visual")
        .otherwise("text")
    )
    return per_document.select(
        "doc_id",
        "n_pages",
        "n_filled",
        route.alias("route"),
        F.when(route != "visual", none)
        .when(F.col("n_filled") == 0, F.col("_all"))
        .otherwise(F.col("_visual"))
        .alias("visual_pages"),
    )
