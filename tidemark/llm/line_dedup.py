"""Boilerplate lines by their frequency on a site.

Lines are counted once per page and host with map-side combining; a host's pages
are never gathered. The boilerplate of a host is a small set: with at most L
lines on a page on average, fewer than ``L / max_ratio`` lines can be on more than
``max_ratio`` of the pages. These sets are written as a table, so Spark knows their
size and broadcasts them when they are small; otherwise a hot host's pages are
split by the skew handling of the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import filled
from tidemark.session import snapshot

# Elements that are no text, and elements that start a new line (HTML).
UNSEEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
BLOCKS = (
    r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre"
    r"|section|table|tbody|td|tfoot|th|thead|title|tr|ul)\b[^>]*>"
)
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host_of(url: Column | str) -> Column:
    """The lower-case host of a URL; empty where there is none."""
    return F.lower(F.regexp_extract(filled(url), HOST, 1))


def page_text(html: Column | str) -> Column:
    """The text of a page with a line per block element."""
    flat = F.regexp_replace(filled(html), r"[\x20\x09-\x0D]+", " ")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(flat, UNSEEN, " "), BLOCKS, "\n"), r"<[^>]*>", "")


def lines_of(text: Column) -> Column:
    """Trimmed lines with single blanks, without empty ones."""
    return F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.trim(F.regexp_replace(x, " +", " "))), lambda x: x != "")


def drop_site_boilerplate(
    pages: DataFrame, host: Column, text: Column, id_col: str = "page_id", *, max_ratio: float = 0.25, min_pages: int = 3
) -> DataFrame:
    """One row per page: ``page_id``, ``host``, ``n_lines``, ``n_dropped``, ``text`` (the lines that stay).

    A line goes when it is on ``min_pages`` pages or more of the host and on more
    than ``max_ratio`` of them. A line that repeats within a page counts once and,
    if it goes, goes everywhere on it. Pages without a host belong to no site and
    keep all lines; null texts have none. Repeated rows are pages of their own.
    Other columns are not read. An empty table gives an empty result.
    """
    lined = pages.select(F.col(id_col).alias("page_id"), F.coalesce(host, F.lit("")).alias("host"), lines_of(filled(text)).alias("lines"))
    sited = lined.filter("host <> ''")
    digest = lambda line: F.unhex(F.md5(line))
    totals = snapshot(sited.groupBy("host").agg(F.count("*").alias("host_pages")))
    counted = sited.select("host", F.explode(F.array_distinct(F.transform("lines", digest))).alias("line")).groupBy("host", "line").count()
    frequent = counted.filter(F.col("count") >= min_pages).join(totals, "host").filter(F.col("count") > max_ratio * F.col("host_pages"))
    boilerplate = snapshot(frequent.groupBy("host").agg(F.collect_set("line").alias("boilerplate")))
    kept = F.when(F.col("boilerplate").isNull(), F.col("lines")).otherwise(
        F.filter("lines", lambda line: ~F.array_contains("boilerplate", digest(line)))
    )
    joined = lined.join(boilerplate, "host", "left").select("page_id", "host", F.size("lines").alias("n_lines"), kept.alias("kept"))
    return joined.select("page_id", "host", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("text"))
