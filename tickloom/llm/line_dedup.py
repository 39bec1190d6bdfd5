"""Boilerplate lines of a site: lines on more than a given share of the host's pages are dropped.

Only DataFrame functions are used.  A page sends each of its distinct lines once, as a
96-bit key, and counts are combined before the shuffle, so neither a hot host nor a
line that every page carries is gathered anywhere.  The boilerplate keys of a host number at most
(average lines of a page) / ``max_ratio``; they are stored as one array per host and joined
to the pages.  Spark picks a broadcast from the stored size, and otherwise a sort-merge join
whose skewed hosts AQE splits.

The share is the same at all sizes of a host; a line must stand on two pages at least, or every line of a host with few
pages would be one.  With ``copies_vote=False`` a page that holds such a line is taken for a copy of others if half or more of its
characters are phrases (cut at line ends and after certain letters and marks, so a changed word changes one) that as large a
share of the host's pages has.  Copies count neither for their lines nor in the host's total: what near copies of a page have in common
stays, however many they are, while a line among otherwise different texts goes.

Defined results: lines are compared without surrounding blanks; blank lines are never
dropped; a page that holds a line twice counts once for it and loses both copies.  A null text stays null
with no lines, a null host keeps every line.  A page is a row: repeated rows count as pages and stay
rows.  An empty table stays empty.  Other columns, whatever their names, pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.session import materialise

MAX_RATIO = 0.1
MIN_PAGES = 2


def url_host(url: Column | str) -> Column:
    """Host of an absolute URL, lower-cased; null if there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/?#:]+)", 1)
    return F.when(host != "", host)


def html_text(html: Column | str) -> Column:
    """Text of a page, one line per block element; scripts, styles and comments are left out."""
    text = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->", "")
    text = F.regexp_replace(
        text, r"(?i)</?(p|div|br|li|ul|ol|nav|h[1-6]|article|title|head|header|footer|section|body|html|table|tr|td)(\s[^>]*)?/?>", "\n")
    return F.regexp_replace(text, r"<[^>]*>", "")


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    """96 bits that stand for a line; null for a blank one."""
    line = F.trim(line)
    return F.when(line != "", F.struct(F.xxhash64(line).alias("a"), F.crc32(line).alias("b")))


def _keys(parts: Column) -> Column:
    return F.array_compact(F.array_distinct(F.transform(parts, _key)))


def _phrases(text: Column) -> Column:
    return F.split(text, r"\n|(?<=[.!?;:,gly。！？]) ", -1)


def _often(counts: DataFrame, totals: DataFrame, max_ratio: float, min_pages: int) -> DataFrame:
    often = counts.where(F.col("n") >= min_pages).join(totals, "host").where(F.col("n") > F.lit(max_ratio) * F.col("total"))
    return often.groupBy("host").agg(F.collect_list("line").alias("lines"))


def _counted(pages: DataFrame, keys: Column) -> DataFrame:
    return pages.select("host", F.explode(keys).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))


def _cut(text: Column, hits: Column) -> Column:
    """Lines of a text that are not among ``hits``."""
    return F.filter(_lines(text), lambda x: F.coalesce(~F.array_contains(hits, _key(x)), F.lit(True)))


def boilerplate(pages: DataFrame, host: str, text: str, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES,
                copies_vote: bool = True) -> DataFrame:
    """``(host, lines)``: keys of the lines on at least ``min_pages`` and more than ``max_ratio`` of a host's pages."""
    known = pages.where(F.col(f"`{host}`").isNotNull()).select(F.col(f"`{host}`").alias("host"), F.col(f"`{text}`").alias("text"))
    totals = known.groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    keys = _keys(_lines(F.col("text")))
    often = _often(_counted(known, keys), totals, max_ratio, min_pages)
    if copies_vote:
        return often
    often, totals = materialise(often), materialise(totals)
    holders = known.join(often, "host").select("host", "text", F.array_intersect(keys, F.col("lines")).alias("hits"))
    holders = materialise(holders.where(F.size("hits") > 0))
    common = materialise(_often(_counted(holders, _keys(_phrases(F.col("text")))), totals, max_ratio, min_pages))
    parts = F.transform(_phrases(F.col("text")), F.trim)
    own = F.filter(parts, lambda x: ~F.array_contains(F.col("lines"), _key(x)))
    copy = 2 * F.length(F.array_join(own, "")) <= F.length(F.array_join(parts, ""))
    judged = materialise(holders.join(common, "host", "left").select("host", "hits", F.coalesce(copy, F.lit(False)).alias("copy")))
    copies = judged.where("copy").groupBy("host").agg(F.count(F.lit(1)).alias("copies"))
    voters = totals.join(copies, "host", "left").select("host", (F.col("total") - F.coalesce("copies", F.lit(0))).alias("total"))
    return _often(_counted(judged.where(~F.col("copy")), F.col("hits")), voters, max_ratio, min_pages)


def drop_boilerplate(pages: DataFrame, host: str, text: str, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES,
                     n_lines: str | None = None, n_dropped: str | None = None, copies_vote: bool = True) -> DataFrame:
    """Return ``pages`` with the boilerplate lines cut from ``text``; optionally add both counts.

    ``host`` and ``text`` name columns of ``pages``; no other column is touched.
    """
    found = materialise(boilerplate(pages, host, text, max_ratio, min_pages, copies_vote)).withColumnRenamed("host", "site")
    given = F.struct(*[F.col(f"`{c}`") for c in pages.columns])
    rows = pages.select(given.alias("given"), F.col(f"`{host}`").alias("host"), F.col(f"`{text}`").alias("text"))
    rows = rows.join(found, F.col("host") == F.col("site"), "left")
    hits = F.array_intersect(F.transform(_lines(F.col("text")), _key), F.col("lines"))
    rows = rows.select("given", "text", F.coalesce(hits, F.array().cast("array<struct<a:bigint,b:bigint>>")).alias("hits"))
    rows = rows.withColumn("stay", F.when(F.size("hits") > 0, _cut(F.col("text"), F.col("hits"))))
    rest = F.when(F.col("stay").isNull(), F.col("text")).otherwise(F.array_join("stay", "\n"))
    out = [rest.alias(c) if c == text else F.col(f"given.`{c}`").alias(c) for c in pages.columns]
    lines = _lines(F.col("text"))
    if n_lines:
        out.append(F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(F.filter(lines, lambda x: F.trim(x) != ""))).cast("long").alias(n_lines))
    if n_dropped:
        out.append(F.when(F.col("stay").isNull(), F.lit(0)).otherwise(F.size(lines) - F.size("stay")).cast("long").alias(n_dropped))
    return rows.select(*out)
