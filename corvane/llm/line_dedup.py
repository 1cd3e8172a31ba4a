"""Line dedup by site-relative frequency.

A page's lines are the text between its block tags. A line is boilerplate on a host if the share of
the host's pages that contain it exceeds a ratio, and such lines are dropped from all its pages.

The lines of a page are counted once each and summed before they are shuffled, so a very common line
or host is a few rows. On one host at most (lines a page) / ratio lines can exceed the ratio, so a
host's list of them is short whatever the number of its pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import only, saved, shared_path, small, text_of

RATIO = 0.2
#: Pages that must contain a line before it can be boilerplate: on a page alone it repeats nothing.
MIN_PAGES = 2

HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)"
#: Elements without readable text, and comments; one that is not closed goes on to the end.
UNSEEN = (
    r"(?is)<(?:script\b.*?(?:</script\s*>|\z)|style\b.*?(?:</style\s*>|\z)|title\b.*?(?:</title\s*>|\z)"
    r"|noscript\b.*?(?:</noscript\s*>|\z)|template\b.*?(?:</template\s*>|\z)|!--.*?(?:-->|\z))"
)
INLINE = r"(?i)</?(?:a|abbr|b|bdi|bdo|cite|code|em|font|i|kbd|mark|q|s|samp|small|span|strong|sub|sup|tt|u|var)(?:\s[^>]*)?>"
#: One tag; no group repeats, so a page of any number of tags in a row takes no stack.
TAG = r"<[A-Za-z/!?][^>]*>"
# The references that HTML needs for its own signs; the ampersand is last.
REFERENCES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def host_of(url: Column) -> Column:
    """The host of a url in lower case; empty if it has none."""
    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def closed(text: Column) -> Column:
    """The text, in which a sign ``<`` that no ``>`` follows is no tag's: every tag that is begun has an end, so each is looked through once."""
    tail = F.substring_index(text, ">", -1)
    return F.concat(F.left(text, F.length(text) - F.length(tail)), F.replace(tail, F.lit("<"), F.lit("&lt;")))


def lines_of(html: Column) -> Column:
    """The page's lines, trimmed, white space in them made one space, empty ones left out."""
    text = F.regexp_replace(F.regexp_replace(html, UNSEEN, "<p>"), r"[\x09-\x0D]+", " ")
    text = F.regexp_replace(F.regexp_replace(closed(text), INLINE, ""), TAG, "\n")
    for name, sign in REFERENCES:
        text = F.replace(text, F.lit(name), F.lit(sign))
    lines = F.transform(F.split(F.regexp_replace(text, r" {2,}", " "), "\n"), lambda line: F.trim(line))
    return F.filter(lines, lambda line: F.length(line) > 0)


def boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """host and its boilerplate lines, of rows with host and lines."""
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    each = pages.select("host", F.explode(F.array_distinct("lines")).alias("line"))
    counts = each.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages)
    common = counts.join(totals, "host").filter(F.col("n") > ratio * F.col("pages"))
    return common.groupBy("host").agg(F.collect_list("line").alias("common"))


def without_boilerplate(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
) -> DataFrame:
    """One row a page: page_id, host, n_lines, n_dropped, text (the lines that stay, one a line).

    A null or empty page has no lines. Pages whose url is null or has no host are one site. Repeated
    rows are pages of their own. A line on fewer than ``min_pages`` pages stays.
    """
    rows = only(
        pages, page_id=F.col(id_col), host=host_of(F.col(url_col)), lines=lines_of(text_of(html_col))
    )
    # the lines are read twice, and cutting pages into lines is most of the work
    path = shared_path(pages.sparkSession, "lines")
    rows.write.parquet(path)
    rows = pages.sparkSession.read.parquet(path)
    common = saved(boilerplate(rows, ratio, min_pages))
    # the bytes of the lists, as texts of 64
    bytes_of = F.aggregate("common", F.lit(0).cast("long"), lambda n, line: n + 64 + F.octet_length(line))
    lists = small(common, (bytes_of / 64).cast("long"))
    stay = F.filter("lines", lambda line: ~F.array_contains("common", line))
    kept = F.when(F.col("common").isNull(), F.col("lines")).otherwise(stay)
    return (
        rows.join(lists, "host", "left")
        .select("page_id", "host", "lines", kept.alias("kept"))
        .select(
            "page_id",
            "host",
            F.size("lines").cast("long").alias("n_lines"),
            (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
            F.array_join("kept", "\n").alias("text"),
        )
    )


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _references(text: str) -> str:
    for name, sign in REFERENCES:
        text = f"replace({text}, {_sql(name)}, {_sql(sign)})"
    return text


ORACLE_SQL = rf"""
WITH a AS (
    SELECT page_id, lower(coalesce(regexp_extract(url, {_sql(HOST)}, 1), '')) AS host,
           regexp_replace(regexp_replace(coalesce(html, ''), {_sql(UNSEEN)}, '<p>', 'g'), '[\x09-\x0D]+', ' ', 'g') AS t
    FROM pages
), u AS (
    SELECT page_id, host, left(t, length(t) - length(string_split(t, '>')[-1])) || replace(string_split(t, '>')[-1], '<', '&lt;') AS t FROM a
), b AS (
    SELECT page_id, host, regexp_replace(regexp_replace(t, {_sql(INLINE)}, '', 'g'), {_sql(TAG)}, chr(10), 'g') AS t FROM u
), c AS (
    SELECT page_id, host, regexp_replace({_references("t")}, ' {{2,}}', ' ', 'g') AS t FROM b
), p AS (
    SELECT page_id, host, list_filter(list_transform(string_split(t, chr(10)), lambda l: trim(l)),
           lambda l: length(l) > 0) AS lines FROM c
), totals AS (
    SELECT host, count(*) AS pages FROM p GROUP BY host
), counts AS (
    SELECT host, line, count(*) AS n
    FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM p) GROUP BY host, line
), common AS (
    SELECT host, list(line) AS common FROM counts JOIN totals USING (host)
    WHERE n >= {MIN_PAGES} AND n > {RATIO} * pages GROUP BY host
), k AS (
    SELECT page_id, host, lines, list_filter(lines, lambda l: NOT list_contains(coalesce(common, []), l)) AS kept
    FROM p LEFT JOIN common USING (host)
)
SELECT page_id, host, len(lines) AS n_lines, len(lines) - len(kept) AS n_dropped,
       array_to_string(kept, chr(10)) AS text
FROM k
"""
