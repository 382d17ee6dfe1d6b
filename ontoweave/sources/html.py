"""Facts from raw HTML pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LINK = '<a href="([^"]*)"'


def page_facts(pages: DataFrame) -> DataFrame:
    """(page_id, title, links, lang) of pages (page_id, html)."""
    return pages.select(
        "page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"),
        F.regexp_count("html", F.lit(_LINK)).alias("links"), F.regexp_extract("html", '<html lang="([a-z]*)"', 1).alias("lang"),
    )


def links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, link) for every link of a page."""
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(_LINK), 1)).alias("pos", "link"))


def table_rows(pages: DataFrame) -> DataFrame:
    """(page_id, row, cells): texts of the cells of each row of the tables' bodies, tags stripped and entities decoded."""
    body = F.explode(F.regexp_extract_all("html", F.lit("(?s)<tbody[^>]*>(.*?)</tbody>"), 1)).alias("body")
    rows = pages.select("page_id", body).select("page_id", F.posexplode(F.regexp_extract_all("body", F.lit("(?s)<tr[^>]*>(.*?)</tr>"), 1)).alias("row", "tr"))
    plain = lambda c: F.trim(F.regexp_replace(c, "<[^>]*>", ""))
    decoded = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))
    cells = F.transform(F.regexp_extract_all("tr", F.lit("(?s)<t[dh][^>]*>(.*?)</t[dh]>"), 1), lambda c: decoded(plain(c)))
    return rows.select("page_id", "row", cells.alias("cells"))
