"""Web pages as documents for search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import html_text, html_title, url_host


def url_tags(url: Column) -> Column:
    """The words of the path, without numbers."""
    path = F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]+/([^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda p: F.regexp_like(p, F.lit("[^0-9]")))


def ingest_pages(pages: DataFrame, updated: Column, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Title and plain text next to the HTML they come from, with address, tags and time of update."""
    html, url = F.col(html_col), F.col(url_col)
    return pages.select(
        id_col, html_title(html).alias("title"), html_text(html).alias("content"), html.alias("content_html"),
        url.alias("source_url"), url_host(url).alias("host"), url_tags(url).alias("tags"), updated.alias("last_updated"))
