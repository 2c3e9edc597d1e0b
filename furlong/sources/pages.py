"""Text clean-up and link catalogs taken from stored HTML pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def collapse_whitespace(text: Column, delimiter: str = ",") -> Column:
    """Every run of ASCII whitespace becomes one delimiter."""
    return F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", delimiter)


def latest_link_per_row(pages: DataFrame, html: str = "html", by: str | list[str] | None = None,
                        row_tag: str = "tr", label: str = "[A-Z0-9]+") -> DataFrame:
    """Label of the last link in each table row, distinct, in first-seen order.

    ``by`` names the page identity; a label's ``position`` is the number of the
    first row (from 0) that ends with it on that page.
    """
    keys = [by] if isinstance(by, str) else list(by or [])
    rows = F.regexp_extract_all(html, F.lit(f"(?s)<{row_tag}>.*?</{row_tag}>"), 0)
    links = F.regexp_extract_all("row", F.lit(f'<a href="[^"]*">({label})</a>'), 1)
    return (
        pages.select(*keys, F.posexplode(rows).alias("position", "row"))
        .select(*keys, "position", F.try_element_at(links, F.lit(-1)).alias("label"))
        .where(F.col("label").isNotNull())
        .groupBy(*keys, "label").agg(F.min("position").alias("position"))
    )


def link_listing(pages: DataFrame, base: Column, html: str = "html", suffix: str = ".txt",
                 root: str = "/program/") -> DataFrame:
    """Distinct links with the given ending, resolved, with their folder below ``root``.

    Root-relative and plain relative links are resolved against ``base`` (the
    page address); links outside ``root`` have no folder.
    """
    ending = suffix.replace(".", r"\.")
    hrefs = F.regexp_extract_all(html, F.lit("href=[\"']([^\"']*" + ending + ")[\"']"), 1)
    link = F.col("href")
    # A web address without query and fragment, cut at its host and its last folder.
    site = F.regexp_extract("base", r"^([a-zA-Z]+://[^/?#]+)", 1)
    folder = F.regexp_extract("base", r"^([a-zA-Z]+://[^/?#]+(?:/[^?#]*/|/)?)", 1)
    slash = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    url = (
        F.when(link.rlike("^[a-zA-Z]+://"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract("base", "^([a-zA-Z]+:)", 1), link))
        .when(link.startswith("/"), F.concat(site, link))
        .otherwise(F.concat(slash, link))
    )
    below = F.when(F.size(F.split("url", root)) == 2, F.split("url", root)[1])
    return (
        pages.select(base.alias("base"), F.explode(hrefs).alias("href"))
        .select(url.alias("url")).distinct()
        .withColumn("_below", below)
        .withColumn("folder", F.when(F.col("_below").contains("/"), F.split("_below", "/")[0])
                    .when(F.col("_below").isNotNull(), "root"))
        .withColumn("file_name", F.when(F.col("_below").isNotNull(),
                                        F.regexp_extract("url", r"([^/]*)$", 1)))
        .drop("_below")
    )


def folder_counts(listing: DataFrame) -> DataFrame:
    return listing.where(F.col("folder").isNotNull()).groupBy("folder").agg(F.count("*").alias("files"))
