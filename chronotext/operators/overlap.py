"""Matching the articles of one corpus to those of another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chronotext.functions.text import first_field, flatten_whitespace, slug
from chronotext.operators.joins import semi_join


def match_titles(
    pages: DataFrame, titles: DataFrame, page_id: str = "page_id", body: str = "content", content: Column | None = None, **options
) -> DataFrame:
    """Pages whose title has the slug of a listed title: (page_id, slug, title, text).

    The text comes from ``content``, an expression on the column ``body``, and is put on one line after
    the join, so only for pages that match.
    """
    slugged = pages.select(page_id, slug("title").alias("slug"), "title", body)
    listed = titles.select(slug("title").alias("slug"))
    matched = semi_join(slugged, listed, "slug", page_id, **options)
    return matched.select(page_id, "slug", "title", flatten_whitespace(F.col(body) if content is None else content).alias("text"))


def match_lines(lines: DataFrame, selection: DataFrame, line_id: str, **options) -> DataFrame:
    """Lines whose first field is the first field of a selected line, unchanged."""
    keyed = lines.withColumn("_key", first_field("value"))
    chosen = selection.select(first_field("value").alias("_key"))
    return semi_join(keyed, chosen, "_key", line_id, **options).drop("_key")


def article_line(slug_: Column | str, title: Column | str, text: Column | str) -> Column:
    return F.concat_ws("\t", slug_, title, text)


def page_by_id(pages: DataFrame, page_id: int) -> DataFrame:
    """One page; the filter reaches the scan, where file statistics rule out most row groups."""
    return pages.where(F.col("page_id") == page_id)
