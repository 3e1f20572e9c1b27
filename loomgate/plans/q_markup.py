"""Queries of markup functions. SQL can't express them: tests hold them against goldens."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgate.functions import markup
from loomgate.plans.tables import table


def html_to_text(spark, d):
    return table(spark, d, "pages").select("page_id", markup.html_to_text(F.col("html")).alias("text"))


def html_sanitize(spark, d):
    return table(spark, d, "pages").select("page_id", markup.sanitise_html(F.concat(F.col("html"), F.lit('<p onclick="x()">a<a href="JavaScript:y">b</a></p><iframe>z</iframe>'))).alias("html"))


def html_to_markdown(spark, d):
    return table(spark, d, "pages").select("page_id", markup.html_to_markdown(F.col("html")).alias("markdown"))


def markdown_to_html(spark, d):
    doc = F.concat(F.lit("# Title\n\n- a *b*\n- c\n\n"), F.col("text"))
    return table(spark, d, "documents").select("doc_id", markup.markdown_to_html(doc).alias("html"))


def slides_from_text(spark, d):
    named = table(spark, d, "documents").select("doc_id", markup.slides_of(F.col("text"), F.concat(F.lit("Deck "), F.col("doc_id").cast("string"))).alias("s"))
    return named.select("doc_id", F.posexplode("s").alias("place", "slide")).select("doc_id", (F.col("place") + 1).alias("number"), "slide.title", "slide.body")


QUERIES = {f.__name__: f for f in (html_to_text, html_sanitize, html_to_markdown, markdown_to_html, slides_from_text)}
SQL: dict[str, str] = {}
