"""Text columns from raw pages and filings, fenced and embedded JSON, article/page join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Character references that are decoded, in this order.
ENTITIES = (
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"),
)


def html_to_text(html: Column) -> Column:
    """Visible text: scripts, styles, comments and tags become blanks, entities are decoded, space collapsed."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for entity, character in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(character))
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def document_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Size columns of a text next to its other columns."""
    body = F.col(text)
    return docs.withColumns(
        {
            "char_count": F.length(body).cast("bigint"),
            "line_count": F.size(F.split(body, "\n")).cast("bigint"),
            "word_count": F.size(F.filter(F.split(body, r"[ \n\t]+"), lambda w: w != "")).cast("bigint"),
        }
    )


def path_keys(df: DataFrame, pattern: str, names: list[str], path: str = "path") -> DataFrame:
    """Columns taken from the groups of a path pattern; empty where the path does not match."""
    return df.withColumns({n: F.regexp_extract(path, pattern, i + 1) for i, n in enumerate(names)})


def url_key(url: Column) -> Column:
    """Last path segment of an address, without query and fragment."""
    return F.regexp_extract(url, r"([^/?#]+)/?(?:[?#].*)?$", 1)


def articles_with_pages(news: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per article with the text of its page, null where no page was stored.

    Both sides carry ``page_key``; several stored copies of a page are reduced to
    the first by path with a combining aggregate before the join.
    """
    bodies = pages.groupBy("page_key").agg(F.min_by("html", "path").alias("html"), F.min("path").alias("path"))
    return news.join(bodies, "page_key", "left").withColumn("page_text", html_to_text(F.col("html"))).drop("html")


def strip_fence(text: Column) -> Column:
    """Body of a ``` fenced block; text without a leading fence is only trimmed."""
    trimmed = F.trim(F.coalesce(text, F.lit("")))
    opened = F.regexp_replace(trimmed, r"\A```[^\n]*(\n|\z)", "")
    closed = F.regexp_replace(opened, r"(\A|\n)[ \t]*```[ \t]*\z", "")
    return F.when(F.startswith(trimmed, F.lit("```")), F.trim(closed)).otherwise(trimmed)


def parse_response(text: Column, schema: str) -> Column:
    """Struct parsed from a possibly fenced JSON object; null if it is not valid JSON."""
    body = strip_fence(text)
    return F.when(F.try_parse_json(body).isNotNull(), F.from_json(body, schema))


def embedded_json(outputs: DataFrame, key: str = "run_id", text: str = "stdout") -> DataFrame:
    """JSON object embedded in multi-line output: the first line starting with ``{`` from which the rest parses.

    Works on one output row at a time, so nothing is grouped or shuffled.
    """
    lines = F.filter(F.split(F.col(text), r"\r\n|\n|\r"), lambda line: F.trim(line) != "")
    outputs = outputs.withColumn("lines", lines)
    starts = F.filter(
        F.transform(
            F.col("lines"), lambda line, i: F.when(F.startswith(F.ltrim(line), F.lit("{")), i)
        ),
        lambda i: i.isNotNull(),
    )
    tails = F.transform(starts, lambda i: F.array_join(F.slice("lines", i + 1, F.size("lines")), "\n"))
    parsed = F.filter(tails, lambda t: F.try_parse_json(t).isNotNull())
    return outputs.withColumn("payload", F.get(parsed, F.lit(0))).drop("lines")
