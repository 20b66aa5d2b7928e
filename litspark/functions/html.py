"""HTML to text and Markdown, as Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_text, strip

# Patterns of elements, and elements dropped with their bodies.
SCRIPT = r"(?is)<script[^>]*>.*?</script>"
STYLE = r"(?is)<style[^>]*>.*?</style>"
LINE_ENDS = r"(?i)</(p|div|h[1-6]|li)>"
TITLE = "(?i)<title>([^<]+)</title>"
FIRST_HEADING = "(?i)<h1[^>]*>([^<]+)</h1>"
STYLES = (r'(?i)\s+style="[^"]*"', r"(?i)\s+style='[^']*'")
BLOCKS = "(?i)</?(?:div|section|article|main|body)[^>]*>"
BREAK = r"(?i)<br\s*/?>"
PARAGRAPH_END = r"(?i)</p\b[^>]*>"
TAG = "<[^>]+>"
NOISE = ("script", "style", "nav", "header", "footer", "aside", "svg", "noscript")
HEADING = r"(?is)<h([1-6])[^>]*>(.*?)</h\1>"
LINKS = (r'(?is)<a\b[^>]*href="([^"]+)"[^>]*>(.*?)</a>', r"(?is)<a\b[^>]*href='([^']+)'[^>]*>(.*?)</a>")
LIST = r"(?is)<(ol|ul)\b[^>]*>(.*?)</\1>"
ITEM = r"(?is)<li\b[^>]*>(.*?)</li>"
TABLE = r"(?is)<table\b[^>]*>(.*?)</table>"
ROW = r"(?is)<tr\b[^>]*>(.*?)</tr>"
CELL = r"(?is)<(?:td|th)\b[^>]*>(.*?)</(?:td|th)>"


def found(html: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(group))


def splice(html: Column, pattern: str, rendered: Column) -> Column:
    """``html`` with the i-th match of ``pattern`` replaced by the i-th of ``rendered``."""
    gaps = F.split(html, pattern, -1)
    return F.array_join(F.flatten(F.transform(gaps, lambda g, i: F.array(g, F.coalesce(F.get(rendered, i), F.lit(""))))), "")


def visible_text(html: Column) -> Column:
    return clean_text(F.regexp_replace(F.regexp_replace(F.regexp_replace(html, SCRIPT, ""), STYLE, ""), LINE_ENDS, "\n"))


def html_title(html: Column) -> Column:
    of = lambda p: F.nullif(F.regexp_extract(html, p, 1), F.lit(""))
    return strip(F.coalesce(of(TITLE), of(FIRST_HEADING)))


def drop_noise(html: Column) -> Column:
    for pattern in STYLES:
        html = F.regexp_replace(html, pattern, "")
    for tag in NOISE:
        html = F.regexp_replace(html, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", "")
    return html


def headings(html: Column) -> Column:
    """array<struct(level, text)>."""
    return F.transform(F.arrays_zip(found(html, HEADING, 1).alias("a"), found(html, HEADING, 2).alias("b")), lambda m: F.struct(m["a"].cast("int").alias("level"), clean_text(m["b"]).alias("text")))


def render_headings(html: Column) -> Column:
    return splice(html, HEADING, F.transform(headings(html), lambda h: F.concat(F.repeat(F.lit("#"), h["level"]), F.lit(" "), h["text"], F.lit("\n\n"))))


def emphasis(html: Column) -> Column:
    for tag, mark in (("strong", "**"), ("b", "**"), ("em", "*"), ("i", "*")):
        html = F.regexp_replace(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", f"{mark}$1{mark}".replace("*", r"\*"))
    return html


def _links(html: Column, pattern: str) -> Column:
    def link(m: Column) -> Column:
        return F.struct(m["a"].alias("href"), F.when(m["b"] == "", m["a"]).otherwise(clean_text(m["b"])).alias("text"))

    return F.transform(F.arrays_zip(found(html, pattern, 1).alias("a"), found(html, pattern, 2).alias("b")), link)


def _render_links(html: Column, pattern: str) -> Column:
    return splice(html, pattern, F.transform(_links(html, pattern), lambda x: F.concat(F.lit("["), x["text"], F.lit("]("), x["href"], F.lit(")"))))


def links(html: Column) -> Column:
    """array<struct(href, text)>: double-quoted first, then single-quoted; an empty text is null."""
    every = F.concat(_links(html, LINKS[0]), _links(_render_links(html, LINKS[0]), LINKS[1]))
    return F.transform(every, lambda x: F.struct(x["href"].alias("href"), F.nullif(x["text"], F.lit("")).alias("text")))


def render_links(html: Column) -> Column:
    return _render_links(_render_links(html, LINKS[0]), LINKS[1])


def render_lists(html: Column) -> Column:
    def render(m: Column) -> Column:
        mark = F.when(F.lower(m["a"]) == "ol", F.lit("1. ")).otherwise(F.lit("- "))
        return F.concat(F.array_join(F.transform(found(m["b"], ITEM, 1), lambda item: F.concat(mark, clean_text(item))), "\n"), F.lit("\n\n"))

    return splice(html, LIST, F.transform(F.arrays_zip(found(html, LIST, 1).alias("a"), found(html, LIST, 2).alias("b")), render))


def render_tables(html: Column) -> Column:
    def row(cells: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    def render(body: Column) -> Column:
        cells = F.transform(found(body, ROW, 1), lambda r: F.transform(found(r, CELL, 1), clean_text))
        lines = F.flatten(F.transform(cells, lambda c, i: F.when(i == 0, F.array(row(c), row(F.transform(c, lambda _: F.lit("---"))))).otherwise(F.array(row(c)))))
        return F.when(F.size(cells) == 0, F.lit("")).otherwise(F.concat(F.array_join(lines, "\n"), F.lit("\n\n")))

    return splice(html, TABLE, F.transform(found(html, TABLE, 1), render))


def paragraphs(html: Column) -> Column:
    html = F.regexp_replace(F.regexp_replace(html, BLOCKS, "\n\n"), BREAK, "\n")
    return F.regexp_replace(F.regexp_replace(html, PARAGRAPH_END, "\n\n"), TAG, "")


def collapse_blank_lines(markdown: Column) -> Column:
    lines = F.transform(F.split(markdown, r"\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"), lambda x: F.regexp_replace(x, r"\s+$", ""))
    return strip(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"))


STEPS: tuple[Callable[[Column], Column], ...] = (drop_noise, render_headings, emphasis, render_links, render_lists, render_tables, paragraphs, collapse_blank_lines)


def markdown_columns(df, html_col: str):
    """``df`` with title, headings, links and markdown of its HTML; steps are columns, so each runs once."""
    df = df.withColumn("title", html_title(F.col(html_col))).withColumn("__0", drop_noise(F.col(html_col)))
    df = df.withColumn("headings", headings(F.col("__0")))
    for k, step in enumerate(STEPS[1:], 1):
        if step is render_links:
            df = df.withColumn("links", links(F.col(f"__{k - 1}")))
        df = df.withColumn(f"__{k}", step(F.col(f"__{k - 1}")))
    last = len(STEPS) - 1
    return df.withColumnRenamed(f"__{last}", "markdown").drop(*[f"__{k}" for k in range(last)])
