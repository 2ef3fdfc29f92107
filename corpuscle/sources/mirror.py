"""Markdown mirrors of paged texts, such as the pages a PDF reader gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORMAT = 1


def clean(text: Column) -> Column:
    """A page's text: feeds and vertical tabs become line breaks, other control characters go, words hyphenated at a line's end are joined if lower-case, blank lines don't pile up."""
    breaks = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?|[\x0B\x0C]", "\n")
    plain = F.regexp_replace(breaks, r"[\x00-\x08\x0E-\x1F\x7F]", "")
    joined = F.regexp_replace(plain, r"(?<![\p{L}\p{N}_])(\p{Ll}+)-\n(\p{Ll}+)(?![\p{L}\p{N}_])", "$1$2\n")
    return F.regexp_replace(F.regexp_replace(joined, r"\n[ \t]+(?=\S)", "\n"), r"\n{3,}", "\n\n")


def mirrors(pages: DataFrame) -> DataFrame:
    """path, pdf_sha256, pages, format, content of each file of pages (path, page_no, page_text, pdf_sha256): a header line, then a heading and the clean text of each page in order.

    A null page_text is an empty page; rows without path or page_no are left out; an empty table gives no rows.
    """
    known = pages.filter("path IS NOT NULL AND page_no IS NOT NULL").select("path", "pdf_sha256", F.struct("page_no", clean(F.col("page_text")).alias("text")).alias("page"))
    own = known.groupBy("path").agg(F.max("pdf_sha256").alias("pdf_sha256"), F.array_sort(F.collect_list("page")).alias("all"))  # the pages of one file, which become one text
    head = F.concat(F.lit("<!-- sha256: "), F.coalesce("pdf_sha256", F.lit("")), F.lit(f"; format: {FORMAT}; pages: "), F.size("all").cast("string"), F.lit(" -->"))
    body = F.array_join(F.transform("all", lambda p: F.concat(F.lit("\n\n## Page "), p["page_no"].cast("string"), F.lit("\n\n"), F.trim(p["text"]))), "")
    return own.select("path", "pdf_sha256", F.size("all").alias("pages"), F.lit(FORMAT).alias("format"), F.concat(head, body, F.lit("\n")).alias("content"))


def outdated(pages: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of pages whose file has no mirror in kept (path, pdf_sha256, format) of the same hash and the present format."""
    current = kept.filter(F.col("format") == FORMAT).select("path", "pdf_sha256").distinct()
    return pages.join(current, ["path", "pdf_sha256"], "left_anti").select(*pages.columns)


def page(mirror: DataFrame, number: int) -> DataFrame:
    """path, start_line, span of one page of each mirror that has it, its heading included."""
    lines = F.split("content", "\n", -1)
    at = F.array_position(lines, F.lit(f"## Page {number}"))
    after = F.array_position(lines, F.lit(f"## Page {number + 1}"))
    size = F.when(after > 0, after - at).otherwise(F.size(lines) - at + 1)
    found = mirror.withColumns({"start_line": at.cast("int"), "lines_here": size.cast("int")}).filter("start_line > 0")
    return found.select("path", "start_line", F.rtrim(F.array_join(F.slice(lines, F.col("start_line"), F.col("lines_here")), "\n")).alias("span"))
