"""Lines, sections and exhaustive occurrences with line and column."""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import ship


def lines(docs: DataFrame) -> DataFrame:
    """path, line_no (from 1), char_start (from 0), line of every line of content."""
    split = docs.withColumn("all_lines", F.split("content", "\n", -1))
    own = split.select("*", F.posexplode("all_lines").alias("pos", "line")).drop("all_lines")
    before = F.sum(F.length("line") + 1).over(Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    return own.withColumn("char_start", F.coalesce(before, F.lit(0)).cast("long")).withColumn("line_no", F.col("pos") + 1).drop("pos", "content")


def literal(docs: DataFrame, pattern: str, roles: tuple[str, ...] = (), scope: str = "") -> DataFrame:
    """path, role, line_no, start_column, end_column (from 0) of each occurrence of pattern, which holds no line break."""
    if not pattern:
        raise ValueError("an empty pattern matches nothing that can be listed")
    kept = docs.filter(F.col("format") != "pdf") if "format" in docs.columns else docs
    kept = kept.filter(F.col("role").isin(*roles)) if roles else kept
    kept = kept.filter((F.col("path") == scope) | F.col("path").startswith(scope + "/")) if scope else kept
    kept = kept.filter(F.col("content").contains(pattern)).select("path", "role", F.posexplode(F.split("content", "\n", -1)).alias("pos", "line")).filter(F.col("line").contains(pattern))
    gaps = kept.withColumn("gaps", F.split("line", re.escape(pattern), -1)).select("path", "role", "pos", "line", "gaps", F.explode(F.sequence(F.lit(1), F.size("gaps") - 1)).alias("k"))
    start = F.aggregate(F.slice("gaps", F.lit(1), F.col("k")), F.lit(0), lambda s, g: s + F.length(g)) + (F.col("k") - 1) * len(pattern)
    return gaps.select("path", "role", (F.col("pos") + 1).alias("line_no"), start.alias("start_column"), (start + len(pattern)).alias("end_column"))


def _compiled(pattern: str) -> re.Pattern:
    if not pattern:
        raise ValueError("an empty pattern matches nothing that can be listed")
    try:
        return re.compile(pattern, re.MULTILINE)
    except re.error as e:
        raise ValueError(f"invalid pattern: {e}") from e


def regex(docs: DataFrame, pattern: str, column: str = "content") -> DataFrame:
    """All columns but the text, with ordinal (from 1) and match of each match of a pattern common to Java and RE2."""
    _compiled(pattern)
    found = F.regexp_extract_all(column, F.lit(pattern), F.lit(0))
    return docs.filter(F.col(column).rlike(pattern)).select("*", F.posexplode(found).alias("pos", "match")).withColumn("ordinal", F.col("pos") + 1).drop("pos", column)


FOUND = (
    "path string, role string, start_line int, end_line int, start_column int, end_column int, "
    "match string, span_hash string, snippet string, file_hash string"
)
SNIPPET = 600


def matches(docs: DataFrame, pattern: str, roles: tuple[str, ...] = (), scope: str = "") -> DataFrame:
    """FOUND of every match of a pattern in Python's dialect, ^ and $ at line ends: its lines, columns and the lines' hash.

    docs: path, role, format, content, file_hash. Columns count from 0, an end column on the line where the match ends; a
    match may hold line breaks. Every text goes through once, in Arrow batches; a pdf has no text of its own.
    """
    _compiled(pattern)
    ship(docs.sparkSession)
    kept = docs.filter(F.col("format") != "pdf")
    kept = kept.filter(F.col("role").isin(*roles)) if roles else kept
    kept = kept.filter((F.col("path") == scope) | F.col("path").startswith(scope + "/")) if scope else kept

    def rows(path: str, role: str, text: str, file_hash: str) -> Iterator[tuple]:
        breaks = None
        for m in _compiled(pattern).finditer(text):
            if breaks is None:
                breaks = [-1, *(i.start() for i in re.finditer("\n", text)), len(text)]
            line = lambda at: bisect.bisect_left(breaks, at, 1)
            first, last, after = line(m.start()), line(max(m.start(), m.end() - 1)), line(m.end())
            span = text[breaks[first - 1] + 1 : breaks[last]]
            columns = m.start() - breaks[first - 1] - 1, m.end() - breaks[after - 1] - 1
            yield path, role, first, last, *columns, m[0], hashlib.sha256(span.encode()).hexdigest(), span[:SNIPPET], file_hash

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in FOUND.split(", ")]
        for batch in batches:
            yield pd.DataFrame([r for d in batch.itertuples(index=False) for r in rows(d.path, d.role, d.content or "", d.file_hash)], columns=names)

    return kept.select("path", "role", "content", "file_hash").mapInPandas(run, FOUND)


def attributed(found: DataFrame, sections: DataFrame) -> DataFrame:
    """found with breadcrumb and page of the section that holds its first line; matches outside all sections have neither."""
    own = sections.select(F.col("path").alias("in_path"), "breadcrumb", F.col("start_line").alias("from_line"), F.col("end_line").alias("to_line"))
    at = (F.col("path") == F.col("in_path")) & F.col("start_line").between(F.col("from_line"), F.col("to_line"))
    page = F.regexp_extract("breadcrumb", r"(?:^| > )Page (\d+)$", 1)
    joined = found.join(own, at, "left").drop("in_path", "from_line", "to_line")
    return joined.withColumn("page", F.when(page != "", page.cast("int")))


def ordered(found: DataFrame, cursor: str | int | None = None) -> DataFrame:
    """found by path, page, line, column and match, from the cursor on: a number of rows to leave out, anything else being none."""
    page = [F.coalesce("page", F.lit(0))] if "page" in found.columns else []
    start = int(cursor or 0) if str(cursor or "0").isdigit() else 0
    return found.orderBy("path", *page, "start_line", "start_column", "match").offset(start)


# LaTeX's sectioning commands from the highest rank down, and the patterns of headings and entries.
LATEX_RANKS = ("part", "chapter", "section", "subsection", "subsubsection", "paragraph", "subparagraph")
LATEX_HEADING = r"^[ \t]*\\(" + "|".join(LATEX_RANKS) + r")\*?\s*\{([^{}]*)\}"
BIBTEX_ENTRY = r"^[ \t]*@([A-Za-z][A-Za-z0-9_-]*)\s*[\[{]\s*([^,\s}\]]+)"


def _outline(heads: DataFrame, ranks: int, keep_blank: bool) -> DataFrame:
    """path, breadcrumb, start_line, end_line from lines with level (1 to ranks, null for no heading) and title.

    What stands before the first heading is a section without breadcrumb, if not blank or keep_blank; so is a whole text without headings.
    """
    whole = Window.partitionBy("path")
    by = whole.orderBy("line_no")
    heads = heads.withColumn("seen", F.count("level").over(by)).withColumn("total", F.count("level").over(whole)).withColumn("last", F.max("line_no").over(whole))
    body = F.max((F.col("seen") == 0) & (F.trim("line") != "")).over(whole)
    front = (F.col("line_no") == 1) & F.col("level").isNull() & (F.lit(keep_blank) | F.col("body") | (F.col("total") == 0))
    titles = heads.withColumn("body", body).withColumn("level", F.when(front, 0).otherwise(F.col("level"))).filter("level IS NOT NULL")
    for n in range(1, ranks + 1):  # an ancestor of level n holds until a heading of level n or less
        titles = titles.withColumn(f"at{n}", F.last(F.when(F.col("level") == n, F.col("line_no")), True).over(by)).withColumn(f"t{n}", F.last(F.when(F.col("level") == n, F.col("title")), True).over(by)).withColumn(f"cut{n}", F.max(F.when(F.col("level") < n, F.col("line_no"))).over(by))
    crumb = F.concat_ws(" > ", *(F.when((F.col("level") >= n) & (F.col(f"at{n}") > F.coalesce(f"cut{n}", F.lit(0))), F.col(f"t{n}")) for n in range(1, ranks + 1)))
    return titles.select("path", crumb.alias("breadcrumb"), F.col("line_no").alias("start_line"), F.coalesce(F.lead("line_no").over(by) - 1, F.col("last")).alias("end_line"))


def sections(docs: DataFrame) -> DataFrame:
    """Sections of Markdown, each up to the next heading: ATX headings, and setext ones after a blank line or none, outside code fences."""
    own = lines(docs)
    by = Window.partitionBy("path").orderBy("line_no")
    fence = F.col("line").rlike(r"^\s*(```|~~~)")
    open_text = ~fence & (F.sum(fence.cast("int")).over(by) % 2 == 0)
    own = own.withColumn("free", open_text).withColumn("under", F.regexp_extract(F.lead("line").over(by), r"^[ \t]*(=+|-+)[ \t]*$", 1)).withColumn("above", F.coalesce(F.trim(F.lag("line").over(by)), F.lit("")))
    atx = F.col("line").rlike(r"^#{1,6}\s")
    setext = F.when((F.col("above") == "") & (F.trim("line") != "") & (F.col("under") != ""), F.when(F.col("under").startswith("="), 1).otherwise(2))
    level = F.when(F.col("free"), F.when(atx, F.length(F.regexp_extract("line", r"^(#+)", 1))).otherwise(setext))
    title = F.when(atx, F.trim(F.regexp_replace(F.regexp_replace("line", r"^#+\s+", ""), r"\s+#+\s*$", ""))).otherwise(F.trim("line"))
    return _outline(own.withColumn("level", level).withColumn("title", title), 6, False)


def latex_sections(docs: DataFrame) -> DataFrame:
    """Sections of LaTeX by its sectioning commands, starred or not; the preamble stays even if blank."""
    name = F.regexp_extract("line", LATEX_HEADING, 1)
    rank = F.array_position(F.array(*map(F.lit, LATEX_RANKS)), name)
    own = lines(docs).withColumn("level", F.when(name != "", rank)).withColumn("title", F.trim(F.regexp_extract("line", LATEX_HEADING, 2)))
    return _outline(own, len(LATEX_RANKS), True)


def bibtex_sections(docs: DataFrame) -> DataFrame:
    """One section an entry of BibTeX, its breadcrumb type: key."""
    kind = F.regexp_extract("line", BIBTEX_ENTRY, 1)
    own = lines(docs).withColumn("level", F.when(kind != "", 1)).withColumn("title", F.concat(kind, F.lit(": "), F.regexp_extract("line", BIBTEX_ENTRY, 2)))
    return _outline(own, 1, True)
