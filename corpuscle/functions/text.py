"""Scalar text functions as Catalyst expressions."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def query_terms(query: Column) -> Column:
    """The distinct terms of a query's words; quotation marks separate words."""
    return F.array_distinct(terms(F.regexp_replace(query, '"', " ")))


def tokens(text: Column) -> Column:
    """Words and single marks."""
    return F.regexp_extract_all(text, F.lit(r"(?U)(\w+|[^\w\s])"), F.lit(1))


def approximate_tokens(text: Column) -> Column:
    """The larger of words plus marks, and a quarter of the length rounded up."""
    return F.greatest(F.size(tokens(text)), F.ceil(F.length(text) / 4).cast("int"))


def stripped(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def low_signal(text: Column) -> Column:
    """Blank, under half letters, under six distinct words of three letters, or over half of its tokens numbers."""
    bare = stripped(text)
    letters = F.length(F.regexp_replace(bare, r"\P{L}", ""))
    distinct = F.size(F.array_distinct(F.regexp_extract_all(F.lower(bare), F.lit(r"(\p{L}{3,})"), F.lit(1))))
    every = tokens(bare)
    numbers = F.size(F.filter(every, lambda x: x.rlike(r"^\p{Nd}+$")))
    return (F.length(bare) == 0) | (letters < 0.5 * F.length(bare)) | (distinct < 6) | (2 * numbers > F.size(every))


def word_count(text: Column) -> Column:
    """Words of two letters or more."""
    return F.size(F.regexp_extract_all(text, F.lit(r"(\p{L}{2,})"), F.lit(1)))


def whitespace_tokens(text: Column) -> Column:
    """Runs between white space."""
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda x: x != ""))


def embedding_input(breadcrumb: Column, passage: Column, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), breadcrumb, F.lit("\n\n"), passage)


def bounded(text: Column, size: int = 600) -> Column:
    """The first characters."""
    return F.substring(text, 1, size)


def one_line(text: Column, size: int = 160) -> Column:
    """White space runs as single blanks, cut to size with three dots."""
    flat = stripped(F.regexp_replace(text, r"(?U)\s+", " "))
    cut = F.concat(F.rtrim(F.substring(flat, 1, size)), F.lit("..."))
    return F.when(F.length(flat) > size, cut).otherwise(flat)


def centered_snippet(text: Column, words: list[str] | Column, size: int = 200) -> Column:
    """size characters from the earliest occurrence of a query word of two letters or more, stripped, with marks where text is cut.

    words: the query's own words, or a column of them. A text of size or less is returned as it is.
    """
    if isinstance(words, list):
        words = F.array(*map(F.lit, words)).cast("array<string>")
    asked = F.filter(F.flatten(F.transform(words, lambda w: terms(w))), lambda w: F.length(w) >= 2)
    low = F.lower(text)
    first = F.coalesce(F.array_min(F.filter(F.transform(asked, lambda w: F.instr(low, w)), lambda p: p > 0)), F.lit(1))
    start = F.greatest(F.lit(1), F.least(first, F.length(text) - size + 1))
    cut = stripped(F.substring(text, start, F.lit(size)))
    marked = F.concat(F.when(start > 1, "…").otherwise(""), cut, F.when(start + size - 1 < F.length(text), "…").otherwise(""))
    return F.when(F.length(text) <= size, text).otherwise(marked)


def lexical_score(bm25: Column) -> Column:
    """From 0 to 1, as search results show it: one over one plus the score."""
    return 1 / (1 + F.greatest(F.lit(0.0), bm25))


def candidate_id(path: Column, page: Column, start: Column, end: Column, span_hash: Column) -> Column:
    """24 hex digits of the SHA-256 of the location, its parts joined by NUL; a null part, or a zero, is empty."""
    known = lambda c: F.when(c.cast("string") == "0", "").otherwise(F.coalesce(c.cast("string"), F.lit("")))
    return F.substring(F.sha2(F.concat_ws("\u0000", path, known(page), known(start), known(end), span_hash), 256), 1, 24)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; 0 where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def truthy(value: Column) -> Column:
    """Whether a setting's text says yes."""
    return F.coalesce(F.lower(F.trim(value)).isin("1", "true", "yes", "on"), F.lit(False))


def line_of(text: Column, offset: Column) -> Column:
    """The line, from 1, that holds the character at offset, from 0."""
    return F.length(F.regexp_replace(F.substring(text, F.lit(1), offset), r"[^\n]", "")) + 1


def strategy_id(**parameters) -> str:
    """One name for everything that vectors depend on: the SHA-256 of the parameters as canonical JSON."""
    return "v1-" + hashlib.sha256(json.dumps(parameters, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
