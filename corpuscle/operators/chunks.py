"""Token-budgeted chunks, hashed embeddings and the collapse of overlapping results: order-dependent folds, in Arrow batches."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

# The budgets of a chunk, and what counts as a token.
MAX_TOKENS = 400
HARD_TOKENS = 480
_TOKEN = re.compile(r"\w+|[^\w\s]")
CRUMBS = " > "
CHUNKS = "path string, ordinal int, breadcrumb string, start_line int, end_line int, page int, token_count int, text string"


class TokenBudgetError(ValueError):
    """A breadcrumb alone exceeds the budget."""


def count_tokens(text: str) -> int:
    return max(len(_TOKEN.findall(text)), -(-len(text) // 4))


def embedding_input(breadcrumb: str, passage: str, prefix: str = "") -> str:
    return f"{prefix}{breadcrumb}\n\n{passage}"


class _Budget:
    """What a passage under one breadcrumb costs. Tokens never span white space, so costs of whole words and lines add up."""

    def __init__(self, breadcrumb: str):
        self.tokens, self.chars = len(_TOKEN.findall(breadcrumb)), len(breadcrumb) + 2

    def cost(self, tokens: int, chars: int) -> int:
        return max(self.tokens + tokens, -(-(self.chars + chars) // 4))

    def of(self, text: str) -> int:
        return self.cost(len(_TOKEN.findall(text)), len(text))

    def filled(self, parts: list[tuple[int, int]], target: int, gap: int) -> Iterator[tuple[int, int]]:
        """from, to of runs of parts (tokens, characters), as long as fit the target; between parts lie gap characters."""
        first = tokens = chars = 0
        for i, (t, c) in enumerate(parts):
            if i > first and self.cost(tokens + t, chars + gap + c) > target:
                yield first, i
                first, tokens, chars = i, t, c
            else:
                tokens, chars = tokens + t, chars + c + (gap if i > first else 0)
        if len(parts) > first:
            yield first, len(parts)

    def split(self, line: str, target: int, hard: int) -> Iterator[str]:
        """A line over the target in runs of words; a run still over the hard limit, one long word, by characters."""
        words = re.findall(r"\S+\s*", line) or [line]
        for a, e in self.filled([(len(_TOKEN.findall(w)), len(w)) for w in words], target, 0):
            piece = "".join(words[a:e])
            if self.of(piece) <= hard:
                yield piece
                continue
            starts = [0 if (i and piece[i - 1].isalnum() | (piece[i - 1] == "_")) and (c.isalnum() or c == "_") else int(not c.isspace()) for i, c in enumerate(piece)]
            at = tokens = 0
            for i, fresh in enumerate(starts):
                fresh = 1 if i == at and not piece[i].isspace() else fresh  # a cut word starts a token anew
                if i > at and self.cost(tokens + fresh, i + 1 - at) > target:
                    yield piece[at:i]
                    at, tokens, fresh = i, 0, int(not piece[i].isspace())
                tokens += fresh
            yield piece[at:]


def pieces(lines: list[str], breadcrumb: str = "", target: int = MAX_TOKENS, hard: int = HARD_TOKENS) -> list[tuple[str, int, int]]:
    """(text, first line, last line), lines counted from 0, of chunks that fill the target with whole lines.

    A line over the target gives chunks of its own, of whole words; a word over the hard limit is cut by characters. Nothing
    is lost: lines within a chunk are joined by a line break, and chunks of one line follow each other.
    """
    if target <= 0 or hard < target:
        raise ValueError("chunk limits must be positive, the hard one no less than the target")
    budget = _Budget(breadcrumb)
    if budget.cost(0, 0) > hard:
        raise TokenBudgetError(breadcrumb)
    sizes = [(len(_TOKEN.findall(x)), len(x)) for x in lines]
    out: list[tuple[str, int, int]] = []
    first = 0
    for i in range(len(lines) + 1):
        if i < len(lines) and budget.cost(*sizes[i]) <= target:
            continue
        out += [("\n".join(lines[first + a : first + e]), first + a, first + e - 1) for a, e in budget.filled(sizes[first:i], target, 1)]
        if i < len(lines):
            out += [(piece, i, i) for piece in budget.split(lines[i], target, hard)]
        first = i + 1
    return out


def text_lines(text: str) -> list[str]:
    """Lines without their breaks; a break at the end starts no further line, and an empty text is one empty line."""
    return text.removesuffix("\n").split("\n")


def pack_lines(text: str, breadcrumb: str = "", target: int = MAX_TOKENS, hard: int = HARD_TOKENS) -> list[tuple[str, int, int]]:
    """(text, first line, last line) of the chunks of a text, lines counted from 1."""
    return [(t, a + 1, b + 1) for t, a, b in pieces(text_lines(text), breadcrumb, target, hard)]


def chunk(docs: DataFrame, target: int = MAX_TOKENS, hard: int = HARD_TOKENS, sections: DataFrame | None = None) -> DataFrame:
    """CHUNKS of each document (path, content), numbered from 0; an empty or null document has one, of no text.

    sections (path, breadcrumb, start_line, end_line), where given, are chunked one by one, and a text without any as a
    whole. The page is that of a section named Page and a number.
    """
    ship(docs.sparkSession)
    kept = docs.select("path", F.coalesce("content", F.lit("")).alias("content"))
    if sections is not None:
        own = F.array_sort(F.collect_list(F.struct("start_line", "end_line", "breadcrumb"))).alias("sections")  # of one document
        kept = kept.join(sections.groupBy("path").agg(own), "path", "left")
    else:
        kept = kept.withColumn("sections", F.lit(None))

    def rows(path: str, content: str, own) -> Iterator[tuple]:
        lines, ordinal = text_lines(content), 0
        spans = [(s["start_line"], s["end_line"], s["breadcrumb"]) for s in own] if own is not None and len(own) else [(1, len(lines), "")]
        for first, last, crumb in spans:
            number = re.fullmatch(r"Page (\d+)", crumb.rsplit(CRUMBS, 1)[-1])
            for text, a, b in pieces(lines[first - 1 : last] or [""], crumb, target, hard):
                yield path, ordinal, crumb, first + a, first + b, int(number[1]) if number else None, count_tokens(embedding_input(crumb, text)), text
                ordinal += 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in CHUNKS.split(", ")]
        for batch in batches:
            out = [r for p, c, s in zip(batch["path"], batch["content"], batch["sections"]) for r in rows(p, c, s)]
            yield pd.DataFrame(out, columns=names).astype({"page": "Int32"})

    return kept.mapInPandas(run, CHUNKS)


def embed_text(text: str, size: int) -> list[float]:
    """Hashed bag of words: each word's SHA-256 picks a place and a sign; the sum has length 1."""
    out = [0.0] * size
    for word in re.findall(r"\w+", text.lower()):
        h = hashlib.sha256(word.encode()).digest()
        out[int.from_bytes(h[:8], "big") % size] += -1.0 if h[8] & 1 else 1.0
    norm = math.sqrt(sum(x * x for x in out))
    return [x / norm for x in out] if norm else out


def embed(rows: DataFrame, keys: str | list[str], text: str, size: int = 64) -> DataFrame:
    """The keys, and the vector of each row's text. Any other embedder may take embed_text's place: text and size in, numbers out."""
    ship(rows.sparkSession)
    keys = [keys] if isinstance(keys, str) else keys

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[keys].assign(vector=[embed_text(t or "", size) for t in batch[text]])

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.select(*keys, text).mapInPandas(run, f"{kinds}, vector array<double>")


def collapse(ranked: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows (by, path, start_line, end_line, rank) that overlap no better-ranked row kept before them on their path; a path has few."""
    groups = [*by, "path"]
    others = ["rank", *(c for c in ranked.columns if c not in ("rank", *groups))]
    rows = F.array_sort(F.collect_list(F.struct(*others)))
    apart = lambda kept, x: ~F.exists(kept, lambda y: (x["start_line"] <= y["end_line"]) & (y["start_line"] <= x["end_line"]))
    fold = F.aggregate("rows", F.slice("rows", 1, 0), lambda kept, x: F.when(apart(kept, x), F.concat(kept, F.array(x))).otherwise(kept))
    out = ranked.groupBy(*groups).agg(rows.alias("rows")).select(*groups, F.explode(fold).alias("row"))
    return out.select(*groups, "row.*").select(*ranked.columns)
