"""The chunk index: chunks by section, their vectors, replacement document by document, and hybrid search over both channels."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import chunks, find, search

# A document of fewer words has no vectors; results a search; the vector size.
DOCUMENT_WORDS = 40
RESULTS = 8
SIZE = 64
CHUNK = ["path", "ordinal"]


def strategy(model: str = "hashed-words", size: int = SIZE, prefix: str = "") -> str:
    """The name of everything that vectors depend on; vectors of another name are made anew."""
    return X.strategy_id(model=model, dimensions=size, tokenizer="words-and-marks", max_tokens=chunks.MAX_TOKENS, hard_max_tokens=chunks.HARD_TOKENS, breadcrumb_format=chunks.CRUMBS, retrieval_prefix=prefix, low_signal=2)


def sections_of(docs: DataFrame) -> DataFrame:
    """Sections of all documents (path, format, content) by their formats; other formats have none."""
    kind = lambda *names: docs.filter(F.col("format").isin(*names)).select("path", "content")
    return find.sections(kind("markdown", "mdx")).unionByName(find.latex_sections(kind("latex"))).unionByName(find.bibtex_sections(kind("bibtex")))


def chunked(docs: DataFrame) -> DataFrame:
    """Chunks of documents (path, format, content), by section. A pdf has none: its mirror is indexed in its place."""
    own = docs.filter(F.col("format") != "pdf")
    return chunks.chunk(own, sections=sections_of(own))


def document_words(chunk: DataFrame) -> DataFrame:
    """path, words of each document, over its chunks."""
    return chunk.groupBy("path").agg(F.sum(X.word_count(F.col("text"))).alias("words"))


def embeddable(chunk: DataFrame) -> DataFrame:
    """Chunks that get a vector: neither low in signal themselves nor of a document of few words. The others are only searched by term."""
    enough = document_words(chunk).filter(F.col("words") >= DOCUMENT_WORDS).select("path")
    return chunk.filter(~X.low_signal(F.col("text"))).join(enough, "path", "left_semi")


def vectors(chunk: DataFrame, size: int = SIZE) -> DataFrame:
    """path, ordinal, vector, strategy_id."""
    ready = embeddable(chunk).select(*CHUNK, X.embedding_input(F.col("breadcrumb"), F.col("text")).alias("passage"))
    return chunks.embed(ready, CHUNK, "passage", size).withColumn("strategy_id", F.lit(strategy(size=size)))


def refreshed(vector: DataFrame, chunk: DataFrame, size: int = SIZE) -> DataFrame:
    """vector as it is where it follows the present strategy, else made anew from the chunks."""
    stale = vector.filter(F.col("strategy_id") != strategy(size=size)).limit(1).count()
    return vectors(chunk, size) if stale else vector


def unchanged(old: DataFrame, new: DataFrame, force: bool = False) -> DataFrame:
    """The rows of new (path, file_hash, role, format) that old has just so; none if forced."""
    keys = ["path", "file_hash", "role", "format"]
    same = new.join(old.select(*keys), [new[k].eqNullSafe(old[k]) for k in keys], "left_semi")
    return same.filter(F.lit(not force))


def replaced(table: DataFrame, arrivals: DataFrame, paths: DataFrame) -> DataFrame:
    """table without the rows of paths, and with arrivals: chunks or vectors of changed and removed documents go as one."""
    return table.join(paths.select("path").distinct(), "path", "left_anti").unionByName(arrivals.select(*table.columns))


def without(documents: DataFrame, gone: DataFrame) -> DataFrame:
    """documents without the paths gone, nor the mirrors generated from them."""
    names = gone.select("path").distinct()
    kept = documents.join(names, "path", "left_anti")
    return kept.join(names.withColumnRenamed("path", "generated_from"), "generated_from", "left_anti").select(*documents.columns)


def with_mirrors(documents: DataFrame, mirror: DataFrame, folder: str = "mirrors") -> DataFrame:
    """documents (path, role, format, content, file_hash) with generated_from, and a row of each pdf's mirror, which is what gets chunks."""
    made = mirror.select(
        F.concat(F.lit(f"{folder}/"), "path", F.lit(".md")).alias("path"), F.lit("mirror").alias("role"), F.lit("markdown").alias("format"), "content",
        F.sha2("content", 256).alias("file_hash"), F.col("path").alias("generated_from"),
    )
    return documents.withColumn("generated_from", F.lit(None).cast("string")).select(*made.columns).unionByName(made)


def update(index: dict[str, DataFrame], now: DataFrame, force: bool = False) -> dict[str, DataFrame]:
    """index (documents, chunks, vectors, metadata) after documents became now (path, role, format, content, file_hash).

    Only new and changed documents are chunked and embedded; those that are gone lose all their rows. The edit generation
    rises by one if anything changed, and the revision follows the documents.
    """
    from . import store

    old = index["documents"]
    work = now.join(unchanged(old, now, force).select("path"), "path", "left_anti")
    gone = old.join(now.select("path"), "path", "left_anti").select("path")
    touched = work.select("path").unionByName(gone)
    fresh = chunked(work)
    changed = not touched.isEmpty()
    documents = replaced(old, work.select(*old.columns), touched)
    known = metadata(index["metadata"])
    revision = store.revision(documents, ["path", "file_hash", "role"]).first()["revision"]
    facts = {"edit_generation": int(known.get("edit_generation", 0)) + int(changed), "corpus_revision": revision, "embedding_strategy_id": strategy()}
    return {
        "documents": documents, "chunks": replaced(index["chunks"], fresh, touched), "vectors": replaced(refreshed(index["vectors"], index["chunks"]), vectors(fresh), touched),
        "metadata": with_metadata(index["metadata"], facts),
    }


def empty(spark) -> dict[str, DataFrame]:
    """An index of nothing."""
    kinds = {
        "documents": "path string, role string, format string, content string, file_hash string", "chunks": chunks.CHUNKS,
        "vectors": "path string, ordinal int, vector array<double>, strategy_id string", "metadata": "key string, value string",
    }
    return {name: spark.createDataFrame([], kind) for name, kind in kinds.items()}


def metadata(table: DataFrame) -> dict:
    """The few facts kept beside an index."""
    return {r["key"]: json.loads(r["value"]) for r in table.collect()}


def with_metadata(table: DataFrame, facts: dict) -> DataFrame:
    """table (key, value in JSON) with facts in place of what it held under their keys."""
    kept = {**metadata(table), **facts}
    return table.sparkSession.createDataFrame([(k, json.dumps(v)) for k, v in sorted(kept.items())], "key string, value string")


def lexical(chunk: DataFrame, queries: DataFrame, k: int = search.CHANNEL) -> DataFrame:
    """query_id, path, ordinal, score, rank of the k best chunks a query by BM25 over breadcrumb and text."""
    whole = chunk.select(*CHUNK, F.concat_ws(" ", "breadcrumb", "text").alias("whole"))
    scored = search.bm25(whole, CHUNK, "whole", queries).withColumn("score", F.round("score", 9))
    return search.top(scored, ["query_id"], [F.desc("score"), *map(F.asc, CHUNK)], k)


def hybrid(chunk: DataFrame, vector: DataFrame, queries: DataFrame, roles: DataFrame | None = None, limit: int = RESULTS, size: int = SIZE) -> DataFrame:
    """Search results of queries (query_id, query): query_id, rank, path, ordinal, start_line, end_line, score, lexical_rank, vector_rank, lexical_score, vector_score, snippet, text.

    Both channels give their 200 best chunks; ranks are fused, and of results whose lines overlap the better stays. roles
    (path), where given, keeps those paths' results, after the channels were cut.
    """
    left = lexical(chunk, queries)
    right = search.nearest(vector, CHUNK, "vector", chunks.embed(queries, "query_id", "query", size))
    if roles is not None:
        left, right = (x.join(roles.select("path").distinct(), "path", "left_semi") for x in (left, right))
    keys = ["query_id", *CHUNK]
    left = left.select(*keys, F.col("rank").alias("lexical_rank"), X.lexical_score(F.col("score")).alias("lexical_score"))
    right = right.select(*keys, F.col("rank").alias("vector_rank"), F.col("score").alias("vector_score"))
    part = lambda c: F.coalesce(1 / (search.RRF + F.col(c)), F.lit(0.0))
    both = left.join(right, keys, "full_outer").withColumn("score", F.round(part("lexical_rank") + part("vector_rank"), 12))
    ranked = search.top(both, ["query_id"], [F.desc("score"), *map(F.asc, CHUNK)], 2 * search.CHANNEL)
    placed = ranked.join(chunk.select(*CHUNK, "start_line", "end_line"), CHUNK)
    kept = chunks.collapse(placed, ("query_id",)).withColumnRenamed("rank", "before")
    best = search.top(kept, ["query_id"], [F.asc("before")], limit).drop("before")
    shown = best.join(chunk.select(*CHUNK, "text"), CHUNK).join(queries.select("query_id", "query"), "query_id")
    snippet = X.centered_snippet(F.col("text"), F.split("query", r"\s+"))
    return shown.withColumn("snippet", snippet).select("query_id", "rank", *CHUNK, "start_line", "end_line", "score", "lexical_rank", "vector_rank", "lexical_score", "vector_score", "snippet", "text")
