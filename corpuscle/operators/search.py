"""Postings, BM25, nearest neighbours, fusion of ranks and their evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.text import query_terms, terms
from ..session import ship

CHANNEL = 200
RRF = 60
BLOCK = 8 << 20


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """term, key, tf, dl (terms of the text)."""
    own = docs.select(key, terms(F.col(text)).alias("terms"))
    return own.select(key, F.size("terms").alias("dl"), F.explode("terms").alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def bm25(docs: DataFrame, key: str | list[str], text: str, queries: DataFrame) -> DataFrame:
    """query_id, key, score of queries (query_id, query): the sum over query terms of idf times saturated frequency, k1 1.2, b 0.75.

    Only query terms' postings are built; lengths and document counts cover every text.
    """
    keys = [key] if isinstance(key, str) else key
    own = docs.select(*keys, terms(F.col(text)).alias("terms")).select(*keys, F.size("terms").alias("dl"), "terms")
    total = own.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    asked = queries.select("query_id", F.explode(query_terms(F.col("query"))).alias("term"))
    held = own.select(*keys, "dl", F.explode("terms").alias("term")).join(asked.select("term").distinct(), "term")
    held = held.groupBy("term", *keys, "dl").agg(F.count("*").alias("tf"))
    often = held.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    weight = F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("dl") / F.col("avgdl")))
    scored = held.join(often, "term").join(asked, "term").crossJoin(F.broadcast(total))  # total is one row
    return scored.groupBy("query_id", *keys).agg(F.sum(idf * weight).alias("score"))


def top(scored: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, numbered by rank; Spark keeps k a group before shuffling."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def _matrix(rows) -> np.ndarray:
    """Rows of numbers of one length, or of several, the shorter filled with zeros; a missing row is zeros."""
    rows = [np.asarray(r if r is not None else (), float) for r in rows]
    out = np.zeros((len(rows), max(map(len, rows), default=0)))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def _near(keys: list[str], block, k: int):
    """Each task's best k rows a query: it holds queries times k rows at most, whatever it reads."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best, (names, asked) = None, block.value
        for batch in batches:
            own = _matrix(batch["own"])
            width = max(own.shape[1], asked.shape[1])
            own, other = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (_unit(own), asked))
            score = np.round(own @ other.T, 9)
            score[batch["own"].isna().to_numpy()] = np.nan
            rank = np.arange(len(batch))[np.argsort(_order(batch, keys), kind="stable")]
            parts = []
            for q in range(score.shape[1]):
                by = rank[np.argsort(-np.nan_to_num(score[rank, q], nan=-np.inf), kind="stable")][:k]
                parts.append(batch[keys].iloc[by].assign(query=q, score=score[by, q]))
            best = pd.concat([*([best] if best is not None else []), *parts], ignore_index=True)
            if len(best) > 2 * k * max(len(names), 1):
                best = best.sort_values(["query", "score", *keys], ascending=[True, False, *[True] * len(keys)], kind="stable").groupby("query").head(k)
        if best is not None:
            yield best.assign(query_id=[names[q] for q in best["query"]])[["query_id", *keys, "score"]]

    return run


def _order(batch: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """The place of each row in the order of the keys."""
    place = np.empty(len(batch), int)
    place[batch[keys].reset_index(drop=True).sort_values(keys, kind="stable").index.to_numpy()] = np.arange(len(batch))
    return place


def nearest(vectors: DataFrame, key: str | list[str], vector: str, queries: DataFrame, k: int = CHANNEL, block: int = BLOCK) -> DataFrame:
    """query_id, key, score, rank of the k vectors most like each row of queries (query_id, vector), by cosine.

    query_id is to be unique. A query is held against every vector, its own included, as one matrix product a batch; queries
    go in blocks of about `block` bytes, one pass each. Vectors without length score 0, a null vector comes last.
    """
    spark, keys = vectors.sparkSession, [key] if isinstance(key, str) else key
    ship(spark)
    asked = queries.select("query_id", F.col(vector).alias("asked"))
    blocks = max(1, -(-(asked.agg(F.sum(8 * F.greatest(F.size("asked"), F.lit(0)) + 16)).first()[0] or 0) // block))
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    own = vectors.select(*keys, F.col(vector).alias("own"))
    kinds = ", ".join(f"`{n}` {f.dataType.simpleString()}" for n, f in [("query_id", queries.schema["query_id"]), *((x, vectors.schema[x]) for x in keys)])
    out = None
    for i in range(blocks):
        some = dealt.filter(F.col("block") == i).toPandas()  # a block's bytes at most
        known = spark.sparkContext.broadcast((some["query_id"].tolist(), _unit(_matrix(some["asked"]))))
        found = own.mapInPandas(_near(keys, known, k), f"{kinds}, score double")
        part = top(found, ["query_id"], [F.desc_nulls_last("score"), *map(F.asc, keys)], k)
        out = part if out is None else out.unionByName(part)
    return out.withColumn("score", F.when(~F.isnan("score"), F.col("score")))


def containing(docs: DataFrame, key: str, text: str, queries: DataFrame, block: int = BLOCK) -> DataFrame:
    """query_id, key of every text that holds a query (query_id, query) verbatim. Queries go in blocks of about `block` bytes, each broadcast."""
    asked = queries.select("query_id", "query").filter("query IS NOT NULL")
    blocks = max(1, -(-(asked.agg(F.sum(F.octet_length("query") + 16)).first()[0] or 0) // block))
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("query_id", "query"), F.lit(blocks)))
    own = docs.select(key, text)
    out = None
    for i in range(blocks):
        part = own.join(F.broadcast(dealt.filter(F.col("block") == i)), F.col(text).contains(F.col("query"))).select("query_id", key)
        out = part if out is None else out.unionByName(part)
    return out


def fuse(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Reciprocal-rank fusion of two ranked channels (keys, rank): left_rank, right_rank, score."""
    both = left.select(*keys, F.col("rank").alias("left_rank")).join(right.select(*keys, F.col("rank").alias("right_rank")), keys, "full_outer")
    part = lambda c: F.coalesce(1 / (RRF + F.col(c)), F.lit(0.0))
    return both.withColumn("score", part("left_rank") + part("right_rank"))


def evaluate(ranked: DataFrame, relevant: DataFrame, key: str, k: int = 8) -> DataFrame:
    """queries, mrr, recall over relevant (query_id, key): the reciprocal of the first hit's rank, and hits within k."""
    asked = relevant.select("query_id").distinct()
    hits = ranked.join(relevant, ["query_id", key], "left_semi").groupBy("query_id").agg(F.min("rank").alias("first"))
    return asked.join(hits, "query_id", "left").agg(F.count("*").alias("queries"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg(F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0))), 6).alias("recall"))
