"""What a corpus holds and what an index lacks: summaries of discovery, setup plans, and the state of an index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import index, store

INCLUDED, EXCLUDED = 500, 200


class NotSetUp(RuntimeError):
    """The corpus has no manifest yet, or a write was not approved."""


def summary(files: DataFrame) -> DataFrame:
    """included, role, format, reason, files, bytes: files (path, role, format, reason, bytes) counted by role, by format, by reason of exclusion and in all."""
    own = files.withColumn("included", F.col("reason").isNull())
    sets = [["included"], ["included", "role"], ["included", "format"], ["included", "reason"]]
    counted = own.groupingSets(sets, "included", "role", "format", "reason").agg(F.count("*").alias("files"), F.sum("bytes").cast("long").alias("bytes"), F.grouping_id().alias("set"))
    # grouping_id has a bit a column that is not grouped: roles and formats of what is included, reasons of what is not
    kept = F.when(F.col("set") == 6, ~F.col("included")).when(F.col("set") != 7, F.col("included")).otherwise(True)
    return counted.filter(kept).drop("set")


def samples(files: DataFrame, included: int = INCLUDED, excluded: int = EXCLUDED) -> DataFrame:
    """The first included and excluded files by role and path, so many of each: a report's samples, not its counts."""
    order = F.array_position(F.array(F.lit("editable"), F.lit("reference"), F.lit("mirror")), F.col("role"))
    some = lambda own, n: own.orderBy(order, "path").limit(max(0, n))
    return some(files.filter("reason IS NULL"), included).unionByName(some(files.filter("reason IS NOT NULL"), excluded))


def estimate(files: DataFrame, model: str | None = None, ready: bool = True) -> DataFrame:
    """One row: documents, bytes, model and whether it is at hand: what setting up will cost."""
    return files.filter("reason IS NULL").agg(F.count("*").alias("documents"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes")).withColumns({"model": F.lit(model).cast("string"), "model_ready": F.lit(ready)})


def setup(files: DataFrame, write: Callable[[DataFrame], None], approve: bool = False) -> DataFrame:
    """The plan of a setup, its estimate; only with approval is anything written."""
    plan = estimate(files)
    if approve:
        write(files.filter("reason IS NULL"))
    return plan


def checked(manifest) -> object:
    """The manifest, which every operation on a corpus but its setup needs."""
    if manifest is None:
        raise NotSetUp("set the corpus up first")
    return manifest


def hashes(stored: DataFrame, discovered: DataFrame) -> DataFrame:
    """path, file_hash now of all paths that are stored or discovered (path, content: binary or text); null where a file is gone."""
    now = discovered.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("file_hash"))
    return stored.select("path").unionByName(now.select("path")).distinct().join(now, "path", "left")


def status(tables: dict[str, DataFrame], now: DataFrame) -> DataFrame:
    """One row: documents, mirrors, chunks, vectors, and how many files (path, file_hash) were added, changed or deleted since; with the index's generation and revision."""
    docs = tables["documents"]
    known = index.metadata(tables["metadata"])
    stale = store.delta(docs, now).agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("added", "changed", "deleted")))
    one = docs.agg(F.count("*").alias("documents"), F.count_if(F.col("role") == "mirror").alias("mirrors"))
    for name in ("chunks", "vectors"):
        one = one.crossJoin(tables[name].agg(F.count("*").alias(name)))  # one row each
    facts = {"edit_generation": F.lit(known.get("edit_generation", 0)).cast("long"), "corpus_revision": F.lit(known.get("corpus_revision")).cast("string")}
    return one.crossJoin(stale).withColumns(facts | {"fresh": F.col("added") + F.col("changed") + F.col("deleted") == 0})
