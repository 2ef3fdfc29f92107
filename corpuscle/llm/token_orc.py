"""Token ids as ORC: whole texts encoded, written in ascending document order, and read back with global positions.

Layout: range-partitioned on doc_id, one or more ORC files a partition, each row one document. ORC writes the ids with
its integer run-length encoding, a row index every ROW_INDEX rows and a Bloom filter on doc_id, so that stripes are read
in parallel and point or range lookups on doc_id skip stripes and row groups from metadata alone. Positions within the
whole corpus come from one small table of partition totals, kept beside the data.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_path, ship, shuffle_partitions
from .tokens import END_ID, encoder, vocabulary
from .wordops import slices, utf8

ROW_INDEX = 1000
STRIPE = 32 << 20
RANGE_CHARS = 12
ORC = {
    "compression": "zstd",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": str(ROW_INDEX),
    "orc.stripe.size": str(STRIPE),
}
SCHEMA = "doc_id long, part int, first long, n_tokens long, ids array<int>"


def _encode(path: str, end: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, first = encoder(path).encode, TaskContext.get().partitionId(), 0
        tail = np.array(end, "<u4").tobytes()
        for batch in (piece for whole in batches for piece in slices(whole, 1)):
            data, offsets = utf8(batch.column(1))
            at = offsets.tolist()
            got = [encode(data[a:b].tobytes()) + tail for a, b in zip(at, at[1:])]
            sizes = np.array([len(x) // 4 for x in got], np.int64)
            before = first + np.cumsum(sizes) - sizes
            first += int(sizes.sum())
            values = pa.Array.from_buffers(pa.int32(), int(sizes.sum()), [None, pa.py_buffer(b"".join(got))])
            ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(got), part, np.int32)), pa.array(before), pa.array(sizes), ids], ["doc_id", "part", "first", "n_tokens", "ids"])

    return run


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end: tuple[int, ...] = (END_ID,)) -> None:
    """Encode every whole text (null: empty), append the end ids, and write ORC in ascending doc_id order.

    Only doc_id and text are read; further columns may have any name. A null doc_id sorts first. Rows of one doc_id are
    ordered by text, so ties are settled the same way in each run, and repeated rows each keep a row of their own. Many
    rows of one doc_id, or without one, are split by how their texts begin. An empty table writes no rows. Lost tasks are run again from the range shuffle; nothing is kept outside the shared path.
    """
    spark = docs.sparkSession
    ship(spark)
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    lead = F.substring("text", 1, RANGE_CHARS)  # bounds of ranges go through the driver, so whole texts may not be keys
    ranged = kept.repartitionByRange(shuffle_partitions(spark), F.col("doc_id").asc_nulls_first(), lead)
    ordered = ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ordered.mapInArrow(_encode(tokenizer or vocabulary(), end), SCHEMA).write.format("orc").options(**ORC).save(f"{path}/data")
    rows(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("total"), F.count("*").alias("documents"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).coalesce(1).write.parquet(f"{path}/parts")


def rows(spark: SparkSession, path: str) -> DataFrame:
    """The written documents; a filter on doc_id is answered from row indexes and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(f"{path}/data")


def starts(spark: SparkSession, path: str) -> DataFrame:
    """part, base: ids of all partitions before it. One row a partition, so one task orders them."""
    from pyspark.sql import Window

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return spark.read.parquet(f"{path}/parts").select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).cast("long").alias("base"))


def positioned(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids. The table of partition starts has a row a partition."""
    return rows(spark, path).join(starts(spark, path), "part").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        at = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1].tolist() if len(lists) else [0]
        values = lists.values
        raw = values.buffers()[1]
        ids = memoryview(raw).cast("B") if raw is not None else memoryview(b"")
        skip = values.offset
        crc = [zlib.crc32(ids[4 * (a + skip) : 4 * (b + skip)]) for a, b in zip(at, at[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def digest(df: DataFrame) -> DataFrame:
    """positioned() rows with ids replaced by the unsigned crc32 of their little-endian 32-bit form."""
    ship(df.sparkSession)
    return df.mapInArrow(_checksums, T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")]))


def op2_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return digest(positioned(spark, path))
