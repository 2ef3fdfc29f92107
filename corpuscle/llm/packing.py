"""Sum-of-squares packing of token sequences.

Every document's ids are cut into pieces only where they exceed the capacity. Pieces are dealt by a hash into groups of
about GROUP pieces, however many documents there are and wherever they come from, and each group is packed alone: pieces
by falling length, each placed where the sum over residual gaps of (open bins with that gap) squared becomes smallest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship, staged
from .tokens import encoder, vocabulary
from .wordops import slices, utf8

CAPACITY = 2048
GROUP = 16_384
END = 0


def _cut(path: str, capacity: int, end: tuple[int, ...], with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tail = encoder(path).encode, np.array(end, "<u4").tobytes()
        for batch in (part for whole in batches for part in slices(whole, 1)):
            data, offsets = utf8(batch.column(1))
            at, names = offsets.tolist(), batch.column(0).to_pylist()
            out: list[tuple] = []
            for name, a, b in zip(names, at, at[1:]):
                ids = encode(data[a:b].tobytes()) + tail
                for k in range(0, max(len(ids), 1), 4 * capacity):
                    own = ids[k : k + 4 * capacity]
                    out.append((name, k // (4 * capacity), k // 4, len(own) // 4, zlib.crc32(own), *([np.frombuffer(own, "<i4")] if with_ids else [])))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.list_(pa.int32())] if with_ids else [])]
            columns = list(zip(*out)) if out else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])

    return run


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end: tuple[int, ...] = (END,), with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of each document's pieces of at most capacity tokens.

    Only doc_id and text are read. Null and empty texts give one piece of the end ids alone; a repeated row gives its
    pieces again; an empty table none.
    """
    ship(docs.sparkSession)
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return kept.mapInArrow(_cut(tokenizer or vocabulary(), capacity, end, with_ids), "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, placed in the order given; every length is from 1 to capacity.

    Moving a bin from gap g to g - s changes the sum of squares by 2 (N[g-s] - N[g] + 1); filling it by 1 - 2 N[g];
    opening one by 2 N[capacity - s] + 1. A new bin is opened only where no open bin has room: it would otherwise trade
    whole sequences for evenness. Ties go to the smallest gap.
    """
    count = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset, bins = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, s in enumerate(lengths.tolist()):
        if s == capacity:
            where[i], offset[i], bins = bins, 0, bins + 1
            continue
        have = count[s:capacity]
        change = 2 * (count[: capacity - s] - have + 1)
        change[0] = 1 - 2 * have[0]
        change[have == 0] = 1 << 60
        best = int(change.argmin())
        if change[best] == 1 << 60:
            gap, bin_ = capacity, bins
            bins += 1
        else:
            gap = best + s
            bin_ = open_bins[gap].pop()
            count[gap] -= 1
        where[i], offset[i] = bin_, capacity - gap
        if gap > s:
            count[gap - s] += 1
            open_bins[gap - s].append(bin_)
    return where, offset


def _pack(capacity: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        where, offset = sum_of_squares(rows["length"].to_numpy(), capacity)
        return rows.assign(sequence_id=(rows["group"].to_numpy() << 32) + where, offset=offset).drop(columns="group")

    return run


def pack(cut: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """cut with sequence_id and offset: sequences of at most capacity tokens, gapless from offset 0.

    Reads doc_id, piece, start, length, ids_crc32; lengths are from 1 to capacity. Rows are dealt by their number in cut,
    so repeated rows and rows without doc_id spread like all others, and the number of groups follows the number of pieces:
    a task's share is bounded. The same cut, in the same partitions, is packed the same way in each run.
    """
    spark = cut.sparkSession
    ship(spark)
    kept = staged(cut.select("doc_id", "piece", "start", "length", "ids_crc32", F.monotonically_increasing_id().alias("nth")), "pieces")
    groups = max(1, round(kept.count() / group))
    dealt = kept.withColumn("group", F.pmod(F.xxhash64("nth"), F.lit(groups))).drop("nth")
    return dealt.groupBy("group").applyInPandas(_pack(capacity), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op10_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False))
