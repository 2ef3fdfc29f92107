"""Postings packed into binary rows: what a task sends to one bucket goes as a few arrays, not as a row a posting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def deal(bucket: np.ndarray, buckets: int, doc_of: np.ndarray, per_doc: list[np.ndarray], per_item: list[np.ndarray]) -> Iterator[list]:
    """For each bucket with items: its number, the counts of items by document, per_doc values of those documents, per_item values.

    doc_of must not fall; within a bucket items keep their order.
    """
    order = np.argsort(bucket.astype(np.uint16) if buckets < 65536 else bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in range(buckets):
        own = order[edges[b] : edges[b + 1]]
        if not len(own):
            continue
        docs = doc_of[own]
        at = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
        counts = np.diff(np.r_[at, len(docs)]).astype(np.int32)
        yield [b, counts.tobytes(), *(v[docs[at]].tobytes() for v in per_doc), *(v[own].tobytes() for v in per_item)]


def batch(rows: list[list], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(columns)], names)


def joined(column, kind) -> np.ndarray:
    """The arrays of a binary column, one after another."""
    return np.frombuffer(b"".join(column), kind)
