"""Document quality by Bradley-Terry ranking of preference pairs.

A pair is a document labelled 1 against one labelled 0; the model's chance that the first is preferred is the logistic
function of the difference of their scores, which are linear in features of the text alone. The training sample is
bounded per label (SAMPLE rows), drawn by a hash; all else covers all rows: usual words are counted over all documents, and
the threshold is the score quantile, at the share of label 0, of all labelled rows that may be learned from. Scores are
shifted so that it lies at ACCEPT.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship, staged
from .wordops import SPACED_LOWER, slices, table, utf8, words

SAMPLE = 8000
PAIRS = 60_000
COMMON = 400
BROADCAST_ROWS = 1_000_000
ACCEPT = 0.3
RIDGE = 1e-3
_LINES = table(b"\n", False)
_CLASS = np.zeros(256, np.int64)
for _i, _set in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b"#*$%&|<>", b".,", b"!?;:'\"()-", b"@/_=+~^\\[]{}`"), 1):
    _CLASS[list(_set)] = _i
_CLASS[128:] = 10


def _repeated(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many of each document's hashes equal an earlier one of it."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    same = np.r_[False, (h[1:] == h[:-1]) & (d[1:] == d[:-1])] if len(h) else np.zeros(0, bool)
    return np.bincount(d[same], minlength=len(first) - 1)


def features(column: pa.Array, common: np.ndarray) -> np.ndarray:
    """One row of numbers a text. common: sorted hashes of the most usual words."""
    data, offsets = utf8(column)
    n = len(offsets) - 1
    size = np.diff(offsets)
    kinds = np.zeros((n, 11))
    if size.sum():
        doc = np.repeat(np.arange(n, dtype=np.int32), size)
        kinds = np.bincount(doc * np.int64(11) + _CLASS[data[offsets[0] : offsets[-1]]], minlength=11 * n).reshape(n, 11).astype(float)
        del doc
    hashes, starts, ends, first = words(data, offsets, SPACED_LOWER)
    count = np.diff(first).astype(float)
    line_hash, line_at, line_end, line_first = words(data, offsets, _LINES)
    lines = np.diff(line_first).astype(float)
    doc = np.repeat(np.arange(n), np.diff(first))
    length = (ends - starts).astype(float)
    often = np.bincount(doc[np.isin(hashes, common, kind="sort")], minlength=n) if len(hashes) else np.zeros(n)
    total, square = np.bincount(doc, length, n), np.bincount(doc, length**2, n)
    w, b, l = np.maximum(count, 1), np.maximum(size, 1), np.maximum(lines, 1)
    mean = total / w
    spread = np.sqrt(np.maximum(square / w - mean**2, 0))
    repeats, same_lines = _repeated(hashes, first) / w, _repeated(line_hash, line_first) / l
    shares = kinds / b[:, None]
    return np.column_stack([shares, np.sqrt(shares), np.log1p(count), np.log1p(count) ** 2, mean, np.log(mean + 1), spread, repeats, repeats**2, same_lines, np.sqrt(same_lines), often / w, np.log1p(lines), np.log1p(count / l), count == 0, count < 20])


@dataclass
class Ranker:
    common: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    threshold: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        if not len(self.weight):
            return np.zeros(len(x))
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weight

    def score(self, column: pa.Array) -> np.ndarray:
        """From 0 to 1; ACCEPT at the threshold."""
        z = self.strength(features(column, self.common)) - self.threshold + np.log(ACCEPT / (1 - ACCEPT))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def usual(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The COMMON most frequent of the hashes, sorted."""
    return np.sort(hashes[np.lexsort((hashes, -counts))[:COMMON]])


def learn(common: np.ndarray, x: np.ndarray, good: np.ndarray, share_bad: float, pairs: int = PAIRS, seed: int = 7) -> Ranker:
    """Fit to features and whether each is preferred. With one label only, every text gets the same score, above ACCEPT."""
    if not len(good) or good.all() or not good.any():
        return Ranker(common, np.zeros(0), np.ones(0), np.zeros(0), -1.0)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    difference = z[rng.choice(np.flatnonzero(good), pairs)] - z[rng.choice(np.flatnonzero(~good), pairs)]
    weight = np.zeros(z.shape[1])
    for _ in range(12):  # Newton's method on the mean logistic loss of the pairs
        p = 1 / (1 + np.exp(-np.clip(difference @ weight, -30, 30)))
        gradient = difference.T @ (p - 1) / pairs + RIDGE * weight
        curve = (difference * (p * (1 - p))[:, None]).T @ difference / pairs + RIDGE * np.eye(len(weight))
        weight -= np.linalg.solve(curve, gradient)
    strength = z @ weight
    each = np.where(good, (1 - share_bad) / good.sum(), share_bad / (~good).sum())
    order = np.argsort(strength, kind="stable")
    below = int(np.searchsorted(np.cumsum(each[order]), share_bad))
    below = min(below, len(order) - 2)
    return Ranker(common, mean, scale, weight, float((strength[order[below]] + strength[order[below + 1]]) / 2))


def remainder(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole, 0)):
        names, counts = np.unique(words(*utf8(batch.column(0)), SPACED_LOWER)[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(counts, pa.int64())], ["hash", "n"])


def _features(common: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 2)):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(features(batch.column(2), common)), pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ranker:
    """Fit on at most `sample` rows a label, those of least hash, whose doc_id's crc32 leaves a remainder by 5.

    Rows without doc_id or quality teach nothing. If a doc_id is labelled or stored more than once, each row counts. Without
    labels of both kinds all texts get one score, above ACCEPT.
    """
    ship(docs.sparkSession)
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id IS NOT NULL AND quality IN (0, 1)").filter(remainder() != 0)
    share = usable.agg(F.avg(1 - F.col("quality"))).first()[0] or 0.0
    chosen = None
    for value in (0, 1):
        part = usable.filter(F.col("quality") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    rows = staged(kept.select("doc_id", "quality", F.coalesce("text", F.lit("")).alias("text")), "sample")
    counts = docs.select("text").mapInArrow(_counts, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "hash").limit(COMMON).toPandas()
    common = usual(counts["hash"].to_numpy(np.int64).view(np.uint64), counts["n"].to_numpy())
    got = rows.mapInArrow(_features(common), "doc_id long, quality int, x array<double>").toPandas()
    x = np.array(got["x"].tolist(), float).reshape(len(got), -1) if len(got) else np.zeros((0, 1))
    order = np.lexsort((*x.T[::-1], got["quality"], got["doc_id"])) if len(got) else np.zeros(0, int)
    ranker = learn(common, x[order], got["quality"].to_numpy()[order] == 1, share)
    if not len(ranker.weight):
        return ranker
    ids = usable.select("doc_id").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL")
    if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:  # 16 MB; with more labels all texts are scored, and numbers joined
        texts = texts.join(F.broadcast(ids), "doc_id", "left_semi")
    strong = texts.mapInArrow(_strength(docs.sparkSession.sparkContext.broadcast(ranker)), "doc_id long, strength double")
    last = strong.join(usable, "doc_id").agg(F.percentile_approx("strength", share, 100_000)).first()[0]
    return replace(ranker, threshold=float(np.nextafter(last, np.inf)))


def _strength(ranker):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            own = ranker.value
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.strength(features(batch.column(1), own.common)))], ["doc_id", "strength"])

    return run


def _score(ranker):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ranker.value.score(batch.column(1)))], ["doc_id", "score"])

    return run


def _keep(ranker, accept: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.schema.get_field_index("text")
            for part in slices(batch, text):
                yield part.filter(pa.array(ranker.value.score(part.column(text)) >= accept))

    return run


def scored(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """doc_id, score of each row; a null text scores as an empty one. Only doc_id and text are read."""
    ship(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(ranker)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_score(known), "doc_id long, score double")


def accepted(docs: DataFrame, ranker: Ranker, accept: float = ACCEPT) -> DataFrame:
    """The rows of docs, all columns, that score at least accept."""
    ship(docs.sparkSession)
    return docs.mapInArrow(_keep(docs.sparkSession.sparkContext.broadcast(ranker), accept), docs.schema)


def op5_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = scored(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", F.coalesce(remainder() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
