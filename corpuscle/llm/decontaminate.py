"""Benchmark decontamination by suffix arrays of the training text.

Each task builds a suffix array over its own documents, a few megabytes at a time, and binary-searches the suffixes of the
benchmark's items in it; the places found are compared on, word by word, to the longest verbatim match. The array holds the
places at which some item's window starts, told by hashes of windows, as a match can start at no other; likewise only the
suffixes whose window the text has are searched. The benchmark goes to the tasks in blocks of at most BLOCK bytes.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship, staged
from .wordops import ALNUM_LOWER, run_starts, runs, slices, spread, utf8, words

WINDOW = 10
BLOCK = 16 << 20
I64 = np.int64


class Items:
    """One block of benchmark items: their words as codes, and their windows by length and hash."""

    def __init__(self, names: list[str], texts: list[str], window: int = WINDOW):
        hashes, _, _, first = words(*utf8(pa.array(texts, pa.string())), ALNUM_LOWER)
        self.names, self.first = names, first
        self.vocabulary = np.unique(hashes)
        self.known = np.zeros(1 << 20, bool)
        self.known[(self.vocabulary & np.uint64((1 << 20) - 1)).astype(I64)] = True
        self.codes = np.searchsorted(self.vocabulary, hashes) + 1
        counts = np.diff(first)
        #: By length of windows: their hashes, sorted, and the places in the items that have them.
        self.windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in np.unique(np.minimum(counts[counts > 0], window)).tolist():
            at = spread(first[:-1], np.where(counts >= window, counts - window + 1, 0) if n == window else (counts == n).astype(I64))
            found = runs(hashes, n)[at]
            order = np.argsort(found, kind="stable")
            self.windows[n] = found[order], at[order]

    def code(self, hashes: np.ndarray) -> np.ndarray:
        """1 and up for words that some item has, else 0."""
        out = np.zeros(len(hashes), I64)
        if len(self.vocabulary):
            near = np.flatnonzero(self.known[(hashes & np.uint64((1 << 20) - 1)).astype(I64)])
            at = np.minimum(np.searchsorted(self.vocabulary, hashes[near]), len(self.vocabulary) - 1)
            out[near] = np.where(self.vocabulary[at] == hashes[near], at + 1, 0)
        return out


def suffix_array(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """starts ordered by the suffixes of text there; a suffix ends at the next 0 of text. By prefix doubling."""
    rank, step = text.astype(I64), 1
    live = text > 0
    while True:
        after = np.zeros_like(rank)
        after[:-step] = rank[step:]
        key = np.where(live, rank * (int(rank.max()) + 1) + after, 0)
        distinct, new = np.unique(key, return_inverse=True)
        if len(distinct) == len(np.unique(rank)) or step > len(text):
            return starts[np.argsort(rank[starts], kind="stable")]
        # a suffix that reached its 0 within step words keeps its order: after is 0 there
        rank, step = new.astype(I64), step * 2
        if step >= len(text):
            return starts[np.argsort(rank[starts], kind="stable")]


def matched(text: np.ndarray, places: np.ndarray, pattern: np.ndarray, known: int) -> np.ndarray:
    """How many words from each place of text equal the pattern's; the first `known` do. text ends with a 0, as each document does."""
    length = np.full(len(places), known, I64)
    going, step = np.arange(len(places)), 32
    while len(going) and known < len(pattern):
        part = pattern[known : known + step]
        at = places[going][:, None] + np.arange(known, known + len(part))
        same = text[np.minimum(at, len(text) - 1)] == part
        more = np.where(same.all(axis=1), len(part), same.argmin(axis=1))
        length[going] += more
        going = going[more == len(part)]
        known += len(part)
    return length


def find(items: Items, column: pa.Array) -> tuple[np.ndarray, list[np.ndarray], list[tuple[int, int, int, int, int]]]:
    """Of each text: how many words, and the words that are hit, as its word indexes; and the longest match of each text with each item.

    A match is a text, an item, the text's word, the item's word, a length; of equally long ones the first, by text, stands.
    """
    hashes, _, _, first = words(*utf8(column), ALNUM_LOWER)
    totals, none = np.diff(first), np.zeros(0, I64)
    hit: list[np.ndarray] = [none] * len(totals)
    if not items.windows or not len(hashes):
        return totals, hit, []
    codes = items.code(hashes)
    starts: dict[int, np.ndarray] = {}
    for n, (known, _) in items.windows.items():
        at, _ = run_starts(first, n)
        live = np.cumsum(np.r_[0, codes == 0])
        at = at[live[at + n] == live[at]]  # all words of the window are some item's
        found = runs(hashes, n)[at] if len(at) else np.zeros(0, np.uint64)
        near = np.minimum(np.searchsorted(known, found), len(known) - 1)
        if len(own := at[known[near] == found]):
            starts[n] = own
    if not starts:
        return totals, hit, []
    # the text around these places: from each place to the next word that no item has, or the document's end
    stop = np.zeros(len(codes) + 1, bool)
    stop[np.flatnonzero(codes == 0)] = True
    stop[first[1:]] = True
    stops = np.flatnonzero(stop)
    begin = np.unique(np.concatenate(list(starts.values())))
    end = stops[np.searchsorted(stops, begin, "right")]
    fresh = np.r_[True, end[1:] != end[:-1]]
    begin, end = begin[fresh], end[fresh]
    at = np.r_[0, np.cumsum(end - begin + 1)[:-1]]
    size = int((end - begin + 1).sum())
    text, back = np.zeros(size, I64), np.zeros(size, I64)
    word, place = spread(begin, end - begin), spread(at, end - begin)
    text[place], back[place] = codes[word], word
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    covered = np.zeros(len(codes) + 1, I64)
    raw = text.astype(">u4").tobytes()
    for n, own in starts.items():
        to = np.searchsorted(begin, own, "right") - 1
        array = suffix_array(text, at[to] + own - begin[to])
        order = array.tolist()
        known, places = items.windows[n]
        asked = places[np.isin(known, np.unique(runs(hashes, n)[own]))]  # suffixes whose window the text has
        for j in asked.tolist():
            i = int(np.searchsorted(items.first, j, "right")) - 1
            pattern = items.codes[j : int(items.first[i + 1])]
            key = pattern[:n].astype(">u4").tobytes()
            lo = bisect.bisect_left(order, key, key=lambda x: raw[4 * x : 4 * x + 4 * n])
            hi = bisect.bisect_right(order, key, lo=lo, key=lambda x: raw[4 * x : 4 * x + 4 * n])
            if hi == lo:
                continue
            found = array[lo:hi]
            length = matched(text, found, pattern, n)
            start = back[found]
            np.add.at(covered, start, 1)
            np.add.at(covered, start + length, -1)
            doc = np.searchsorted(first, start, "right") - 1
            by_doc = np.lexsort((start, -length, doc))
            top = by_doc[np.r_[True, doc[by_doc][1:] != doc[by_doc][:-1]]]
            for d, s, m in zip(doc[top].tolist(), start[top].tolist(), length[top].tolist()):
                new = (-m, s - int(first[d]), j - int(items.first[i]))
                if new < best.get((d, i), (1, 0, 0)):
                    best[d, i] = new
    under = np.flatnonzero(np.cumsum(covered) > 0)
    doc = np.searchsorted(first, under, "right") - 1
    for d in np.unique(doc).tolist():
        hit[d] = under[np.searchsorted(doc, d) : np.searchsorted(doc, d, "right")] - first[d]
    return totals, hit, [(d, i, s, j, -m) for (d, i), (m, s, j) in sorted(best.items())]


def blocks(benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> Iterator[Items]:
    """The benchmark, `block` bytes or one longer item at a time; items without words match nothing. Ids are read as strings."""
    names, texts, have = [], [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        if names and have + len(row[1] or "") > block:
            yield Items(names, texts, window)
            names, texts, have = [], [], 0
        names.append(row[0] if row[0] is not None else "null")
        texts.append(row[1] or "")
        have += len(row[1] or "")
    if names:
        yield Items(names, texts, window)


_SPAN = [("start", pa.int64()), ("n_words", pa.int64())]
_MATCH = [("item_id", pa.string()), ("doc_start", pa.int64()), ("item_start", pa.int64()), ("n_words", pa.int64())]
FOUND = (
    "row long, doc_id long, n_words long, hits array<struct<start:long,n_words:long>>, "
    "matches array<struct<item_id:string,doc_start:long,item_start:long,n_words:long>>"
)


def _stretches(hit: np.ndarray) -> list[dict]:
    """start, n_words of the runs of consecutive numbers."""
    if not len(hit):
        return []
    at = np.flatnonzero(np.r_[True, np.diff(hit) > 1])
    return [{"start": a, "n_words": n} for a, n in zip(hit[at].tolist(), np.diff(np.r_[at, len(hit)]).tolist())]


def _find(items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 2)):
            totals, hit, matches = find(items.value, batch.column(2))
            own: list[list] = [[] for _ in totals]
            for doc, item, at, start, n in matches:
                own[doc].append({"item_id": items.value.names[item], "doc_start": at, "item_start": start, "n_words": n})
            hits = pa.array([_stretches(x) for x in hit], pa.list_(pa.struct(_SPAN)))
            columns = [batch.column(0), batch.column(1), pa.array(totals), hits, pa.array(own, pa.list_(pa.struct(_MATCH)))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_words", "hits", "matches"])

    return run


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, hits (start, n_words), matches (item_id, doc_start, item_start, n_words) of each row of docs.

    Only doc_id and text, item_id and text are read. hits are the stretches of words under windows; with a benchmark of
    several blocks they may overlap. matches has, of each item found, the longest verbatim match of at least a window, or of
    a whole shorter item; of equally long ones the first by place in the text, then in the item. Null and empty texts have no words and no matches; an item without words matches nothing; repeated
    rows and items each match for themselves. An empty benchmark leaves all rows without matches.
    """
    spark = docs.sparkSession
    ship(spark)
    kept = docs.select(F.lit(0).cast("long").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    found, several = None, False
    for items in blocks(benchmark, window, block):
        if found is not None and not several:  # rows must be told apart to be met again
            kept, several = staged(kept.withColumn("row", F.monotonically_increasing_id()), "numbered"), True
            found = kept.mapInArrow(_find(first), FOUND)
        first = spark.sparkContext.broadcast(items)
        part = kept.mapInArrow(_find(first), FOUND)
        found = found.unionByName(part) if found is not None else part
    if found is None:
        found = kept.mapInArrow(_find(spark.sparkContext.broadcast(Items([], [], window))), FOUND)
    if several:
        found = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), *(F.flatten(F.collect_list(c)).alias(c) for c in ("hits", "matches")))  # a row a block
    return found.select("doc_id", "n_words", "hits", "matches")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hit, count, digest = [], [], []
        for hits, own in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            covered, reach = 0, 0
            for a, n in sorted((m["start"], m["n_words"]) for m in hits):
                covered += max(0, a + n - max(a, reach))
                reach = max(reach, a + n)
            names = sorted({m["item_id"] for m in own})
            hit.append(covered)
            count.append(len(names))
            digest.append(hashlib.sha256(",".join(names).encode()).hexdigest())
        columns = [batch.column(0), batch.column(1), pa.array(hit, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string()), pa.array([h > 0 for h in hit], pa.bool_())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def _clean(items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.schema.get_field_index("text")
            for part in slices(batch, text):
                yield part.filter(pa.array([not len(x) for x in find(items.value, part.column(text))[1]], pa.bool_()))

    return run


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """The rows of docs, all columns, whose text holds no window of the benchmark."""
    ship(docs.sparkSession)
    for items in blocks(benchmark, window, block):
        docs = docs.mapInArrow(_clean(docs.sparkSession.sparkContext.broadcast(items)), docs.schema)
    return docs


def op3_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.mapInArrow(_digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
OP3_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
i AS (SELECT item_id, unnest(range(greatest(len(w) - 9, 1))) AS j, w FROM b WHERE len(w) > 0),
v AS (SELECT DISTINCT item_id, array_to_string(w[j + 1 : j + 10], ' ') AS g, least(len(w), 10) AS n FROM i),
k AS (SELECT DISTINCT n FROM v),
p AS (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS s FROM d, k WHERE len(w) >= n),
h AS (SELECT doc_id, s, p.n, item_id FROM p JOIN v ON v.g = array_to_string(w[s + 1 : s + p.n], ' ') AND v.n = p.n),
c AS (SELECT doc_id, count(DISTINCT s + x) AS n_hit FROM h, range(10) t(x) WHERE x < n GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS name FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""
