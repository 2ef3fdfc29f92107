"""Repeated word spans by a compacted de Bruijn graph of token k-mers.

A window of WINDOW words is an edge of the graph, from the node of its first WINDOW - 1 words to the node of its last. Only
edges that occur again matter, and few do, so candidates come first: every window holds, among its SEED-word runs, one least
by hash, equal windows hold the same one, and only windows whose least run occurs again anywhere are sent.

Each distinct edge has its source, the first place where it occurs. Edges that follow each other in a source are a run; runs
are cut at branching nodes, those that several distinct edges enter or leave, found by joining edges to the degrees of nodes.
The segments left meet at nodes; where one alone ends and one alone starts there, they are joined, and pointer jumping
compacts such chains to unbranched paths. A later occurrence is a piece of a path; its words are compared with those at its
source, by SHA-256 of both, before they go; pieces of a document that take up where others end are its long spans.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from ..session import ship, shuffle_partitions, staged
from . import blobs
from .wordops import SPACED, mix, run_starts, runs, slices, utf8, words

WINDOW = 20
SEED = 8
FILTER_BITS = 1 << 28
FILTER_PARTS = 256
BROADCAST_ROWS = 1_000_000
BUCKET_BYTES = 4 << 20  # of text a bucket of edges stands for
U64, I64, I32, U32 = np.uint64, np.int64, np.int32, np.uint32


def seeds(hashes: np.ndarray, first: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word index of each window, of the least seed run in it (the leftmost of equals), and all seed runs' hashes."""
    at, _ = run_starts(first, window)
    short = runs(hashes, seed)
    if not len(at):
        return at, at, short
    place = np.arange(len(hashes) - window + 1)
    least, where = short[: len(place)].copy(), place.copy()
    for j in range(1, window - seed + 1):
        other = short[j : j + len(place)]
        less = other < least
        np.copyto(least, other, where=less)
        np.copyto(where, place + j, where=less)
    return at, where[at], short


def _chosen(window: int, seed: int, parts: int, buckets: int):
    """The least runs' hashes, dealt so that a bucket's all belong to one part of the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 0)):
            hashes, _, _, first = words(*utf8(batch.column(0)), SPACED)
            _, where, short = seeds(hashes, first, window, seed)
            found = short[where[np.r_[True, where[1:] != where[:-1]]]] if len(where) else np.zeros(0, U64)
            bucket = (found % U64(parts) + U64(parts) * (mix(found ^ U64(0x2545F4914F6CDD1D)) % U64(-(-buckets // parts)))).astype(I64)
            yield blobs.batch([[b, t] for b, _, _, t in blobs.deal(bucket, -(-buckets // parts) * parts, np.zeros(len(found), I64), [np.zeros(1, I64)], [found])], ["bucket", "hashes"])

    return run


def _again(parts: int, buckets: int, bits: int):
    """Of one bucket, the bits of runs that occur twice or more."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = np.sort(blobs.joined(rows["hashes"], U64))
        found = np.unique(found[1:][found[1:] == found[:-1]])
        at = np.unique((mix(found) % U64(bits // parts)).astype(U32))
        return pd.DataFrame({"part": [int(rows["bucket"].iloc[0]) % parts], "places": [at.tobytes()]})

    return run


def _share(parts: int, bits: int):
    """One part of the filter, its bits set."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        mask = np.zeros(bits // parts, bool)
        for own in rows["places"]:
            mask[np.frombuffer(own, U32)] = True
        return pd.DataFrame({"bucket": [int(rows["part"].iloc[0])], "share": [zlib.compress(np.packbits(mask).tobytes(), 1)]})

    return run


class Filter:
    """Tells which runs may occur again: never wrong about one that does. Its size is fixed, whatever the corpus."""

    def __init__(self, shares: dict[int, bytes], buckets: int, bits: int):
        self.shares, self.buckets, self.bits, self._open = shares, buckets, bits, None

    def __getstate__(self):
        return self.__dict__ | {"_open": None}

    def __call__(self, found: np.ndarray) -> np.ndarray:
        share = self.bits // self.buckets
        wide = (share + 7) // 8
        if self._open is None:
            self._open = np.zeros(self.buckets * wide, np.uint8)
            for b, x in self.shares.items():
                self._open[b * wide : (b + 1) * wide] = np.frombuffer(zlib.decompress(x), np.uint8)
        bit = (mix(found) % U64(share)).astype(I64)
        byte = self._open[(found % U64(self.buckets)).astype(I64) * wide + (bit >> 3)]
        return (byte >> (7 - (bit & 7)).astype(np.uint8)) & 1 == 1


SENT = ["bucket", "counts", "docs", "keys", "froms", "tos", "places"]
EDGES = "kind int, bucket int, counts binary, docs binary, keys binary, places binary, froms binary, tos binary, sources binary, source_places binary"
LATER, FIRST, NODE = 0, 1, 2


def _schema(names: list[str]) -> str:
    return ", ".join(f"{n} {'int' if n == 'bucket' else 'binary'}" for n in names)


def _send(window: int, seed: int, buckets: int, again):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 2)):
            hashes, _, _, first = words(*utf8(batch.column(2)), SPACED)
            at, where, short = seeds(hashes, first, window, seed)
            doc_of = np.repeat(np.arange(batch.num_rows), np.maximum(np.diff(first) - window + 1, 0))
            use = again.value(short[where]) if len(where) else np.zeros(0, bool)
            at, doc_of = at[use], doc_of[use]
            nodes = runs(hashes, window - 1)
            a, b = (nodes[at], nodes[at + 1]) if len(at) else (np.zeros(0, U64), np.zeros(0, U64))
            ids = np.array(batch.column(0).fill_null(-(1 << 63)), I64)
            keys = np.array(batch.column(1), I64)
            places = (at - first[:-1][doc_of]).astype(I32)
            bucket = (mix(a ^ mix(b)) % U64(buckets)).astype(I64)
            yield blobs.batch(list(blobs.deal(bucket, buckets, doc_of, [ids, keys], [a, b, places])), SENT)

    return run


def _dealt(kind: int, key: np.ndarray, buckets: int, doc: np.ndarray, text: np.ndarray, columns: dict[str, np.ndarray]) -> Iterator[dict]:
    """EDGES rows of one kind, by bucket of key; doc and text are kept once for each run of equal ones."""
    if not len(doc):
        return
    new = np.r_[True, (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])]
    at, index = np.flatnonzero(new), np.cumsum(new) - 1
    names = ["bucket", "counts", "docs", "keys", *columns]
    for row in blobs.deal((mix(key) % U64(buckets)).astype(I64), buckets, index, [doc[at], text[at]], list(columns.values())):
        yield {"kind": kind} | dict(zip(names, row))


def _name(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """64 bits for a document's id and text, half of what both take; a source's words are compared later, so a false name does no harm."""
    return mix(doc.view(U64) ^ mix(key.view(U64)))


def _edges(buckets: int):
    """Edges of one bucket that occur again: each later place with its edge's first, and each first place with its nodes, to their documents; each first place to its edge's nodes."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        counts = blobs.joined(rows["counts"], I32)
        doc = np.repeat(blobs.joined(rows["docs"], I64), counts)
        key = np.repeat(blobs.joined(rows["keys"], I64), counts)
        a, b, place = blobs.joined(rows["froms"], U64), blobs.joined(rows["tos"], U64), blobs.joined(rows["places"], I32)
        del rows
        order = np.lexsort((place, doc, b, a))
        doc, key, a, b, place = doc[order], key[order], a[order], b[order], place[order]
        fresh = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
        source = np.flatnonzero(fresh)[np.cumsum(fresh) - 1] if len(a) else np.zeros(0, I64)
        later = np.flatnonzero((doc != doc[source]) | (place != place[source]))
        own = np.unique(source[later])
        later = later[np.lexsort((place[later], key[later], doc[later]))]
        own = own[np.lexsort((place[own], key[own], doc[own]))]
        s = source[later]
        out = list(_dealt(LATER, doc[later].view(U64), buckets, doc[later], key[later], {"places": place[later], "sources": _name(doc[s], key[s]), "source_places": place[s]}))
        out += _dealt(FIRST, doc[own].view(U64), buckets, doc[own], key[own], {"places": place[own], "froms": a[own], "tos": b[own]})
        out += _dealt(NODE, a[own], buckets, doc[own], key[own], {"places": place[own], "froms": a[own]})
        none = np.zeros(len(own), I64)  # of edges that enter a node, only their number matters
        out += _dealt(NODE, b[own], buckets, none, none, {"tos": b[own]})
        return pd.DataFrame(out, columns=[x.split()[0] for x in EDGES.split(", ")])

    return run


CUTS = "doc_id long, text_key long, place int, node long"


def _branching(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket's nodes, those that several distinct edges enter or leave: each first place of an edge that leaves one."""
    leave, enter = rows[rows["froms"].notna()], rows[rows["tos"].notna()]
    counts = blobs.joined(leave["counts"], I32)
    doc, key = np.repeat(blobs.joined(leave["docs"], I64), counts), np.repeat(blobs.joined(leave["keys"], I64), counts)
    place, node = blobs.joined(leave["places"], I32), blobs.joined(leave["froms"], U64)
    into = np.sort(blobs.joined(enter["tos"], U64))
    ordered = np.sort(node)
    degree = lambda sorted_nodes: np.searchsorted(sorted_nodes, node, "right") - np.searchsorted(sorted_nodes, node)
    cut = (degree(ordered) > 1) | (degree(into) > 1)
    return pd.DataFrame({"doc_id": doc[cut], "text_key": key[cut], "place": place[cut], "node": node[cut].view(I64)})


PATHS = "doc_id long, text_key long, start int, edges int, source long, source_start int, from_node long, to_node long"


def _runs(rows: pd.DataFrame) -> pd.DataFrame:
    """Runs of one bucket's edges: of later places, as far as place and source advance together, and of first places, with the nodes at both ends."""
    later, first = rows[rows["kind"] == LATER], rows[rows["kind"] == FIRST]
    out = []
    for own, is_first in ((later, False), (first, True)):
        if not len(own):
            continue
        counts = blobs.joined(own["counts"], I32)
        doc, key = np.repeat(blobs.joined(own["docs"], I64), counts), np.repeat(blobs.joined(own["keys"], I64), counts)
        place = blobs.joined(own["places"], I32)
        if is_first:
            a, b = blobs.joined(own["froms"], U64).view(I64), blobs.joined(own["tos"], U64).view(I64)
            to, at = _name(doc, key).view(I64), place
        else:
            to, at = blobs.joined(own["sources"], I64), blobs.joined(own["source_places"], I32)
            a = b = np.zeros(len(doc), I64)
        order = np.lexsort((place, key, doc))
        doc, key, place, to, at, a, b = (x[order] for x in (doc, key, place, to, at, a, b))
        keep = np.r_[True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (place[1:] != place[:-1])]
        doc, key, place, to, at, a, b = (x[keep] for x in (doc, key, place, to, at, a, b))  # repeated rows say the same
        new = np.r_[True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (place[1:] != place[:-1] + 1) | (to[1:] != to[:-1]) | (at[1:] != at[:-1] + 1)]
        s = np.flatnonzero(new)
        e = np.r_[s[1:], len(doc)]
        made = {"doc_id": doc[s], "text_key": key[s], "start": place[s], "edges": (e - s).astype(I32), "source": to[s], "source_start": at[s]}
        nodes = {"from_node": pd.array(a[s], "Int64"), "to_node": pd.array(b[e - 1], "Int64")} if is_first else {c: pd.array([None] * len(s), "Int64") for c in ("from_node", "to_node")}
        out.append(pd.DataFrame(made | nodes))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=[x.split()[0] for x in PATHS.split(", ")])


class Graph:
    """The repeated edges of a corpus: runs of later places, runs of first places, and the cuts at branching nodes. A null doc_id is the least long."""

    def __init__(self, docs: DataFrame, window: int = WINDOW, seed: int = SEED, filter_bits: int = FILTER_BITS):
        spark = docs.sparkSession
        ship(spark)
        keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
        chars = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = max(shuffle_partitions(spark), -(-chars // BUCKET_BYTES))
        parts = min(buckets, FILTER_PARTS)
        bits = filter_bits // parts // 8 * 8 * parts
        chosen = keyed.select("text").mapInArrow(_chosen(window, seed, parts, buckets), "bucket int, hashes binary")
        shares = chosen.groupBy("bucket").applyInPandas(_again(parts, buckets, bits), "part int, places binary")
        shares = staged(shares, "filter")
        merged = shares.groupBy("part").applyInPandas(_share(parts, bits), "bucket int, share binary")
        again = spark.sparkContext.broadcast(Filter({r[0]: bytes(r[1]) for r in merged.collect()}, parts, bits))  # filter_bits at most
        sent = keyed.mapInArrow(_send(window, seed, buckets, again), _schema(SENT))
        edges = staged(sent.groupBy("bucket").applyInPandas(_edges(buckets), EDGES), "edges")
        found = staged(edges.filter(F.col("kind") != NODE).groupBy("bucket").applyInPandas(_runs, PATHS), "runs")
        self.cuts = staged(edges.filter(F.col("kind") == NODE).groupBy("bucket").applyInPandas(_branching, CUTS), "cuts")
        self.later = found.filter("from_node IS NULL").drop("from_node", "to_node")
        self.first = found.filter("from_node IS NOT NULL").select("doc_id", "text_key", "source", "start", "edges", "from_node", "to_node")


def segments(graph: Graph) -> DataFrame:
    """doc_id, text_key, source (a name of both), start, edges, from_node, to_node: the runs of first places, cut at branching nodes."""
    run = graph.first.select("*", (F.col("start") + F.col("edges")).alias("end"))
    inside = graph.cuts.withColumnsRenamed({"doc_id": "d", "text_key": "k"})
    at = (F.col("doc_id") == F.col("d")) & (F.col("text_key") == F.col("k")) & (F.col("place") > F.col("start")) & (F.col("place") < F.col("end"))
    cut = run.join(inside, at).select("doc_id", "text_key", "source", "start", "place", "node", "end", "to_node")
    whole = run.select("doc_id", "text_key", "source", "start", F.col("start").alias("place"), F.col("from_node").alias("node"), "end", "to_node")
    by = Window.partitionBy("doc_id", "text_key", "start").orderBy("place")
    parts = cut.unionByName(whole).withColumn("until", F.coalesce(F.lead("place").over(by), "end")).withColumn("into", F.coalesce(F.lead("node").over(by), "to_node"))
    return parts.select("doc_id", "text_key", "source", F.col("place").alias("start"), (F.col("until") - F.col("place")).alias("edges"), F.col("node").alias("from_node"), F.col("into").alias("to_node"))


def compacted(graph: Graph) -> DataFrame:
    """segments with path, the unbranched path that each belongs to: the first segment's id; of a circle, that of the least.

    Two segments join where one alone ends at a node and one alone starts there; pointer jumping takes each to its path's
    head in as many rounds as the longest chain has binary digits, and a circle, which has no head, to its least member.
    """
    own = staged(segments(graph).withColumn("id", F.xxhash64("doc_id", "text_key", "start")), "segments")
    alone = lambda node: own.groupBy(F.col(node).alias("node")).agg(F.count("*").alias("n"), F.min("id").alias(node)).filter("n = 1").drop("n")
    meet = alone("to_node").withColumnRenamed("to_node", "before").join(alone("from_node").withColumnRenamed("from_node", "after"), "node")
    links = meet.filter("before <> after").select(F.col("after").alias("id"), F.col("before").alias("up"))
    now = staged(own.select("id").join(links, "id", "left").select("id", "up", F.least("id", F.coalesce("up", "id")).alias("least")), "up")
    left, rounds = now.filter("up IS NOT NULL").count(), 0
    while left and (1 << rounds) <= left:
        ahead = now.select(F.col("id").alias("up"), F.col("up").alias("further"), F.col("least").alias("other"))
        jumped = now.filter("up IS NOT NULL").join(ahead, "up").select("id", F.coalesce("further", "up").alias("up"), F.least("least", "other").alias("least"), F.col("further").isNull().alias("ended"))
        # a segment whose way has ended keeps its head; one still on the way goes on from there
        heads = now.filter("up IS NULL").withColumn("ended", F.lit(True))
        now = staged(heads.unionByName(jumped).select("id", "up", "least", "ended"), "up")
        if now.filter("NOT ended").isEmpty():
            break
        rounds += 1
    ended = F.col("ended") if "ended" in now.columns else F.lit(True)
    path = F.when(ended, F.coalesce("up", "id")).otherwise(F.col("least"))
    return own.join(now.select("id", path.alias("path")), "id").drop("id")


def pieces(graph: Graph) -> DataFrame:
    """doc_id, text_key, at, edges, source_doc, source_key, source_at, path: later runs by the segments that their sources lie on."""
    seg = compacted(graph).select("source", F.col("doc_id").alias("source_doc"), F.col("text_key").alias("source_key"), F.col("start").alias("from"), (F.col("start") + F.col("edges")).alias("until"), "path")
    run = graph.later.withColumn("source_end", F.col("source_start") + F.col("edges"))
    on = run.join(seg, "source").filter((F.col("from") < F.col("source_end")) & (F.col("until") > F.col("source_start")))
    begin, end = F.greatest("from", "source_start"), F.least("until", "source_end")
    return on.select("doc_id", "text_key", (F.col("start") + begin - F.col("source_start")).alias("at"), (end - begin).alias("edges"), "source_doc", "source_key", begin.alias("source_at"), "path")


def _sha(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lo: int, hi: int) -> bytes:
    """128 bits of the SHA-256 of the words from lo to hi, joined by one blank."""
    return hashlib.sha256(b" ".join(data[starts[lo] : ends[hi - 1]].tobytes().split())).digest()[:16] if lo < hi else b""


def _digests(window: int):
    """The hash of the words under each stretch of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 2)):
            data, offsets = utf8(batch.column(2))
            _, starts, ends, first = words(data, offsets, SPACED)
            rows = []
            for i, (doc, key, own) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist())):
                a, b = int(first[i]), int(first[i + 1])
                rows += [(doc, key, x["at"], x["edges"], _sha(data, starts, ends, a + x["at"], min(a + x["at"] + x["edges"] + window - 1, b))) for x in own]
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], SOURCES)

    return run


SOURCES = ["source_doc", "source_key", "source_at", "edges", "digest"]


def sourced(docs: DataFrame, found: DataFrame, window: int = WINDOW) -> DataFrame:
    """found (pieces) with digest, the hash of the words at their sources. Only documents that are sources are read."""
    asked = found.select(*SOURCES[:4]).distinct()
    grouped = staged(asked.groupBy("source_doc", "source_key").agg(F.collect_list(F.struct(F.col("source_at").alias("at"), "edges")).alias("own")), "asked")  # within one document
    least = F.lit(-(1 << 63))
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), least).alias("source_doc"), F.xxhash64("text").alias("source_key"), "text")
    names = grouped.select("source_doc", "source_key")
    if names.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:  # 16 MB; with more, all texts are shuffled
        keyed = keyed.join(F.broadcast(names), ["source_doc", "source_key"], "left_semi")
    one = keyed.join(grouped, ["source_doc", "source_key"]).select("source_doc", "source_key", "text", "own")
    sums = one.mapInArrow(_digests(window), "source_doc long, source_key long, source_at int, edges int, digest binary").distinct()
    return found.join(sums, SOURCES[:4]).select(*found.columns, "digest")


def spans(found: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text_key, start, n_words: the long spans of pieces of which one takes up at the node where another ends, or before.

    One sort a document, by place: a piece that starts beyond all before it starts a span.
    """
    by = Window.partitionBy("doc_id", "text_key").orderBy("at", "edges")
    reach = F.max(F.col("at") + F.col("edges")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    fresh = (F.col("at") > F.coalesce(reach, F.lit(-1))).cast("int")
    island = F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, 0))
    own = found.select("doc_id", "text_key", "at", "edges").withColumn("fresh", fresh).withColumn("island", island)
    long = own.groupBy("doc_id", "text_key", "island").agg(F.min("at").alias("start"), F.max(F.col("at") + F.col("edges")).alias("end"))
    return long.select("doc_id", "text_key", "start", (F.col("end") - F.col("start") + window - 1).alias("n_words"))


def _cut(window: int, with_text: bool):
    """Each text without the words under its pieces, of those that read as their sources do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            data, offsets = utf8(batch.column(1))
            _, starts, ends, first = words(data, offsets, SPACED)
            total, gone, digests, texts = np.diff(first), [], [], []
            for i, own in enumerate(batch.column(2).to_pylist()):
                a, b = int(first[i]), int(first[i + 1])
                keep = np.ones(b - a, bool)
                for s in own or ():
                    lo, hi = s["at"], s["at"] + s["edges"] + window - 1
                    if a + hi <= b and _sha(data, starts, ends, a + lo, a + hi) == s["digest"]:
                        keep[lo:hi] = False
                raw = data[offsets[i] : offsets[i + 1]].tobytes()
                if keep.all():
                    text = b" ".join(raw.split())  # bytes.split() splits at the same six bytes
                else:
                    text = b" ".join(raw[x:y] for x, y in zip((starts[a:b][keep] - offsets[i]).tolist(), (ends[a:b][keep] - offsets[i]).tolist()))
                gone.append(int((~keep).sum()))
                digests.append(hashlib.sha256(text).hexdigest())
                if with_text:
                    texts.append(text.decode())
            columns = [batch.column(0), pa.array(total), pa.array(gone, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(texts, pa.string())] if with_text else []), ["doc_id", "n_words", "n_removed", "kept_sha256"] + (["kept"] if with_text else []))

    return run


def without_pieces(docs: DataFrame, found: DataFrame, window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept) of each row of docs, the words under sourced pieces gone where they read as their sources do."""
    grouped = found.groupBy(F.col("doc_id").alias("span_doc"), "text_key").agg(F.collect_list(F.struct("at", "edges", "digest")).alias("spans"))  # within one document
    least = F.lit(-(1 << 63))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), least).alias("span_doc"), F.xxhash64("text").alias("text_key"))
    fields = [("doc_id", T.LongType()), ("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_sha256", T.StringType()), *([("kept", T.StringType())] if with_text else [])]
    return keyed.join(grouped, ["span_doc", "text_key"], "left").select("doc_id", "text", "spans").mapInArrow(_cut(window, with_text), T.StructType([T.StructField(*f) for f in fields]))


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept, the words left joined by one space) of each row of docs.

    Only doc_id and text are read. A null text has no words; texts shorter than a window keep all. A window goes if the
    same words start at a smaller doc_id or earlier under the same doc_id; a null doc_id is smaller than all. Repeated
    rows have the same places, so each keeps what the first keeps. An empty table gives no rows.
    """
    found = sourced(docs, staged(pieces(Graph(docs, window, seed)), "pieces"), window)
    return without_pieces(docs, found, window, with_text)


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)


OP9_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x09-\x0D ]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(len(w) - 19)) AS i FROM d WHERE len(w) >= 20),
g AS (SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + 20], ' ')) AS h FROM p),
s AS (SELECT h, min({'d': doc_id, 'i': i}) AS m FROM g GROUP BY h),
r AS (SELECT doc_id, i FROM g JOIN s USING (h) WHERE doc_id <> m.d OR i <> m.i),
c AS (SELECT DISTINCT doc_id, i + k AS j FROM r, range(20) t(k)),
x AS (SELECT doc_id, list(j) AS gone FROM c GROUP BY doc_id),
e AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS j FROM d),
k AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY j) AS kept FROM e ANTI JOIN c ON e.doc_id = c.doc_id AND e.j = c.j GROUP BY e.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id) LEFT JOIN k USING (doc_id)
"""
