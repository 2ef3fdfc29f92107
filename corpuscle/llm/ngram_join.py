"""Exact Jaccard join of word-shingle sets by T-occurrence search.

A set's partners must share at least T = ceil(similarity * size) of its shingles, so one of any size - T + 1 of them, and
the rarest serve best. Document frequencies are exact, counted over all documents: shingles are dealt to buckets as packed
arrays, and only those of two sets or more come back. A set whose unshared shingles alone number size - T + 1 is done;
the few others are indexed. Sets that share a rare shingle form clusters, tasks take clusters (large ones block against
block), and within a task each set merges its short inverted lists and probes the long ones (DivideSkip).

Sets are known by a 64-bit fingerprint and shingles by a 64-bit hash. Exact copies have one set and collapse before any
search; a group of copies of whatever size costs its rows once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship, shuffle_partitions, staged
from . import blobs
from .components import Forest, components
from .wordops import SPACED_LOWER, mix, run_starts, runs, sequence_hash, slices, utf8, words

WORDS = 5
PERCENT = 75
BUCKET_SHINGLES = 2_500_000
SORT_SHINGLES = 300_000
TASK_SHINGLES = 2_000_000
DIVIDE = 0.01
BROADCAST_ROWS = 500_000  # 8 MB of roots and totals
U64, I64, I32 = np.uint64, np.int64, np.int32


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, one text after another; each text's count; each set's fingerprint (0 if empty)."""
    data, offsets = utf8(column)
    hashes, _, _, first = words(data, offsets, SPACED_LOWER)
    at, counts = run_starts(first, k)
    found = runs(hashes, k)[at] if len(at) else np.zeros(0, U64)
    ends = np.cumsum(counts)
    out, sizes, prints = [], np.zeros(len(counts), I64), np.zeros(len(counts), U64)
    for i, (a, b, f, l) in enumerate(zip((ends - counts).tolist(), ends.tolist(), first[:-1].tolist(), first[1:].tolist())):
        if b > a:
            own = np.unique(found[a:b])
        elif l > f:
            own = np.array([sequence_hash(hashes[f:l])], U64)
        else:
            continue
        out.append(own)
        sizes[i] = len(own)
        prints[i] = mix(np.array([np.add.reduce(mix(own ^ U64(0x5851F42D4C957F2D))) + U64(len(own))], U64))[0]
    return np.concatenate(out) if out else np.zeros(0, U64), sizes, prints


def _members(k: int, keys: tuple[str, ...] = ()):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            _, sizes, prints = shingle_sets(batch.column(1), k)
            node = pa.array(prints.view(I64), mask=sizes == 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), node, pa.array(sizes), *batch.columns[2:]], ["doc_id", "node", "n_shingles", *keys])

    return run


SENT = ["bucket", "counts", "nodes", "sizes", "tokens"]
BACK = ["bucket", "counts", "nodes", "sizes", "tokens", "often"]


def _schema(names: list[str]) -> str:
    return ", ".join(f"{n} {'int' if n == 'bucket' else 'binary'}" for n in names)


def _send(k: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 0)):
            found, sizes, prints = shingle_sets(batch.column(0), k)
            kept = np.zeros(len(sizes), bool)
            kept[np.unique(prints, return_index=True)[1]] = True  # copies within the batch go once
            kept &= sizes > 0
            doc_of = np.repeat(np.arange(len(sizes)), sizes)
            use = kept[doc_of]
            found, doc_of = found[use], doc_of[use]
            yield blobs.batch(list(blobs.deal((found % U64(buckets)).astype(I64), buckets, doc_of, [prints, sizes.astype(I32)], [found])), SENT)

    return run


def _often(buckets: int):
    """Shingles of one bucket that two sets or more hold, sent to the buckets of their sets."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        counts = blobs.joined(rows["counts"], I32)
        doc_of = np.repeat(np.arange(len(counts), dtype=I32), counts)
        nodes, sizes, tokens = blobs.joined(rows["nodes"], U64), blobs.joined(rows["sizes"], I32), blobs.joined(rows["tokens"], U64)
        del rows
        shares = len(tokens) // SORT_SHINGLES + 1  # a share of the hashes at a time, so that sorting needs little memory
        share = (mix(tokens) >> U64(40)) % U64(shares)
        kept, held = [], []
        for i in range(shares):
            order = np.flatnonzero(share == i)
            order = order[np.lexsort((nodes[doc_of[order]], tokens[order]))]
            t, v = tokens[order], nodes[doc_of[order]]
            fresh = np.r_[True, (t[1:] != t[:-1]) | (v[1:] != v[:-1])] if len(t) else np.zeros(0, bool)
            order, t = order[fresh], t[fresh]
            start = np.flatnonzero(np.r_[True, t[1:] != t[:-1]]) if len(t) else np.zeros(0, I64)
            have = np.diff(np.r_[start, len(t)])
            have = np.repeat(have, have)
            kept.append(order[have > 1])
            held.append(have[have > 1])
        order, often = np.concatenate(kept), np.concatenate(held)
        by_doc = np.argsort(nodes[doc_of[order]], kind="stable")
        order, often = order[by_doc], often[by_doc]
        v = nodes[doc_of[order]]
        index = np.cumsum(np.r_[False, v[1:] != v[:-1]]) if len(v) else np.zeros(0, I64)
        at = np.flatnonzero(np.r_[True, v[1:] != v[:-1]]) if len(v) else np.zeros(0, I64)
        made = blobs.deal((mix(v) % U64(buckets)).astype(I64), buckets, index, [v[at], sizes[doc_of[order]][at]], [tokens[order], often.astype(I32)])
        return pd.DataFrame(list(made), columns=BACK)

    return run


def _rare(percent: int):
    """Sets of one bucket that may have partners: their shared shingles by rising frequency, and how many of those to look up."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        counts = blobs.joined(rows["counts"], I32)
        node = np.repeat(blobs.joined(rows["nodes"], U64), counts)
        size = np.repeat(blobs.joined(rows["sizes"], I32), counts)
        tokens, often = blobs.joined(rows["tokens"], U64), blobs.joined(rows["often"], I32)
        order = np.lexsort((tokens, often, node))
        node, size, tokens = node[order], size[order].astype(I64), tokens[order]
        at = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.zeros(0, I64)
        ends = np.r_[at[1:], len(node)] if len(node) else at
        n = size[at]
        look = n - -(-percent * n // 100) + 1 - (n - (ends - at))
        out = [(int(node[a].view(I64)), int(s), int(l), tokens[a:e].view(I64)) for a, e, s, l in zip(at.tolist(), ends.tolist(), n.tolist(), look.tolist()) if l > 0]
        return pd.DataFrame(out, columns=["node", "size", "look", "tokens"])

    return run


def merged(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places of sorted lists and how many lists hold each; a stable sort merges the lists as the runs they are."""
    places = np.sort(np.concatenate(lists), kind="stable")
    at = np.flatnonzero(np.r_[True, places[1:] != places[:-1]])
    return places[at], np.diff(np.r_[at, len(places)])


def divide_skip(lists: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places that at least `least` of the sorted lists hold, and in how many.

    The longest lists, as many as DivideSkip's rule sets aside, wait. The short ones are merged; a place found there often
    enough to reach `least` with the long ones is looked up in each of those by binary search. Time and memory go with the
    lists' lengths, not with the number of sets.
    """
    lists = sorted(lists, key=len)
    longest = len(lists[-1]) if lists else 0
    aside = min(least - 1, int(least / (DIVIDE * math.log2(longest + 1) + 1))) if longest > 1 else 0
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    if not short:
        return np.zeros(0, I64), np.zeros(0, I64)
    places, have = merged(short)
    near = have >= least - aside
    places, have = places[near], have[near]
    for own in long if len(places) else ():
        at = np.minimum(np.searchsorted(own, places), len(own) - 1)
        have = have + (own[at] == places)
    enough = have >= least
    return places[enough], have[enough]


def _search(percent: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "node"], kind="stable").drop_duplicates("node")
        nodes, sizes, both = rows["node"].tolist(), rows["size"].to_numpy(I64), rows["side"].to_numpy()
        lengths = np.array([len(t) for t in rows["tokens"]], I64)
        tokens = np.concatenate(rows["tokens"].tolist()) if len(rows) else np.zeros(0, I64)
        del rows
        owner = np.repeat(np.arange(len(nodes)), lengths)
        order = np.argsort(tokens, kind="stable")
        t = tokens[order]
        start = np.flatnonzero(np.r_[True, t[1:] != t[:-1]]) if len(t) else np.zeros(0, I64)
        end = np.r_[start[1:], len(t)] if len(t) else start
        which = np.empty(len(t), I64)
        which[order] = np.repeat(np.arange(len(start)), end - start)
        holders = owner[order]
        forest, edges, at = Forest(), [], 0
        linked = np.zeros(len(nodes), I64)
        for i in range(len(nodes)):
            own = which[at : at + lengths[i]]
            at += int(lengths[i])
            floor = int(np.searchsorted(sizes, -(-percent * sizes[i] // 100)))
            lists = []
            for a, b in zip(start[own].tolist(), end[own].tolist()):
                if b - a > 1:
                    part = holders[a:b]
                    part = part[np.searchsorted(part, floor) : np.searchsorted(part, i)]
                    if len(part):
                        lists.append(part)
            least = -(-percent * int(sizes[i]) // 100)
            if i == floor or len(lists) < least:
                continue
            places, have = divide_skip(lists, least)
            places = places[((100 + percent) * have >= percent * (sizes[i] + sizes[places])) & ((both[places] != both[i]) | (both[i] == 2))]
            linked[places] += 1
            linked[i] += len(places)
            edges += [(nodes[i], nodes[j], 0) for j in places.tolist() if forest.union(i, j)]
        edges += [(nodes[i], None, int(linked[i])) for i in np.flatnonzero(linked).tolist()]
        a, b, n = zip(*edges) if edges else ((), (), ())
        return pd.DataFrame({"a": pd.array(a, "Int64"), "b": pd.array(b, "Int64"), "n": pd.array(n, "Int64")})

    return run


def members(docs: DataFrame, k: int = WORDS, keys: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, node (the set's fingerprint; null without words), n_shingles, and the long columns keys."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keys).mapInArrow(_members(k, keys), ", ".join(["doc_id long, node long, n_shingles long", *(f"{c} long" for c in keys)]))


def links(docs: DataFrame, shingles: int, k: int = WORDS, percent: int = PERCENT, task_shingles: int = TASK_SHINGLES) -> DataFrame:
    """Links of different sets at the similarity: rows a, b that connect all that are connected, and rows a, null, n whose n add up to a's number of links.

    shingles: about how many there are. Every pair that links is found and verified in one task; only those that join two
    parts of what the task knows are listed, as a group's pairs grow with its square.
    """
    spark = docs.sparkSession
    ship(spark)
    buckets = max(shuffle_partitions(spark), -(-shingles // BUCKET_SHINGLES))
    sent = docs.select("text").mapInArrow(_send(k, buckets), _schema(SENT))
    often = sent.groupBy("bucket").applyInPandas(_often(buckets), _schema(BACK))
    rare = staged(often.groupBy("bucket").applyInPandas(_rare(percent), "node long, size long, look long, tokens array<long>"), "rare")
    looked = rare.select("node", F.explode(F.slice("tokens", 1, F.least("look", F.size("tokens")).cast("int"))).alias("token"))
    least = looked.groupBy("token").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most").drop("most")
    clusters = components(looked.join(least, "token").filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")))
    placed = staged(rare.drop("look").join(clusters, "node").withColumn("held", F.size("tokens")), "clustered")
    everything = placed.agg(F.sum("held")).first()[0] or 0
    bins = max(1, -(-everything * 2 // task_shingles))
    # clusters over a task's share: everything / task_shingles at most; the others need not be known
    big = staged(placed.groupBy("root").agg(F.sum("held").alias("total")).filter(F.col("total") > task_shingles), "big")
    small = big.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    sized = placed.join(F.broadcast(big) if small else big, "root", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("total") / task_shingles), F.lit(1)).cast("int"))
    small = sized.filter("blocks = 1").select(F.lit(-1).cast("long").alias("cluster"), F.pmod(F.xxhash64("root"), F.lit(bins)).cast("int").alias("i"), F.lit(0).alias("j"), F.lit(2).alias("side"), "node", "size", "tokens")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = sized.filter("blocks > 1").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pick = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    large = other.select(F.col("root").alias("cluster"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), pick.alias("side"), "node", "size", "tokens")
    return staged(small.unionByName(large).groupBy("cluster", "i", "j").applyInPandas(_search(percent), "a long, b long, n long"), "links")


def rooted(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, keys: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, n_links, root, least (the smallest doc_id that has root) of each row of docs, and its long columns keys.

    Rows of one root are those that links connect; a text without words has no root. n_links counts the other sets at the
    similarity; rows of one set, exact copies among them, are one.
    """
    spark = docs.sparkSession
    known = staged(members(docs, k, keys), "members")
    total = known.agg(F.sum("n_shingles").alias("n"), F.count("*").alias("rows")).first()
    found = links(docs, total["n"] or 0, k, percent)
    roots = components(found.filter("b IS NOT NULL"))
    counts = found.filter("b IS NULL").groupBy("a").agg(F.sum("n").alias("n_links"))
    sets = known.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("own"), F.count("*").alias("rows"))
    sets = staged(sets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "sets")
    # roots of very many sets, and sets of very many rows, would fill one task of a join: there are 4 a partition at most, and they are broadcast
    many = 1 + (total["rows"] or 0) // (4 * shuffle_partitions(spark))
    several = staged(sets.groupBy("root").agg(F.min("own").alias("least"), F.count("*").alias("parts")).filter("parts > 1"), "several")
    large = several.filter(F.col("parts") > many).drop("parts")
    others = sets.join(F.broadcast(large.select("root")), "root", "left_anti").join(several.drop("parts"), "root", "left")
    named = sets.join(F.broadcast(large), "root").select(others.columns).unionByName(others).join(counts, F.col("node") == counts["a"], "left")
    named = staged(named.select("node", "root", "rows", F.coalesce("least", "own").alias("least"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "named")
    hot = named.filter(F.col("rows") > many).drop("rows")
    cold = named.filter(F.col("rows") <= many).drop("rows")
    columns = ["doc_id", "n_shingles", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "root", "least", *keys]
    by_hot = known.join(F.broadcast(hot), "node").select(columns)
    by_cold = known.filter("node IS NOT NULL").join(F.broadcast(hot.select("node")), "node", "left_anti").join(cold, "node").select(columns)
    alone = known.filter("node IS NULL").withColumns({"n_links": F.lit(0), "root": F.col("node"), "least": F.col("node")}).select(columns)
    return by_hot.unionByName(by_cold).unionByName(alone)


def jaccard_components(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, keys: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links of the similarity), n_links of each row of docs, and its long columns keys.

    Only doc_id, text and keys are read. A text without words has no shingles and stands alone; one of fewer than k words is a
    single shingle. Equal sets are linked, so repeated rows and ties fall together; rows without doc_id take part and
    never name a component unless alone. n_links counts different sets, so copies add none. An empty table gives no rows.
    """
    out = rooted(docs, k, percent, keys)
    return out.select("doc_id", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"), "n_links", *keys)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
