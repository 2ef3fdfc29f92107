"""WARC archives: written with Spark's text writer, read back by boundary-chain verification.

A record is a UTF-8 string, and the text writer ends it with the blank lines that WARC asks for. Reading trusts no magic
string: tasks over blocks of a file emit every place that parses as a record header with the place after it, and each
place's exit from its block. Pointer jumping over the few places where blocks are entered, from the file's start, finds
the true chain; a header inside a payload is never on it and is dropped. A chain that does not end at its file's end is
an error, so a damaged archive never reads as a shorter one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path, ship, shuffle_partitions, staged

LEAST_SHARED = 100
FILE_BYTES = 32 << 20
FILE_RECORDS = 2048
BLOCK = 4 << 20
AHEAD = 1 << 18
BROADCAST_ROWS = 100_000
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
_HEAD = re.compile(rb"WARC/1\.[01]\r\n((?:[!-9;-~]+:[^\r\n]*\r\n)+)\r\n")
_LENGTH = re.compile(rb"(?:^|\n)content-length:[ \t]*(\d+)[ \t]*\r\n", re.IGNORECASE)
CANDIDATES = "path string, block long, offset long, successor long, exit long, page_id string, kind string, refers_to string, payload_from long, payload_bytes long, payload_digest string"


class BrokenArchive(ValueError):
    """An archive whose records do not reach from its first byte to its last."""


def originals(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """digest, original, rows of payloads of at least `least` bytes that several rows hold: the smallest page_id of each."""
    long = pages.filter(F.col("size") >= least)
    return long.groupBy("digest").agg(F.min("page_id").alias("original"), F.count("*").alias("rows")).filter("rows > 1")


def _with_originals(kept: DataFrame, least: int) -> DataFrame:
    """kept with original, where its payload has one."""
    shared = staged(originals(kept, least), "originals")
    if shared.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:  # about 10 MB
        return kept.join(F.broadcast(shared.drop("rows")), "digest", "left")
    # a payload of very many rows would fill one task of the join: there are 4 such a partition at most
    many = kept.count() // (4 * shuffle_partitions(kept.sparkSession))
    hot, cold = shared.filter(F.col("rows") > many).drop("rows"), shared.filter(F.col("rows") <= many).drop("rows")
    others = kept.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(cold, "digest", "left")
    return kept.join(F.broadcast(hot), "digest").unionByName(others)


def _tiers(kept: DataFrame, file_bytes: int, file_records: int) -> list[tuple[int, int, int]]:
    """Payload sizes from, to (exclusive) and how many records of them a file may have, for the sizes that occur.

    A file's payloads stay within file_bytes, but for one longer payload alone in its file.
    """
    bounds = [0, *(1 + file_bytes // n for n in sorted({file_records, max(file_records // 16, 1), max(file_records // 256, 1)}, reverse=True)), 1 << 31]
    tier = F.lit(0)
    for i, low in enumerate(bounds[1:-1], 1):
        tier = F.when(F.col("size") >= low, i).otherwise(tier)
    found = kept.groupBy(tier.alias("tier")).agg(F.max("size").alias("most")).collect()  # four rows at most
    return [(bounds[r.tier], bounds[r.tier + 1], min(file_records, max(1, file_bytes // max(r.most, 1)))) for r in sorted(found)]


def write(pages: DataFrame, path: str, least: int = LEAST_SHARED, file_records: int = FILE_RECORDS, file_bytes: int = FILE_BYTES) -> None:
    """One record a row of page_id, url, html; a null html is an empty payload, a null url has no target header.

    A row that repeats an earlier payload is a revisit; rows of equal page_id and payload are all responses, as are rows
    without page_id. Control characters in a url are written as %20. An empty table writes no records. Files are bounded in
    records and in payload bytes: long payloads go to files of their own, fewer to a file.
    """
    kept = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("payload"))
    kept = kept.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload")})
    ship(pages.sparkSession)
    joined = _with_originals(kept, least)
    revisit = F.coalesce(F.col("page_id") > F.col("original"), F.lit(False))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), page, F.lit(f">\r\nWARC-Date: {DATE}"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")), F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("original"), F.lit(">\r\nWARC-Truncated: length"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length("block"), F.lit(END), F.col("block"),
    )
    records = joined.withColumn("block", block).select("size", head.alias("value"))
    for low, high, each in _tiers(kept, file_bytes, file_records) or [(0, 1, file_records)]:
        own = records.filter((F.col("size") >= low) & (F.col("size") < high)).select("value")
        own.write.mode("append").option("lineSep", END).option("maxRecordsPerFile", each).text(path)


def _fields(head: bytes) -> dict[str, str]:
    pairs = (x.split(b":", 1) for x in head.split(b"\r\n") if b":" in x)
    return {k.decode().lower(): v.strip().decode("utf-8", "replace") for k, v in pairs}


def _page(value: str | None) -> str | None:
    return value[len("<urn:page:") : -1] if value and value.startswith("<urn:page:") else None


def candidates(content: bytes, at: int, own: int, path: str = "", block: int = 0) -> list[tuple]:
    """Rows of CANDIDATES for each header that starts in the first own bytes of content, which lies at `at` in its file.

    Digest and size are null where the record ends beyond content; payload_from and successor are set for each.
    """
    rows, exits = [], {}
    found = content.find(b"WARC/1.")
    while 0 <= found < own:
        if (m := _HEAD.match(content, found)) and (n := _LENGTH.search(m[1])):
            fields, body, length = _fields(m[1]), m.end(), int(n[1])
            blank = content.find(b"\r\n\r\n", body, body + length)
            http = content.startswith(b"HTTP/", body) and "msgtype=response" in fields.get("content-type", "")
            start = blank + 4 if http and blank >= 0 else body
            kind, whole = fields.get("warc-type", ""), body + length <= len(content)
            said = fields.get("warc-payload-digest", "").removeprefix("sha256:") or None
            size = digest = None
            if kind == "revisit":
                stated = re.search(rb"(?i)content-length:[ \t]*(\d+)", content[body:start]) if http else None
                size, digest = int(stated[1]) if stated else None, said
            elif whole:
                payload = content[start : body + length]
                size, digest = len(payload), hashlib.sha256(payload).hexdigest()
            rows.append([path, block, at + found, at + body + length + 4, None, _page(fields.get("warc-record-id")), kind, _page(fields.get("warc-refers-to")), at + start, size, digest])
        found = content.find(b"WARC/1.", found + 1)
    for r in reversed(rows):  # a successor lies further on, so its exit is known
        r[4] = exits[r[2]] = r[3] if r[3] >= at + own else exits.get(r[3], -1)
    return [tuple(r) for r in rows]


def _scan(block_size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (x.split() for x in CANDIDATES.split(", "))])
        for batch in batches:
            for i in range(batch.num_rows):
                path, block, content = (batch.column(j)[i] for j in range(3))
                got = candidates(content.as_buffer().to_pybytes(), block.as_py() * block_size, block_size, path.as_py(), block.as_py())
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got), kind)], schema=kind)

    return run


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for path, entry, links in zip(batch["path"], batch["entry"], batch["links"]):
            follow = {x["offset"]: x["successor"] for x in links}
            at = entry
            while at in follow:
                out.append((path, at))
                at = follow[at]
        yield pd.DataFrame(out, columns=["path", "offset"])


def _entries(places: DataFrame) -> DataFrame:
    """path, offset of the places at which the chain from each file's start enters a block, by pointer jumping."""
    targets = places.select("path", F.col("exit").alias("offset")).filter("offset >= 0").distinct()
    firsts = places.filter("offset = 0").select("path", "offset")
    jumps = staged(places.select("path", "offset", F.col("exit").alias("next")).join(targets.unionByName(firsts).distinct(), ["path", "offset"], "left_semi"), "jumps")
    reached = staged(firsts, "reached")
    known = reached.count()
    while True:
        landed = reached.join(jumps, ["path", "offset"]).select("path", F.col("next").alias("offset")).join(jumps.select("path", "offset"), ["path", "offset"], "left_semi")
        reached = staged(reached.unionByName(landed).distinct(), "reached")
        if (now := reached.count()) == known:
            return reached
        known = now
        further = jumps.select("path", F.col("offset").alias("next"), F.col("next").alias("after"))
        jumps = staged(jumps.join(further, ["path", "next"], "left").select("path", "offset", F.coalesce("after", "next").alias("next")), "jumps")


def read(spark: SparkSession, path: str, block_size: int = BLOCK, ahead: int = AHEAD) -> DataFrame:
    """The records of the archives under path: page_id, record_type, refers_to, payload_bytes, payload_digest, path, offset, payload_from.

    A header, with the HTTP header after it, may reach `ahead` bytes beyond its block; where one reaches further, the
    archives are read again with more. A payload may be longer than blocks, and is then cut out of its file again. A file is
    held by one task, as the writer bounds its bytes; Spark refuses files over 2 GiB. A folder without records gives no
    rows. BrokenArchive is raised, before any row is returned, for a file whose chain does not start at its first byte and
    end at its last: a truncated one, one with stray bytes, or none of an archive at all.
    """
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    blocks = files.filter("length > 0").select("path", "content", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / block_size))).alias("block"))
    cut = blocks.select("path", F.col("block").cast("long").alias("block"), F.substring("content", F.col("block").cast("int") * block_size + 1, F.lit(block_size + ahead)).alias("content"))
    places = staged(cut.mapInArrow(_scan(block_size), CANDIDATES), "places")
    entries = _entries(places)
    entered = places.join(entries, ["path", "offset"], "left_semi").select("path", "block", F.col("offset").alias("entry"))
    links = places.groupBy("path", "block").agg(F.collect_list(F.struct("offset", "successor")).alias("links"))  # as many as a block holds
    chain = links.join(entered, ["path", "block"]).select("path", "entry", "links").mapInPandas(_walk, "path string, offset long")
    true = staged(places.join(chain, ["path", "offset"], "left_semi"), "true")
    ends = true.groupBy("path").agg(F.max("successor").alias("end"))
    broken = files.filter("length > 0").select("path", "length").join(ends, "path", "left").filter("end IS NULL OR end <> length").orderBy(F.desc("length")).first()
    if broken and ahead < broken["length"]:
        return read(spark, path, block_size, ahead * 16)
    if broken:
        raise BrokenArchive(f"{broken['path']}: records reach to byte {broken['end'] or 0} of {broken['length']}")
    long = true.filter("payload_digest IS NULL AND kind <> 'revisit'").groupBy("path").agg(F.collect_list(F.struct("offset", "payload_from", "successor")).alias("parts"))
    again = files.join(long, "path").select("path", "content", F.explode("parts").alias("p"))
    part = F.substring("content", F.col("p.payload_from").cast("int") + 1, (F.col("p.successor") - 4 - F.col("p.payload_from")).cast("int"))
    again = again.select("path", F.col("p.offset").alias("offset"), F.octet_length(part).cast("long").alias("long_bytes"), F.sha2(part, 256).alias("long_digest"))
    out = true.join(again, ["path", "offset"], "left") if not long.isEmpty() else true.withColumns({"long_bytes": F.lit(None).cast("long"), "long_digest": F.lit(None).cast("string")})
    return out.select(
        F.expr("try_cast(page_id AS bigint)").alias("page_id"), F.coalesce("payload_bytes", "long_bytes").alias("payload_bytes"), F.coalesce("payload_digest", "long_digest").alias("payload_digest"),
        F.col("kind").alias("record_type"), F.expr("try_cast(refers_to AS bigint)").alias("refers_to"), "path", "offset", "payload_from",
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
o AS (SELECT payload_digest, min(page_id) AS original FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > original THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > original THEN original END AS refers_to FROM p LEFT JOIN o USING (payload_digest)
"""
