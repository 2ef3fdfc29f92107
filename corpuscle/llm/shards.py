"""Size-tiered sharding: immutable Parquet shards under versioned manifests.

An append writes small shards and commits a manifest that lists them beside the old ones. Compaction takes each tier of
similarly sized shards and rewrites it as files of about the target size: a scan of the tier's files feeds the writer
through coalesce, so rows never cross the network and no key decides where they go. Each commit is one rename of a
complete manifest to the next version's name, which fails if another writer took it; readers see whole versions only.
DataFrame operations move the rows; the driver handles file names and sizes alone.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path

TARGET = 64 << 20
FANOUT = 4
ARRIVAL_ROWS = 2000


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    generation: int


class CommitConflict(RuntimeError):
    """Another writer committed this version first; read the new manifest and try again."""


class ShardedTable:
    """A table at path. Rows are kept as they are: nulls, empty and long texts, repeated rows and any further columns."""

    def __init__(self, spark: SparkSession, path: str, target: int = TARGET, fanout: int = FANOUT):
        self.spark, self.path, self.target, self.fanout = spark, path.rstrip("/"), target, fanout

    def _hadoop(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _listed(self, folder: str, ending: str) -> list[tuple[str, int]]:
        fs, at = self._hadoop(folder)
        if not fs.exists(at):
            return []
        return sorted((s.getPath().toString(), s.getLen()) for s in fs.listStatus(at) if s.getPath().getName().endswith(ending) and not s.getPath().getName().startswith((".", "_")))

    def version(self) -> int:
        """The newest committed version; 0 where nothing was committed."""
        return max((int(p.rsplit("/v", 1)[1].removesuffix(".json")) for p, _ in self._listed(f"{self.path}/manifests", ".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schema": None, "shards": []}
        fs, at = self._hadoop(f"{self.path}/manifests/v{version:08d}.json")
        stream = fs.open(at)
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def shards(self, version: int | None = None) -> list[Shard]:
        return [Shard(**s) for s in self.manifest(version)["shards"]]

    def _commit(self, base: int, schema: str, shards: list[Shard]) -> int:
        fs, folder = self._hadoop(f"{self.path}/manifests")
        fs.mkdirs(folder)
        _, draft = self._hadoop(f"{self.path}/manifests/.draft-{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps({"version": base + 1, "schema": schema, "shards": [asdict(s) for s in shards]}).encode()))
        out.close()
        _, final = self._hadoop(f"{self.path}/manifests/v{base + 1:08d}.json")
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise CommitConflict(f"version {base + 1} of {self.path} is taken")
        return base + 1

    def _written(self, df: DataFrame, generation: int, most_rows: int = 0) -> list[Shard]:
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").option("maxRecordsPerFile", most_rows).parquet(folder)
        return [Shard(p, n, generation) for p, n in self._listed(folder, ".parquet")]

    def append(self, arrivals: DataFrame, most_rows: int = ARRIVAL_ROWS) -> int:
        """Write arrivals as new shards and commit them beside the present ones. An empty arrival still fixes the schema."""
        now = self.manifest()
        if now["schema"] and now["schema"] != arrivals.schema.json():
            raise ValueError("arrivals have another schema than the table")
        added = self._written(arrivals, 0, most_rows)
        return self._commit(now["version"], arrivals.schema.json(), [*(Shard(**s) for s in now["shards"]), *added])

    def tier(self, shard: Shard) -> int:
        """Shards within a factor of fanout share a tier; one of half the target or more is full and stays."""
        return -1 if 2 * shard.bytes >= self.target else int(math.log(max(shard.bytes, 1), self.fanout))

    def compact(self) -> int:
        """Merge tiers of at least fanout shards until none is left; each round is one commit. Returns the newest version."""
        while True:
            now = self.manifest()
            live = [Shard(**s) for s in now["shards"]]
            tiers: dict[int, list[Shard]] = {}
            for s in live:
                tiers.setdefault(self.tier(s), []).append(s)
            tiers.pop(-1, None)
            runs = [own for own in tiers.values() if len(own) >= self.fanout]
            if not runs:
                return now["version"]
            made, gone = [], set()
            for own in runs:
                files = max(1, round(sum(s.bytes for s in own) / self.target))
                made += self._written(self._scan(now["schema"], own).coalesce(files), 1 + max(s.generation for s in own))
                gone |= {s.path for s in own}
            self._commit(now["version"], now["schema"], [*(s for s in live if s.path not in gone), *made])

    def _scan(self, schema: str, shards: list[Shard]) -> DataFrame:
        from pyspark.sql.types import StructType

        kind = StructType.fromJson(json.loads(schema))
        return self.spark.read.schema(kind).parquet(*(s.path for s in shards)) if shards else self.spark.createDataFrame([], kind)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version; older versions stay readable until vacuum."""
        now = self.manifest(version)
        if not now["schema"]:
            raise ValueError(f"{self.path} has no committed version")
        return self._scan(now["schema"], [Shard(**s) for s in now["shards"]])

    def vacuum(self) -> int:
        """Delete files that the newest version does not list; older versions become unreadable. Returns how many went."""
        live, gone = {s.path for s in self.shards()}, 0
        fs, data = self._hadoop(f"{self.path}/data")
        for folder in fs.listStatus(data) if fs.exists(data) else []:
            for p, _ in self._listed(folder.getPath().toString(), ".parquet"):
                if p not in live:
                    fs.delete(self._hadoop(p)[1], False)
                    gone += 1
        return gone


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as read back from the compacted table, with digests of its whole text."""
    table = ShardedTable(spark, shared_path(spark, "shards"))
    table.append(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    table.compact()
    table.vacuum()
    docs = table.read()
    return docs.select("doc_id", "lang", "source", "n_chars", F.octet_length("text").cast("long").alias("text_bytes"), F.sha2("text", 256).alias("text_sha256"))


OP1_SQL = "SELECT doc_id, lang, source, n_chars, strlen(text)::BIGINT AS text_bytes, sha256(text) AS text_sha256 FROM documents"
