"""Corpus adapters: any table as documents of (path, role, format, content), and the roles and formats of paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Formats by suffix, and folders whose files are mirrors.
FORMATS = {"md": "markdown", "mdx": "mdx", "tex": "latex", "latex": "latex", "bib": "bibtex", "txt": "text", "text": "text", "pdf": "pdf"}
MIRROR_FOLDERS = ("generated", "mirror", "derived", "build", "_gen")


def source_format(path: Column) -> Column:
    """Format by lower-cased suffix; null where the suffix is unknown."""
    known = F.create_map(*(F.lit(x) for pair in FORMATS.items() for x in pair))
    return F.try_element_at(known, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))


def infer_role(path: Column, kind: Column) -> Column:
    """mirror for a folder of that name on the way, reference for pdf, else editable."""
    folders = F.slice(F.split(F.lower(path), "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    return F.when(F.arrays_overlap(folders, F.array(*map(F.lit, MIRROR_FOLDERS))), "mirror").when(kind == "pdf", "reference").otherwise("editable")


def document_path(source: Column, doc_id: Column) -> Column:
    name = doc_id.cast("string")
    return F.concat(F.lit("corpus/"), source, F.lit("/"), F.lpad(name, F.greatest(F.lit(6), F.length(name)), F.lit("0")), F.lit(".txt"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as a corpus: every tenth a mirror, every tenth a reference."""
    digit = F.col("doc_id") % 10
    role = F.when(digit == 9, "mirror").when(digit == 8, "reference").otherwise("editable")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = document_path(F.col("source"), F.col("doc_id"))
    return rows.select("doc_id", path.alias("path"), role.alias("role"), F.lit("text").alias("format"), F.coalesce("text", F.lit("")).alias("content"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("file_hash"))


def files(spark: SparkSession, root: str) -> DataFrame:
    """A folder of source files: path, format, role, content (byte-order mark dropped, bad bytes replaced), file_hash, bytes, reason of exclusion."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    kind = source_format(F.col("path"))
    text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "^\\uFEFF", "")
    binary = F.instr(F.substring("content", 1, 8192).cast("string"), "\u0000") > 0
    return raw.select("path", kind.alias("format"), infer_role(F.col("path"), kind).alias("role"), text.alias("content"), F.sha2("content", 256).alias("file_hash"), F.col("length").alias("bytes"), F.when(kind.isNull(), "unsupported").when(binary, "binary").alias("reason"))


def jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Lines of JSON objects: record (variant; null if malformed), malformed, line. Blank lines are left out; any other line that is no object is malformed."""
    line = F.trim(F.col("value"))
    record = F.when(line.startswith("{"), F.try_parse_json(line))
    return spark.read.text(path).filter(line != "").select(record.alias("record"), record.isNull().alias("malformed"), F.col("value").alias("line"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as Markdown: a title, then a heading and the text of each turn. One row a conversation's turns."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turn = F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    parts = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    body = F.array_join(F.transform("turns", lambda t: F.concat(F.lit("\n## Turn "), t["turn"].cast("string"), F.lit(": "), t["role"], F.lit("\n"), t["text"])), "")
    return parts.select("conv_id", F.concat(F.lit("conversations/"), F.col("conv_id").cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("# Conversation "), F.col("conv_id").cast("string"), body).alias("content"))
