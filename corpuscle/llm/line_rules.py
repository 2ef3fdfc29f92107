"""Quality rules over words and lines, with DataFrame functions only.

Per text: counts that need no other document. Across documents: lines are normalised and hashed, distinct documents are
counted per host and line, lines in more documents than the limit are removed, and a document that loses too much goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import staged

LEAST_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
LINE_DOCUMENTS = 30
LINE_PERCENT = 8
KEEP_PERCENT = 50
_SPACES = r"concat(' ', char(9), char(10), char(11), char(12), char(13))"
_SPLIT = r"filter(split({}, '[\\t-\\r ]+'), x -> x <> '')"
_GRAM = ", ".join(f"h[i + {k}]" for k in range(WINDOW))
# transform(array(value), name -> ...)[0] binds a name, so that each value is computed once a row
_REPEATED = f"""
transform(array(transform(w, x -> xxhash64(x))), h -> IF(size(h) < {WINDOW}, 0,
  transform(array(transform(sequence(0, size(h) - {WINDOW}), i -> xxhash64({_GRAM}))), g -> IF(size(array_distinct(g)) = size(g), 0,
    transform(array(array_sort(transform(g, (x, i) -> struct(x AS x, i AS i)))), s ->
      transform(array(array_sort(transform(filter(s, (p, j) -> coalesce(get(s, j - 1).x = p.x, false) OR coalesce(get(s, j + 1).x = p.x, false)), p -> p.i))), q ->
        aggregate(transform(q, (p, j) -> least({WINDOW}, coalesce(get(q, j + 1) - p, {WINDOW}))), 0, (a, b) -> a + b))[0])[0]))[0]))[0]
"""


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, host, key (of the whole row), the counts of each text, and lines: hash and words of each line with a word."""
    text = F.coalesce("text", F.lit(""))
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"), text.alias("t"), F.xxhash64("doc_id", "source", "text").alias("key"), F.hash("text", "doc_id").alias("key2"))
    split = kept.withColumn("w", F.expr(_SPLIT.format("t"))).withColumn("l", F.expr(f"filter(split(t, '\\n'), x -> length(translate(x, {_SPACES}, '')) > 0)"))
    return split.select(
        "doc_id", "host", "key", "key2",
        F.size("w").cast("long").alias("n_words"),
        F.expr(f"length(translate(t, {_SPACES}, ''))").cast("long").alias("word_chars"),
        F.expr("length(t) - length(translate(t, '#*$%&|<>', ''))").cast("long").alias("n_symbols"),
        F.expr("size(l) - size(array_distinct(l))").cast("long").alias("n_dup_lines"),
        F.expr(_REPEATED).cast("long").alias("n_repeat_words"),
        F.expr(f"transform(l, y -> transform(array({_SPLIT.format('y')}), u -> struct(xxhash64(lower(array_join(u, ' '))) AS h, size(u) AS n))[0])").alias("lines"),
    )


def line_limits(rows: DataFrame, least: int = LINE_DOCUMENTS, percent: int = LINE_PERCENT) -> DataFrame:
    """host, h of lines in more than `least` documents and more than `percent` of the host's documents."""
    own = rows.dropDuplicates(["host", "key", "key2"])
    hosts = own.groupBy("host").agg(F.count("*").alias("documents"))
    lines = own.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h")).groupBy("host", "h").agg(F.count("*").alias("held"))
    return lines.filter(F.col("held") > least).join(hosts, "host").filter(100 * F.col("held") > percent * F.col("documents")).select("host", "h")


def judged(docs: DataFrame, least: int = LINE_DOCUMENTS, percent: int = LINE_PERCENT, keep_percent: int = KEEP_PERCENT) -> DataFrame:
    """The counts of each row of docs with base_failed, n_line_words (words of removed lines) and kept.

    Reads doc_id, source, text. A null text has no words and fails; a null source is the host ''. Rows without doc_id are
    judged like others. Repeated rows count once in a line's documents and are each returned. An empty table gives no rows.
    """
    rows = staged(measured(docs), "measured")
    own = rows.dropDuplicates(["host", "key", "key2"]).select("host", "key", "key2", F.explode("lines").alias("x")).select("host", "key", "key2", "x.h", "x.n")
    gone = own.join(line_limits(rows, least, percent), ["host", "h"]).groupBy("key", "key2").agg(F.sum("n").alias("n_line_words"))
    out = rows.join(gone, ["key", "key2"], "left").withColumn("n_line_words", F.coalesce("n_line_words", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    depleted = 100 * (F.col("n_words") - F.col("n_line_words")) < keep_percent * F.col("n_words")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "n_line_words", (~failed & ~depleted).alias("kept"))


def op7_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_SQL_WORDS = r"list_filter(regexp_split_to_array({}, '[\x09-\x0D ]+'), lambda x: x <> '')"
OP7_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
d AS (SELECT *, {_SQL_WORDS.format('t')} AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x09-\x0D ]')) AS l FROM t),
p AS (SELECT doc_id, list_transform(range(len(w) - 7), lambda i: hash(array_to_string(w[i + 1 : i + 8], ' '))) AS g FROM d WHERE len(w) >= 8),
g AS (SELECT doc_id, unnest(g) AS g, generate_subscripts(g, 1) AS i FROM p),
c AS (SELECT doc_id, g FROM g GROUP BY ALL HAVING count(*) > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM g JOIN c USING (doc_id, g), range(8) t(k) GROUP BY doc_id),
x AS (SELECT doc_id, host, unnest(l) AS line FROM d),
n AS (SELECT doc_id, host, lower(array_to_string({_SQL_WORDS.format('line')}, ' ')) AS line, len({_SQL_WORDS.format('line')}) AS n FROM x),
f AS (SELECT host, line, count(DISTINCT doc_id) AS held FROM n GROUP BY ALL),
h AS (SELECT host, count(DISTINCT doc_id) AS documents FROM d GROUP BY host),
q AS (SELECT doc_id, sum(n) AS n_line_words FROM n JOIN f USING (host, line) JOIN h USING (host) WHERE held > {LINE_DOCUMENTS} AND 100 * held > {LINE_PERCENT} * documents GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_line_words, 0)::BIGINT AS n_line_words FROM d LEFT JOIN r USING (doc_id) LEFT JOIN q USING (doc_id))
SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words OR 100 * (n_words - n_line_words) < {KEEP_PERCENT} * n_words) AS kept FROM m
"""
