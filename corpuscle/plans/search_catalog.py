"""Queries over the chunk index, finding with locations and reading, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunks, find, index, read
from ..session import staged
from ..sources import corpus, mirror
from .catalog import DOCS, NEEDLE, query

PATTERN = "[a-z]+(?:tion|ment)"
TOKEN = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"
# Lines that fit make runs; so do the words of each longer line. Within a run a chunk ends before the first part that no longer fits.
CHUNKED = rf"""
ls AS (SELECT path, string_split(CASE WHEN ends_with(content, chr(10)) THEN left(content, length(content) - 1) ELSE content END, chr(10)) AS ls FROM d),
li AS (SELECT path, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM ls),
lt AS (SELECT path, line, n, len(regexp_extract_all(line, '{TOKEN}')) AS tok, length(line) AS size FROM li),
lb AS (SELECT *, greatest(tok, (size + 5) // 4) > 400 AS big FROM lt),
lg AS (SELECT *, coalesce(sum(big::INT) OVER (PARTITION BY path ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigs FROM lb),
un AS (SELECT path, n, 0 AS k, bigs, 0 AS big, line AS part, tok, size + 1 AS size FROM lg WHERE NOT big UNION ALL
  SELECT path, n, k, bigs, 1, part, len(regexp_extract_all(part, '{TOKEN}')), length(part) FROM (
    SELECT path, n, bigs, unnest(ws) AS part, generate_subscripts(ws, 1) AS k FROM (SELECT *, regexp_extract_all(line, '\S+\s*') AS ws FROM lg WHERE big))),
ru AS (SELECT *, row_number() OVER r AS i, sum(tok) OVER r AS t, sum(size) OVER r AS l FROM un WINDOW r AS (PARTITION BY path, bigs, big ORDER BY n, k ROWS UNBOUNDED PRECEDING)),
nx AS (SELECT a.path, a.bigs, a.big, a.i, min(b.i) AS j FROM ru a JOIN ru b ON a.path = b.path AND a.bigs = b.bigs AND a.big = b.big AND b.i > a.i AND b.i <= a.i + 1700
  AND greatest(b.t - a.t + a.tok, (b.l - a.l + a.size - (1 - a.big) + 5) // 4) > 400 GROUP BY ALL),
st AS (SELECT path, bigs, big, 1::BIGINT AS i FROM ru WHERE i = 1 UNION ALL SELECT nx.path, nx.bigs, nx.big, nx.j FROM st JOIN nx ON st.path = nx.path AND st.bigs = nx.bigs AND st.big = nx.big AND st.i = nx.i),
sp AS (SELECT *, coalesce(lead(i) OVER (PARTITION BY path, bigs, big ORDER BY i) - 1, 1000000000) AS e FROM st),
ch AS (SELECT sp.path, min(n)::INT AS start_line, max(n)::INT AS end_line, min(k) AS k, CASE WHEN sp.big = 1 THEN string_agg(part, '' ORDER BY n, k) ELSE string_agg(part, chr(10) ORDER BY n, k) END AS text
  FROM sp JOIN ru ON sp.path = ru.path AND sp.bigs = ru.bigs AND sp.big = ru.big AND ru.i BETWEEN sp.i AND sp.e GROUP BY sp.path, sp.bigs, sp.big, sp.i),
chunk AS (SELECT path, (row_number() OVER (PARTITION BY path ORDER BY start_line, k) - 1)::INT AS ordinal, start_line, end_line, text,
  greatest(len(regexp_extract_all(text, '{TOKEN}')), (length(text) + 5) // 4)::INT AS token_count FROM ch)"""


def _low(text: str) -> str:
    """SQL that tells whether a text is low in signal."""
    bare = rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"
    words = rf"len(list_distinct(regexp_extract_all(lower({bare}), '\p{{L}}{{3,}}')))"
    every = rf"len(regexp_extract_all({bare}, '{TOKEN}'))"
    numbers = rf"len(list_filter(regexp_extract_all({bare}, '{TOKEN}'), lambda x: regexp_full_match(x, '\p{{Nd}}+')))"
    return rf"(length({bare}) = 0 OR length(regexp_replace({bare}, '\P{{L}}', '', 'g')) < 0.5 * length({bare}) OR {words} < 6 OR 2 * {numbers} > {every})"


def _embedded(name: str, source: str, keys: str, text: str) -> str:
    """SQL of tables NAME (keys, place, value), the vectors of a text's words."""
    return rf"""{name}_w AS (SELECT {keys}, sha256(unnest(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]+'))) AS h FROM {source}),
{name}_s AS (SELECT {keys}, (('0x' || substr(h, 1, 16))::UBIGINT % 64)::INT AS place, sum(CASE WHEN instr('13579bdf', substr(h, 18, 1)) > 0 THEN -1 ELSE 1 END) AS v FROM {name}_w GROUP BY ALL),
{name} AS (SELECT {keys}, place, v / sqrt(sum(v * v) OVER (PARTITION BY {keys})) AS value FROM {name}_s WHERE v <> 0)"""


VECTORS = rf"""
few AS (SELECT path, sum(len(regexp_extract_all(text, '\p{{L}}{{2,}}'))) AS words FROM chunk GROUP BY path),
ready AS (SELECT chunk.* FROM chunk JOIN few USING (path) WHERE words >= 40 AND NOT {_low('text')}),
{_embedded('vec', 'ready', 'path, ordinal', 'text')}"""
TERM = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
# In 12 decimals, as sums of floating-point numbers depend on their order.
SEARCHED = rf"""
asked AS (SELECT item_id AS query_id, text AS query FROM benchmark), qt AS (SELECT query_id, unnest(list_distinct({TERM.format('query')})) AS term FROM asked),
ct AS (SELECT path, ordinal, {TERM.format('text')} AS t FROM chunk), cn AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM ct),
ce AS (SELECT path, ordinal, len(t) AS dl, unnest(t) AS term FROM ct), cf AS (SELECT term, path, ordinal, dl, count(*) AS tf FROM ce WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
cd AS (SELECT term, count(*) AS df FROM cf GROUP BY term),
cb AS (SELECT query_id, path, ordinal, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM cf JOIN cd USING (term) JOIN qt USING (term), cn GROUP BY ALL),
lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path, ordinal) AS rank FROM cb QUALIFY rank <= 200),
{_embedded('qv', 'asked', 'query_id', 'query')},
dot AS (SELECT query_id, path, ordinal, sum(vec.value * qv.value) AS s FROM vec JOIN qv USING (place) GROUP BY ALL),
near AS (SELECT a.query_id, r.path, r.ordinal, round(coalesce(s, 0), 9) AS score FROM asked a CROSS JOIN ready r LEFT JOIN dot ON dot.query_id = a.query_id AND dot.path = r.path AND dot.ordinal = r.ordinal),
vct AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path, ordinal) AS rank FROM near QUALIFY rank <= 200)"""
FUSED = """
fu AS (SELECT query_id, path, ordinal, lex.rank AS lexical_rank, vct.rank AS vector_rank, round(coalesce(1.0::DOUBLE / (60 + lex.rank), 0) + coalesce(1.0::DOUBLE / (60 + vct.rank), 0), 12) AS score
  FROM lex FULL JOIN vct USING (query_id, path, ordinal)),
fr AS (SELECT fu.*, start_line, end_line, text, row_number() OVER (PARTITION BY query_id ORDER BY fu.score DESC, path, ordinal) AS before FROM fu JOIN chunk USING (path, ordinal)),
fc AS (SELECT * FROM fr QUALIFY row_number() OVER (PARTITION BY query_id, path, start_line ORDER BY before) = 1),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY before)::INT AS rank FROM fc QUALIFY rank <= 8)"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(index.chunked(corpus.documents(spark, sf_dir)), "chunks")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query("chunks_greedy", f"WITH RECURSIVE {DOCS}, {CHUNKED} SELECT path, ordinal, start_line, end_line, token_count, sha256(text) AS text_hash FROM chunk")
def chunks_greedy(spark, sf):
    out = chunks.chunk(corpus.documents(spark, sf))
    return out.select("path", "ordinal", "start_line", "end_line", "token_count", F.sha2("text", 256).alias("text_hash"))


@query("overlap_collapse", f"""WITH RECURSIVE {DOCS}, {CHUNKED}, r AS (SELECT path, start_line, end_line, row_number() OVER (PARTITION BY path ORDER BY token_count DESC, ordinal) AS rank FROM chunk)
SELECT path, start_line, end_line, rank::INT AS rank FROM r QUALIFY row_number() OVER (PARTITION BY path, start_line ORDER BY rank) = 1""")
def overlap_collapse(spark, sf):
    from ..operators import search

    own = index.chunked(corpus.documents(spark, sf)).withColumn("last", F.col("end_line"))
    return chunks.collapse(search.top(own, ["path"], [F.desc("token_count"), F.asc("ordinal")], 1 << 30).select("path", "start_line", "end_line", "rank"))


@query("low_signal_flags", f"WITH {DOCS} SELECT path, {_low('content')} AS low_signal FROM d")
def low_signal_flags(spark, sf):
    return corpus.documents(spark, sf).select("path", X.low_signal(F.col("content")).alias("low_signal"))


@query("hash_embed", f"WITH {DOCS}, {_embedded('e', 'd', 'path', 'content')} SELECT path, place, round(value, 6) AS value FROM e")
def hash_embed(spark, sf):
    own = chunks.embed(corpus.documents(spark, sf), "path", "content")
    return own.select("path", F.posexplode("vector").alias("place", "value")).filter("value <> 0").withColumn("value", F.round("value", 6))


@query("index_vectors", f"WITH RECURSIVE {DOCS}, {CHUNKED}, {VECTORS} SELECT path, ordinal, place, round(value, 6) AS value FROM vec")
def index_vectors(spark, sf):
    own = index.vectors(_chunks(spark, sf))
    return own.select("path", "ordinal", F.posexplode("vector").alias("place", "value")).filter("value <> 0").withColumn("value", F.round("value", 6))


@query("document_words", rf"WITH RECURSIVE {DOCS}, {CHUNKED} SELECT path, sum(len(regexp_extract_all(text, '\p{{L}}{{2,}}')))::BIGINT AS words FROM chunk GROUP BY path")
def document_words(spark, sf):
    return index.document_words(index.chunked(corpus.documents(spark, sf)))


@query("lexical_chunks", f"WITH RECURSIVE {DOCS}, {CHUNKED}, {VECTORS}, {SEARCHED} SELECT query_id, path, ordinal, rank::INT AS rank, round(score, 6) AS score, round(1 / (1 + score), 6) AS shown FROM lex")
def lexical_chunks(spark, sf):
    found = index.lexical(_chunks(spark, sf), _asked(spark, sf))
    return found.select("query_id", "path", "ordinal", "rank", F.round("score", 6).alias("score"), F.round(X.lexical_score(F.col("score")), 6).alias("shown"))


HYBRID = "SELECT query_id, rank, path, ordinal, start_line, end_line, lexical_rank::INT AS lexical_rank, vector_rank::INT AS vector_rank, round(score, 9) AS score FROM best"


@query("hybrid_rrf", f"WITH RECURSIVE {DOCS}, {CHUNKED}, {VECTORS}, {SEARCHED}, {FUSED} {HYBRID}")
def hybrid_rrf(spark, sf):
    own = _chunks(spark, sf)
    out = index.hybrid(own, staged(index.vectors(own), "vectors"), _asked(spark, sf))
    return out.select("query_id", "rank", "path", "ordinal", "start_line", "end_line", "lexical_rank", "vector_rank", F.round("score", 9).alias("score"))


ROLE = "SELECT path FROM d WHERE role = 'reference'"


@query("hybrid_rrf_role_postfilter", f"""WITH RECURSIVE {DOCS}, {CHUNKED}, {VECTORS}, {SEARCHED.replace('lex AS', 'lex0 AS').replace('vct AS', 'vct0 AS')},
lex AS (SELECT * FROM lex0 WHERE path IN ({ROLE})), vct AS (SELECT * FROM vct0 WHERE path IN ({ROLE})), {FUSED} {HYBRID}""")
def hybrid_rrf_role_postfilter(spark, sf):
    own = _chunks(spark, sf)
    roles = corpus.documents(spark, sf).filter("role = 'reference'")
    out = index.hybrid(own, staged(index.vectors(own), "vectors"), _asked(spark, sf), roles)
    return out.select("query_id", "rank", "path", "ordinal", "start_line", "end_line", "lexical_rank", "vector_rank", F.round("score", 9).alias("score"))


@query("centered_snippet", rf"""WITH {DOCS}, q AS (SELECT * FROM d), p AS (SELECT path, content, list_min(list_filter([instr(lower(content), 'of'), instr(lower(content), 'the'), instr(lower(content), 'inthe'), instr(lower(content), 'tion')], lambda x: x > 0)) AS p FROM q),
s AS (SELECT path, content, greatest(1, least(coalesce(p, 1), length(content) - 199)) AS s FROM p)
SELECT path, CASE WHEN length(content) <= 200 THEN content ELSE CASE WHEN s > 1 THEN '…' ELSE '' END || regexp_replace(substr(content, s, 200), '^\s+|\s+$', '', 'g') || CASE WHEN s + 199 < length(content) THEN '…' ELSE '' END END AS snippet FROM s""")
def centered_snippet(spark, sf):
    return corpus.documents(spark, sf).select("path", X.centered_snippet(F.col("content"), ["of", "the", "inthe", "tion", "x"]).alias("snippet"))


LOCATED = rf"""
l AS (SELECT path, role, file_hash, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM d),
m AS (SELECT *, regexp_extract_all(line, '{PATTERN}') AS ms, regexp_split_to_array(line, '{PATTERN}') AS gaps FROM l WHERE regexp_matches(line, '{PATTERN}')),
o AS (SELECT *, unnest(range(1, len(ms) + 1)) AS k FROM m),
located AS (SELECT path, role, n::INT AS start_line, n::INT AS end_line, (list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: length(x))), 0))::INT AS start_column,
  ms[k] AS match, sha256(line) AS span_hash, left(line, 600) AS snippet, file_hash FROM o)"""


@query("find_regex_locations", f"WITH {DOCS}, {LOCATED} SELECT path, role, start_line, end_line, start_column, (start_column + length(match))::INT AS end_column, match, span_hash, sha256(snippet) AS snippet_hash, file_hash FROM located")
def find_regex_locations(spark, sf):
    return find.matches(corpus.documents(spark, sf), PATTERN).withColumn("snippet_hash", F.sha2("snippet", 256)).drop("snippet")


@query("find_sorted_offset", f"WITH {DOCS}, {LOCATED} SELECT path, start_line, start_column, match FROM located WHERE role = 'reference' ORDER BY path, start_line, start_column, match OFFSET 25")
def find_sorted_offset(spark, sf):
    found = find.matches(corpus.documents(spark, sf), PATTERN, roles=("reference",))
    return find.ordered(found, "25").select("path", "start_line", "start_column", "match")


@query("read_ranges", f"""WITH {DOCS}, l AS (SELECT doc_id, path, string_split(CASE WHEN ends_with(content, chr(10)) THEN left(content, length(content) - 1) ELSE content END, chr(10)) AS ls FROM d WHERE doc_id % 13 <> 0),
a AS (SELECT doc_id AS request_id, path, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 2 END AS a, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 4 END AS e FROM d)
SELECT request_id, a.path, CASE WHEN ls IS NULL THEN 'unknown' WHEN coalesce(e, len(ls)) < coalesce(a, 1) OR coalesce(e, len(ls)) > len(ls) THEN 'out_of_range' ELSE 'ok' END AS status,
 CASE WHEN ls IS NOT NULL AND coalesce(e, len(ls)) >= coalesce(a, 1) AND coalesce(e, len(ls)) <= len(ls) THEN sha256(array_to_string(ls[coalesce(a, 1):coalesce(e, len(ls))], chr(10))) END AS content_hash FROM a LEFT JOIN l ON l.path = a.path""")
def read_ranges(spark, sf):
    docs = corpus.documents(spark, sf)
    asked = docs.select(F.col("doc_id").alias("request_id"), "path", F.when(F.col("doc_id") % 5 != 0, 2).alias("start_line"), F.when(F.col("doc_id") % 3 != 0, 4).alias("end_line"))
    return read.spans(docs.filter("doc_id % 13 <> 0"), asked).select("request_id", "path", "status", F.sha2("content", 256).alias("content_hash"))


PAGED = """
p AS (SELECT 'paged/' || conv_id || '.pdf' AS pdf, conv_id, turn, role, replace(coalesce(text, ''), chr(10), ' ') AS text FROM conversations)"""


def _paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as paged texts, a page a turn."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").filter("turn IS NOT NULL").dropDuplicates(["conv_id", "turn"])
    path = F.concat(F.lit("paged/"), F.col("conv_id").cast("string"), F.lit(".pdf"))
    return rows.select(path.alias("path"), (F.col("turn") + 1).alias("page_no"), F.col("text").alias("page_text"), F.sha2(path, 256).alias("pdf_sha256"))


@query("mirror_rows", """WITH p AS (SELECT DISTINCT 'paged/' || conv_id || '.pdf' AS path FROM conversations WHERE turn IS NOT NULL)
SELECT path, 'reference' AS role, 'pdf' AS format, NULL::VARCHAR AS generated_from FROM p UNION ALL SELECT 'mirrors/' || path || '.md', 'mirror', 'markdown', path FROM p""")
def mirror_rows(spark, sf):
    pages = _paged(spark, sf)
    pdfs = pages.select("path").distinct().select("path", F.lit("reference").alias("role"), F.lit("pdf").alias("format"), F.lit("").alias("content"), F.sha2("path", 256).alias("file_hash"))
    return index.with_mirrors(pdfs, mirror.mirrors(pages)).select("path", "role", "format", "generated_from")


@query("chunk_pages", "SELECT 'mirrors/paged/' || conv_id || '.pdf.md' AS path, (turn + 1)::INT AS page FROM conversations WHERE turn IS NOT NULL GROUP BY ALL")
def chunk_pages(spark, sf):
    pages = _paged(spark, sf)
    pdfs = pages.select("path").distinct().select("path", F.lit("reference").alias("role"), F.lit("pdf").alias("format"), F.lit("").alias("content"), F.sha2("path", 256).alias("file_hash"))
    own = index.chunked(index.with_mirrors(pdfs, mirror.mirrors(pages)))
    return own.filter("page IS NOT NULL").select("path", "page").distinct()


@query("index_update", f"""WITH RECURSIVE d0 AS (SELECT 1), {DOCS.replace('d AS (SELECT', 'dd AS (SELECT')}, old AS (SELECT * FROM dd WHERE doc_id % 7 <> 0),
now AS (SELECT doc_id, path, role, format, CASE WHEN doc_id % 11 = 0 THEN content || ' changed' ELSE content END AS content FROM dd WHERE doc_id % 5 <> 0), d AS (SELECT * FROM now), {CHUNKED}
SELECT path, ordinal, start_line, end_line, sha256(text) AS text_hash FROM chunk""")
def index_update(spark, sf):
    docs = corpus.documents(spark, sf)
    keep = ["path", "role", "format", "content", "file_hash"]
    first = index.update(index.empty(spark), docs.filter("doc_id % 7 <> 0").select(*keep))
    content = F.when(F.col("doc_id") % 11 == 0, F.concat("content", F.lit(" changed"))).otherwise(F.col("content"))
    now = docs.filter("doc_id % 5 <> 0").withColumn("content", content).withColumn("file_hash", F.sha2("content", 256)).select(*keep)
    second = index.update({k: staged(v, k) if k != "metadata" else v for k, v in first.items()}, now)
    return second["chunks"].select("path", "ordinal", "start_line", "end_line", F.sha2("text", 256).alias("text_hash"))
