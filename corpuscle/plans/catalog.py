"""Queries over the supplied tables, each with the same result in DuckDB's SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import find, search, store
from ..sources import corpus
from ..streaming import feed

NEEDLE = "that the"
WORDS = "of the inthe tion"
QUERIES: dict = {}
SQL: dict[str, str] = {}
DOCS = """
d AS (SELECT doc_id, 'corpus/' || source || '/' || lpad(doc_id::VARCHAR, greatest(6, length(doc_id::VARCHAR))::INT, '0') || '.txt' AS path,
  CASE WHEN doc_id % 10 = 9 THEN 'mirror' WHEN doc_id % 10 = 8 THEN 'reference' ELSE 'editable' END AS role, 'text' AS format, coalesce(text, '') AS content, sha256(coalesce(text, '')) AS file_hash FROM documents)"""
TERMS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
HITS = f"""
l AS (SELECT path, role, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM d WHERE contains(content, '{NEEDLE}')),
g AS (SELECT path, role, line_no, string_split(line, '{NEEDLE}') AS gaps FROM l WHERE contains(line, '{NEEDLE}')),
o AS (SELECT path, role, line_no, gaps, unnest(range(1, len(gaps))) AS k FROM g),
f AS (SELECT path, role, line_no::INT AS line_no, (list_sum(list_transform(gaps[1:k], lambda x: length(x))) + (k - 1) * {len(NEEDLE)})::INT AS start_column FROM o)"""
BM25 = f"""
w AS (SELECT path, role, {TERMS.format('content')} AS t FROM d), q AS (SELECT DISTINCT unnest({TERMS.format(repr(WORDS))}) AS term),
n AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM w), e AS (SELECT path, len(t) AS dl, unnest(t) AS term FROM w),
h AS (SELECT term, path, dl, count(*) AS tf FROM e JOIN q USING (term) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM h GROUP BY term),
b AS (SELECT path, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM h JOIN df USING (term), n GROUP BY path),
lex AS (SELECT path, score, row_number() OVER (ORDER BY score DESC, path) AS rank FROM b QUALIFY rank <= 200)"""
VERSIONS = """
a AS (SELECT path, file_hash FROM d WHERE doc_id % 7 <> 0), z AS (SELECT path, CASE WHEN doc_id % 11 = 0 THEN sha256(content || '!') ELSE file_hash END AS file_hash FROM d WHERE doc_id % 5 <> 0)"""
EVENTS = """
v AS (SELECT event_id, ts, 'file' || user_id AS path, event_type AS kind, 'project' || user_id % 50 AS project FROM events)"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id").cast("string")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", F.concat(F.lit("file"), user).alias("path"), F.col("event_type").alias("kind"), F.concat(F.lit("project"), (F.col("user_id") % 50).cast("string")).alias("project"))


def _asked(spark: SparkSession, words: str = WORDS) -> DataFrame:
    return spark.range(1).select(F.col("id").alias("query_id"), F.lit(words).alias("query"))


def _lexical(spark: SparkSession, docs: DataFrame) -> DataFrame:
    scored = search.bm25(docs, "path", "content", _asked(spark)).select("path", F.round("score", 9).alias("score"))
    return search.top(scored.withColumn("one", F.lit(1)), ["one"], [F.desc("score"), F.asc("path")], search.CHANNEL).drop("one")


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = corpus.documents(spark, sf_dir)
    changed = F.when(F.col("doc_id") % 11 == 0, F.sha2(F.concat("content", F.lit("!")), 256)).otherwise(F.col("file_hash"))
    return docs.filter("doc_id % 7 <> 0").select("path", "file_hash"), docs.filter("doc_id % 5 <> 0").select("path", changed.alias("file_hash"))


@query("corpus_documents", f"WITH {DOCS} SELECT path, role, format, file_hash FROM d")
def corpus_documents(spark, sf):
    return corpus.documents(spark, sf).select("path", "role", "format", "file_hash")


@query("corpus_summary_counts", f"WITH {DOCS} SELECT role, format, count(*) AS documents, sum(strlen(content))::BIGINT AS bytes FROM d GROUP BY GROUPING SETS ((role), (format), ())")
def corpus_summary_counts(spark, sf):
    sized = corpus.documents(spark, sf).select("role", "format", F.octet_length("content").alias("size"))
    return sized.groupingSets([["role"], ["format"], []], "role", "format").agg(F.count("*").alias("documents"), F.sum("size").cast("long").alias("bytes"))


@query("corpus_role_from_url", r"""
WITH u AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://', '') AS path FROM pages), k AS (SELECT *, lower(regexp_extract(path, '\.([^./]+)$', 1)) AS s FROM u)
SELECT page_id, path, CASE WHEN len(list_intersect(string_split(lower(path), '/')[:-2], ['generated', 'mirror', 'derived', 'build', '_gen'])) > 0 THEN 'mirror' WHEN s = 'pdf' THEN 'reference' ELSE 'editable' END AS role,
 CASE WHEN s = 'md' THEN 'markdown' WHEN s = 'mdx' THEN 'mdx' WHEN s IN ('tex', 'latex') THEN 'latex' WHEN s = 'bib' THEN 'bibtex' WHEN s IN ('txt', 'text') THEN 'text' WHEN s = 'pdf' THEN 'pdf' END AS format FROM k""")
def corpus_role_from_url(spark, sf):
    path = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^[a-z]+://", "")
    rows = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", path.alias("path")).withColumn("format", corpus.source_format(F.col("path")))
    return rows.withColumn("role", corpus.infer_role(F.col("path"), F.coalesce("format", F.lit(""))))


@query("lines_explode_offsets", f"""WITH {DOCS}, l AS (SELECT path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM d)
SELECT path, line_no::INT AS line_no, coalesce(sum(length(line) + 1) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start, length(line)::INT AS size FROM l""")
def lines_explode_offsets(spark, sf):
    return find.lines(corpus.documents(spark, sf).select("path", "content")).select("path", "line_no", "char_start", F.length("line").alias("size"))


@query("markdown_sections", """WITH t AS (SELECT conv_id, '## Turn ' || turn || ': ' || role || chr(10) || coalesce(text, '') AS body, turn, role FROM conversations),
m AS (SELECT conv_id, '# Conversation ' || conv_id || chr(10) || string_agg(body, chr(10) ORDER BY turn, role) AS content FROM t GROUP BY conv_id),
l AS (SELECT conv_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM m),
x AS (SELECT *, max(n) OVER (PARTITION BY conv_id) AS last FROM l),
h AS (SELECT conv_id, line, n, last FROM x WHERE regexp_matches(line, '^#{1,6}\\s')),
s AS (SELECT *, lead(n) OVER (PARTITION BY conv_id ORDER BY n) AS nxt FROM h)
SELECT 'conversations/' || conv_id || '.md' AS path, CASE WHEN starts_with(line, '## ') THEN 'Conversation ' || conv_id || ' > ' || substr(line, 4) ELSE substr(line, 3) END AS breadcrumb, n::INT AS start_line, coalesce(nxt - 1, last)::INT AS end_line FROM s""".replace("\\\\", "\\"))
def markdown_sections(spark, sf):
    return find.sections(corpus.conversations(spark, sf).select("path", "content"))


@query("find_with_breadcrumb", SQL["markdown_sections"].replace("SELECT 'conversations/'", ", z AS (SELECT 'conversations/'") + f"), b AS (SELECT 'conversations/' || conv_id || '.md' AS path, n, line FROM l WHERE contains(line, '{NEEDLE}')) SELECT b.path, b.n::INT AS line_no, breadcrumb FROM b JOIN z ON b.path = z.path AND b.n BETWEEN start_line AND end_line")
def find_with_breadcrumb(spark, sf):
    docs = corpus.conversations(spark, sf).select("path", "content")
    own = find.lines(docs).filter(F.col("line").contains(NEEDLE)).select("path", "line_no")
    at = find.sections(docs)
    return own.join(at, (own["path"] == at["path"]) & F.col("line_no").between(F.col("start_line"), F.col("end_line"))).select(own["path"], "line_no", "breadcrumb")


@query("read_line_range", f"WITH {DOCS} SELECT path, array_to_string(string_split(content, chr(10))[2:4], chr(10)) AS span FROM d")
def read_line_range(spark, sf):
    return corpus.documents(spark, sf).select("path", F.array_join(F.slice(F.split("content", "\n", -1), 2, 3), "\n").alias("span"))


@query("find_literal", f"WITH {DOCS}, {HITS} SELECT path, role, line_no, start_column, start_column + {len(NEEDLE)} AS end_column FROM f")
def find_literal(spark, sf):
    return find.literal(corpus.documents(spark, sf), NEEDLE)


@query("find_literal_scoped_by_role", f"WITH {DOCS}, {HITS} SELECT path, role, line_no, start_column, start_column + {len(NEEDLE)} AS end_column FROM f WHERE role = 'editable' AND starts_with(path, 'corpus/src0/')")
def find_literal_scoped_by_role(spark, sf):
    return find.literal(corpus.documents(spark, sf), NEEDLE, ("editable",), "corpus/src0")


@query("find_regex", r"WITH m AS (SELECT page_id, regexp_extract_all(html, 'href=\"/[a-z]+') AS found FROM pages) SELECT page_id, generate_subscripts(found, 1)::INT AS ordinal, unnest(found) AS match FROM m".replace('\\"', '"'))
def find_regex(spark, sf):
    return find.regex(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), 'href="/[a-z]+', "html")


@query("token_counts_approx", rf"WITH {DOCS} SELECT path, greatest(len(regexp_extract_all(content, '[\p{{L}}\p{{N}}\p{{M}}_]+|[^\s\p{{L}}\p{{N}}\p{{M}}_]')), (length(content) + 3) // 4)::INT AS tokens FROM d")
def token_counts_approx(spark, sf):
    return corpus.documents(spark, sf).select("path", X.approximate_tokens(F.col("content")).alias("tokens"))


@query("postings_build", f"WITH {DOCS}, w AS (SELECT path, {TERMS.format('content')} AS t FROM d), e AS (SELECT path, len(t)::INT AS dl, unnest(t) AS term FROM w) SELECT term, path, count(*) AS tf, dl FROM e GROUP BY ALL")
def postings_build(spark, sf):
    return search.postings(corpus.documents(spark, sf), "path", "content")


@query("bm25_topk", f"WITH {DOCS}, {BM25} SELECT path, round(score, 6) AS score FROM lex")
def bm25_topk(spark, sf):
    return _lexical(spark, corpus.documents(spark, sf)).select("path", F.round("score", 6).alias("score"))


@query("lexical_like_fallback", f"WITH {DOCS} SELECT path FROM d WHERE contains(lower(content), lower('{NEEDLE}'))")
def lexical_like_fallback(spark, sf):
    return corpus.documents(spark, sf).filter(F.lower("content").contains(NEEDLE.lower())).select("path")


@query("knn_topk", """WITH q AS (SELECT embedding AS a FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)),
s AS (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], a::DOUBLE[]), 9) AS score FROM embeddings, q) SELECT vec_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 200""")
def knn_topk(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    first = vectors.orderBy("vec_id").limit(1).withColumn("query_id", F.col("vec_id"))
    return search.nearest(vectors, "vec_id", "embedding", first).select("vec_id", F.round("score", 6).alias("score"))


@query("knn_topk_by_query", """WITH q AS (SELECT vec_id AS query_id, embedding AS a FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], a::DOUBLE[]), 9) AS score FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 200""")
def knn_topk_by_query(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    asked = vectors.filter("vec_id % 100 = 0").withColumn("query_id", F.col("vec_id"))
    return search.nearest(vectors, "vec_id", "embedding", asked).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query("search_mrr_recall", f"""WITH {DOCS}, q AS (SELECT item_id, list_distinct({TERMS.format('text')}) AS t FROM benchmark), qt AS (SELECT item_id, unnest(t) AS term FROM q),
w AS (SELECT path, {TERMS.format('content')} AS t FROM d), n AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM w), e AS (SELECT path, len(t) AS dl, unnest(t) AS term FROM w),
h AS (SELECT term, path, dl, count(*) AS tf FROM e WHERE term IN (SELECT term FROM qt) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM h GROUP BY term),
b AS (SELECT item_id, path, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM h JOIN df USING (term) JOIN qt USING (term), n GROUP BY ALL),
r AS (SELECT item_id, path, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, path) AS rank FROM b QUALIFY rank <= 200),
rel AS (SELECT item_id, path FROM d, benchmark WHERE contains(content, benchmark.text)), f AS (SELECT item_id, min(rank) AS first FROM r SEMI JOIN rel ON r.item_id = rel.item_id AND r.path = rel.path GROUP BY item_id),
a AS (SELECT DISTINCT item_id FROM rel)
SELECT count(*) AS queries, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr, round(avg(CASE WHEN first <= 8 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall FROM a LEFT JOIN f USING (item_id)""")
def search_mrr_recall(spark, sf):
    docs = corpus.documents(spark, sf)
    asked = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    ranked = search.top(search.bm25(docs, "path", "content", asked).withColumn("score", F.round("score", 6)), ["query_id"], [F.desc("score"), F.asc("path")], search.CHANNEL)
    return search.evaluate(ranked, search.containing(docs, "path", "content", asked), "path")


@query("expand_query_bundle", """WITH b AS (SELECT item_id, list_value(text, lower(text), trim(text), split_part(text, '.', 1)) AS q FROM benchmark), u AS (SELECT item_id, unnest(q) AS query, generate_subscripts(q, 1) AS k FROM b),
f AS (SELECT item_id, query, min(k) AS k FROM u GROUP BY ALL) SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY k))::INT AS ordinal, query FROM f""")
def expand_query_bundle(spark, sf):
    rows = spark.read.parquet(f"{sf}/benchmark.parquet")
    every = F.array_distinct(F.array("text", F.lower("text"), F.trim("text"), F.element_at(F.split("text", r"\."), 1)))
    return rows.select("item_id", F.posexplode(every).alias("pos", "query")).select("item_id", (F.col("pos") + 1).alias("ordinal"), "query")


@query("corpus_revision_digest", f"""WITH {DOCS}, h AS (SELECT sha256(path || chr(0) || file_hash || chr(0) || role) AS h FROM d)
SELECT count(*) AS documents, sha256({" || ',' || ".join(f"sum(('0x' || substr(h, {1 + 15 * i}, 15))::BIGINT)::VARCHAR" for i in range(4))}) AS revision FROM h""")
def corpus_revision_digest(spark, sf):
    return store.revision(corpus.documents(spark, sf), ["path", "file_hash", "role"])


@query("delta_changed_added_deleted", f"WITH {DOCS}, {VERSIONS} SELECT path, CASE WHEN a.path IS NULL THEN 'added' WHEN z.path IS NULL THEN 'deleted' ELSE 'changed' END AS status FROM a FULL JOIN z USING (path) WHERE a.file_hash IS DISTINCT FROM z.file_hash")
def delta_changed_added_deleted(spark, sf):
    return store.delta(*_versions(spark, sf))


@query("scope_drift", f"WITH {DOCS}, {VERSIONS}, s AS (SELECT path, CASE WHEN a.path IS NULL THEN 'added' WHEN z.path IS NULL THEN 'deleted' ELSE 'changed' END AS status FROM a FULL JOIN z USING (path) WHERE a.file_hash IS DISTINCT FROM z.file_hash) SELECT path, status, status <> 'deleted' AND role <> 'editable' AS unexpected FROM s JOIN d USING (path)")
def scope_drift(spark, sf):
    return store.drift(store.delta(*_versions(spark, sf)), corpus.documents(spark, sf).filter("role = 'editable'").select("path"))


@query("incremental_upsert", f"WITH {DOCS} SELECT path, CASE WHEN doc_id % 5 = 0 THEN sha256(content || '!') ELSE file_hash END AS file_hash FROM d WHERE doc_id % 7 <> 3")
def incremental_upsert(spark, sf):
    docs = corpus.documents(spark, sf)
    arrivals = docs.filter("doc_id % 5 = 0 AND doc_id % 7 <> 3").select("path", F.sha2(F.concat("content", F.lit("!")), 256).alias("file_hash"))
    return store.upsert(docs.select("path", "file_hash"), arrivals, docs.filter("doc_id % 7 = 3").select("path"))


@query("relocate_paths", f"WITH {DOCS} SELECT CASE WHEN starts_with(path, 'corpus/src0/') THEN 'moved/here' || substr(path, 12) ELSE path END AS path, file_hash FROM d")
def relocate_paths(spark, sf):
    return store.relocate(corpus.documents(spark, sf).select("path", "file_hash"), "corpus/src0", "moved/here")


@query("location_validation", f"""WITH {DOCS}, n AS (SELECT *, string_split(content, chr(10)) AS l FROM d)
SELECT path, CASE WHEN doc_id % 13 = 0 THEN 'missing' WHEN doc_id % 11 = 0 THEN 'stale_file' WHEN len(l) < 2 THEN 'out_of_range' WHEN doc_id % 17 = 0 THEN 'stale_span' ELSE 'ok' END AS status FROM n""")
def location_validation(spark, sf):
    docs = corpus.documents(spark, sf)
    span = F.sha2(F.array_join(F.slice(F.split("content", "\n", -1), 1, 2), "\n"), 256)
    kept = docs.select("path", F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), "file_hash", F.when(F.col("doc_id") % 17 == 0, F.lit("")).otherwise(span).alias("span_hash"))
    now = docs.filter("doc_id % 13 <> 0").withColumn("file_hash", F.when(F.col("doc_id") % 11 == 0, F.lit("")).otherwise(F.col("file_hash")))
    return store.validate(kept, now).select("path", "status")


@query("candidate_id_hash", f"WITH {DOCS} SELECT path, substr(sha256(path || chr(0) || '' || chr(0) || '1' || chr(0) || '2' || chr(0) || file_hash), 1, 24) AS candidate_id FROM d")
def candidate_id_hash(spark, sf):
    return corpus.documents(spark, sf).select("path", X.candidate_id(F.col("path"), F.lit(None), F.lit(1), F.lit(2), F.col("file_hash")).alias("candidate_id"))


@query("dirty_pending_antijoin", f"WITH {EVENTS} SELECT event_id, path FROM v WHERE kind <> 'error' AND event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'view')")
def dirty_pending_antijoin(spark, sf):
    events = _events(spark, sf)
    return feed.pending(events.filter("kind <> 'error'").unionByName(events.filter("kind = 'click'")), events.filter("kind = 'view'")).select("event_id", "path")


@query("dirty_coalesced_files", f"WITH {EVENTS} SELECT path, count(*) AS events, max(ts) AS last FROM v GROUP BY path")
def dirty_coalesced_files(spark, sf):
    return feed.coalesced(_events(spark, sf))


@query("stream_drain_dedupe", "SELECT DISTINCT ON (event_id) event_id, user_id, event_type FROM events")
def stream_drain_dedupe(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return feed.drain(spark, sf, "events.parquet", schema).select("event_id", "user_id", "event_type")


@query("watermark_stale_paths", f"""WITH {EVENTS}, i AS (SELECT path, min(ts) AS indexed_at FROM v WHERE kind = 'signup' GROUP BY path), m AS (SELECT max(indexed_at) AS mark FROM i), l AS (SELECT path, max(ts) AS ts FROM v GROUP BY path)
SELECT path, ts FROM l LEFT JOIN i USING (path), m WHERE ts > indexed_at OR (indexed_at IS NULL AND (mark IS NULL OR ts > mark))""")
def watermark_stale_paths(spark, sf):
    events = _events(spark, sf)
    return feed.stale(events, events.filter("kind = 'signup'").groupBy("path").agg(F.min("ts").alias("indexed_at")))


@query("verification_state_fold", f"""WITH {EVENTS}, g AS (SELECT project, kind, sum(CASE WHEN kind <> 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY project ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM v)
SELECT project, max(g)::BIGINT AS edits, coalesce(max(g) FILTER (kind = 'purchase'), -1)::BIGINT AS verified, max(g) = coalesce(max(g) FILTER (kind = 'purchase'), -1) AS clean FROM g GROUP BY project""")
def verification_state_fold(spark, sf):
    kind = F.when(F.col("kind") == "purchase", "verify").otherwise("edit")
    return feed.verification(_events(spark, sf).withColumn("kind", kind))


@query("duplicate_keys", f"WITH {DOCS} SELECT file_hash, count(*) AS documents FROM d GROUP BY file_hash HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return corpus.documents(spark, sf).groupBy("file_hash").agg(F.count("*").alias("documents")).filter("documents > 1")


@query("dangling_refs", r"""WITH r AS (SELECT page_id, lower(unnest(regexp_extract_all(html, 'href="/([^"]+)"', 1))) AS name FROM pages), t AS (SELECT DISTINCT lower(unnest(regexp_extract_all(html, '<h1>([^ <]+)', 1))) AS name FROM pages)
SELECT name, count(*) AS refs FROM r ANTI JOIN t USING (name) GROUP BY name""")
def dangling_refs(spark, sf):
    html = spark.read.parquet(f"{sf}/pages.parquet")
    refs = html.select(F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]+)"'), F.lit(1))).alias("name")).select(F.lower("name").alias("name"))
    heads = html.select(F.explode(F.regexp_extract_all("html", F.lit("<h1>([^ <]+)"), F.lit(1))).alias("name")).select(F.lower("name").alias("name")).distinct()
    return refs.join(heads, "name", "left_anti").groupBy("name").agg(F.count("*").alias("refs"))


from . import impact_catalog, search_catalog, state_catalog  # noqa: E402, F401  registers its queries
