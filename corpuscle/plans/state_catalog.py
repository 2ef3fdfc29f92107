"""Queries over the state of a corpus: summaries, LaTeX checks, trust, the edit worker and its gate, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import results
from ..operators import impact, index, latex, status
from ..session import shared_path, staged
from ..sources import corpus
from ..streaming import worker
from .catalog import DOCS, query
from .search_catalog import CHUNKED

TEX = "'\\label{k' || doc_id % 50 || '}' || chr(10) || 'see \\ref{k' || doc_id % 70 || '} % \\ref{no}' || chr(10) || '\\citep{b' || doc_id % 9 || ', b' || doc_id % 14 || '}' || chr(10) || '\\begin{comment}' || chr(10) || '\\ref{hidden}' || chr(10) || '\\end{comment}' || chr(10) || '\\newcommand{\\x}{\\label{macro}}' || chr(10) || '\\eqref{k' || doc_id % 60 || '}'"
BIB = "'@book{b' || doc_id % 11 || ',' || chr(10) || ' title = {x}}'"
USED = """
l AS (SELECT 'label' AS kind, 'k' || doc_id % 50 AS key, doc_id || '.tex' AS path, 1 AS line_no FROM documents), e AS (SELECT 'b' || doc_id % 11 AS key, doc_id || '.bib' AS path, 1 AS line_no FROM documents WHERE doc_id % 13 = 0),
r AS (SELECT 'k' || doc_id % 70 AS key, doc_id || '.tex' AS path, 2 AS line_no FROM documents UNION ALL SELECT 'k' || doc_id % 60, doc_id || '.tex', 8 FROM documents),
c AS (SELECT 'b' || doc_id % 9 AS key, doc_id || '.tex' AS path, 3 AS line_no FROM documents UNION ALL SELECT 'b' || doc_id % 14, doc_id || '.tex', 3 FROM documents)"""


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    spark_sql = lambda text: F.expr(text.replace("chr(10)", "'\\n'").replace("\\", "\\\\").replace("\\\\n'", "\\n'"))
    name = F.col("doc_id").cast("string")
    tex = rows.select(F.concat(name, F.lit(".tex")).alias("path"), F.lit("latex").alias("format"), spark_sql(TEX).alias("content"))
    bib = rows.filter("doc_id % 13 = 0").select(F.concat(name, F.lit(".bib")).alias("path"), F.lit("bibtex").alias("format"), spark_sql(BIB).alias("content"))
    return tex.unionByName(bib)


@query("latex_check", f"""WITH {USED}, f AS (SELECT 'dangling_ref' AS finding, 'error' AS severity, * FROM r WHERE key NOT IN (SELECT key FROM l)
 UNION ALL SELECT 'unused_label', 'warning', key, path, line_no FROM l WHERE key NOT IN (SELECT key FROM r) UNION ALL SELECT 'undefined_citation', 'error', * FROM c WHERE key NOT IN (SELECT key FROM e)
 UNION ALL SELECT 'uncited_entry', 'warning', * FROM e WHERE key NOT IN (SELECT key FROM c) UNION ALL SELECT 'duplicate_label', 'error', key, path, line_no FROM l WHERE key IN (SELECT key FROM l GROUP BY key HAVING count(*) > 1)
 UNION ALL SELECT 'duplicate_entry', 'error', * FROM e WHERE key IN (SELECT key FROM e GROUP BY key HAVING count(*) > 1)) SELECT finding, severity, key, path, line_no::INT AS line_no FROM f""")
def latex_check(spark, sf):
    return latex.check(_sources(spark, sf))


@query("latex_keys", f"WITH {USED} SELECT kind, key, count(*) AS uses FROM (SELECT 'label' AS kind, key FROM l UNION ALL SELECT 'ref', key FROM r UNION ALL SELECT 'cite', key FROM c UNION ALL SELECT 'entry', key FROM e) GROUP BY ALL")
def latex_keys(spark, sf):
    return latex.keys(latex.source_lines(_sources(spark, sf))).groupBy("kind", "key").agg(F.count("*").alias("uses"))


@query("trusted_untrusted_split", f"WITH {DOCS}, r AS (SELECT path, content, left(content, 20) AS lead_snippet, role AS source_breadcrumb FROM d) SELECT path, unnest(['content', 'lead_snippet', 'source_breadcrumb']) AS field, sha256(unnest([content, lead_snippet, source_breadcrumb])) AS value_hash FROM r")
def trusted_untrusted_split(spark, sf):
    docs = corpus.documents(spark, sf).withColumns({"lead_snippet": F.substring("content", 1, 20), "source_breadcrumb": F.col("role")})
    return results.untrusted(docs, ["path"]).select("path", "field", F.sha2("value", 256).alias("value_hash"))


@query("trusted_columns", f"WITH {DOCS} SELECT doc_id, path, role, format, file_hash FROM d")
def trusted_columns(spark, sf):
    return results.trusted(corpus.documents(spark, sf), ["path"])


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.when(F.col("doc_id") % 17 == 0, "binary").when(F.col("doc_id") % 19 == 0, "excluded")
    return corpus.documents(spark, sf_dir).select("path", "role", "format", reason.alias("reason"), F.octet_length("content").alias("bytes"))


FILES = f"{DOCS}, f AS (SELECT path, role, format, CASE WHEN doc_id % 17 = 0 THEN 'binary' WHEN doc_id % 19 = 0 THEN 'excluded' END AS reason, strlen(content) AS bytes FROM d)"


@query("discovery_summary", f"""WITH {FILES}, s AS (SELECT reason IS NULL AS included, * FROM f), t AS (SELECT included, NULL::VARCHAR AS role, NULL::VARCHAR AS format, NULL::VARCHAR AS reason, count(*) AS files, sum(bytes)::BIGINT AS bytes FROM s GROUP BY included
 UNION ALL SELECT true, role, NULL, NULL, count(*), sum(bytes)::BIGINT FROM s WHERE included GROUP BY role UNION ALL SELECT true, NULL, format, NULL, count(*), sum(bytes)::BIGINT FROM s WHERE included GROUP BY format
 UNION ALL SELECT false, NULL, NULL, reason, count(*), sum(bytes)::BIGINT FROM s WHERE NOT included GROUP BY reason) SELECT * FROM t""")
def discovery_summary(spark, sf):
    return status.summary(_files(spark, sf))


@query("discovery_samples", f"""WITH {FILES}, o AS (SELECT *, row_number() OVER (PARTITION BY reason IS NULL ORDER BY CASE role WHEN 'editable' THEN 1 WHEN 'reference' THEN 2 ELSE 3 END, path) AS k FROM f)
SELECT path, role, reason FROM o WHERE k <= CASE WHEN reason IS NULL THEN 30 ELSE 10 END""")
def discovery_samples(spark, sf):
    return status.samples(_files(spark, sf), 30, 10).select("path", "role", "reason")


@query("setup_estimate", f"WITH {FILES} SELECT count(*) AS documents, coalesce(sum(bytes), 0)::BIGINT AS bytes, 'hashed-words' AS model, true AS model_ready FROM f WHERE reason IS NULL")
def setup_estimate(spark, sf):
    return status.estimate(_files(spark, sf), "hashed-words")


@query("current_hashes", f"WITH {DOCS} SELECT path, CASE WHEN doc_id % 5 <> 0 THEN file_hash END AS file_hash FROM d WHERE doc_id % 7 <> 0 OR doc_id % 5 <> 0")
def current_hashes(spark, sf):
    docs = corpus.documents(spark, sf)
    return status.hashes(docs.filter("doc_id % 7 <> 0"), docs.filter("doc_id % 5 <> 0"))


@query("index_status", f"""WITH RECURSIVE d0 AS (SELECT 1), {DOCS.replace('d AS (SELECT', 'dd AS (SELECT')}, d AS (SELECT * FROM dd WHERE doc_id % 7 <> 0), z AS (SELECT path, CASE WHEN doc_id % 11 = 0 THEN 'x' ELSE file_hash END AS file_hash FROM dd WHERE doc_id % 5 <> 0), {CHUNKED},
x AS (SELECT d.path AS a, z.path AS b, d.file_hash AS h, z.file_hash AS g FROM d FULL JOIN z ON d.path = z.path)
SELECT (SELECT count(*) FROM d) AS documents, (SELECT count(*) FROM d WHERE role = 'mirror') AS mirrors, (SELECT count(*) FROM chunk) AS chunks, count(*) FILTER (a IS NULL) AS added, count(*) FILTER (h <> g) AS changed, count(*) FILTER (b IS NULL) AS deleted, 1::BIGINT AS edit_generation, count(*) FILTER (h IS DISTINCT FROM g) = 0 AS fresh FROM x""")
def index_status(spark, sf):
    docs = corpus.documents(spark, sf)
    own = index.update(index.empty(spark), docs.filter("doc_id % 7 <> 0").select("path", "role", "format", "content", "file_hash"))
    now = docs.filter("doc_id % 5 <> 0").select("path", F.when(F.col("doc_id") % 11 == 0, "x").otherwise(F.col("file_hash")).alias("file_hash"))
    return status.status(own, now).drop("vectors", "corpus_revision")


EVENTS = "v AS (SELECT event_id, ts, 'project' || user_id % 50 AS project, 'f' || user_id || '.md' AS file, event_type AS kind, user_id FROM events)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", F.concat(F.lit("project"), (user % 50).cast("string")).alias("project"), F.concat(F.lit("f"), user.cast("string"), F.lit(".md")).alias("file"), F.col("event_type").alias("kind"), "user_id")


@query("worker_drain_acks", f"WITH {EVENTS} SELECT event_id::VARCHAR AS event_id, file AS path FROM v")
def worker_drain_acks(spark, sf):
    queue, state = shared_path(spark, "queue"), shared_path(spark, "worker")
    events = _events(spark, sf).select(F.col("event_id").cast("string").alias("event_id"), F.col("ts").alias("created_at"), "project", F.array("file").alias("files"))
    worker.append(events.unionByName(events.filter("project = 'project1'")), queue)

    def refuse(files: DataFrame) -> None:
        raise ValueError("the index is not there")

    worker.drain(spark, queue, state, refuse)  # everything stays pending
    worker.drain(spark, queue, state, lambda files: files.write.mode("overwrite").parquet(f"{state}/indexed"))
    done = worker.acknowledged(spark, state).join(events.select("event_id", F.col("files")[0].alias("path")), "event_id")
    return done.join(spark.read.parquet(f"{state}/indexed"), "path", "left_semi").select("event_id", "path")


FOLDED = f"""{EVENTS}, o AS (SELECT *, CASE kind WHEN 'click' THEN 'index' WHEN 'view' THEN 'impact_start' ELSE 'impact_finish' END AS op, kind <> 'error' AS ok, CASE WHEN user_id % 2 = 0 THEN 'verify' ELSE 'discover' END AS phase,
  CASE WHEN kind = 'purchase' THEN 'verified' END AS status, 'r' || event_id AS run_id, CASE WHEN kind = 'signup' THEN 'r' || event_id END AS base FROM v),
g AS (SELECT *, CASE WHEN op = 'impact_finish' AND status = 'verified' THEN 'verified' WHEN op = 'impact_finish' AND base IS NOT NULL THEN 'baseline_sealed' WHEN op = 'impact_start' AND phase = 'verify' THEN 'pending' WHEN op = 'impact_start' THEN 'baseline_open' END AS told,
  CASE WHEN op = 'impact_finish' AND base IS NOT NULL THEN base WHEN op = 'impact_start' AND phase <> 'verify' THEN run_id END AS b FROM o WHERE ok),
state AS (SELECT project, arg_max(event_id, (ts, event_id)) AS edit_generation, arg_max(event_id, (ts, event_id)) FILTER (op = 'impact_finish' AND status = 'verified') AS verified_generation, arg_max(told, (ts, event_id)) FILTER (told IS NOT NULL) AS verification_status,
  arg_max(b, (ts, event_id)) FILTER (b IS NOT NULL) AS baseline_run_id FROM g GROUP BY project)"""


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    operation = F.when(F.col("kind") == "click", "index").when(F.col("kind") == "view", "impact_start").otherwise("impact_finish")
    run = F.concat(F.lit("r"), F.col("event_id").cast("string"))
    facts = {
        "operation": operation, "ok": F.col("kind") != "error", "phase": F.when(F.col("user_id") % 2 == 0, "verify").otherwise("discover"), "status": F.when(F.col("kind") == "purchase", "verified"),
        "run_id": run, "baseline_run_id": F.when(F.col("kind") == "signup", run), "edit_generation": F.col("event_id"),
    }
    return worker.fold(_events(spark, sf_dir).withColumns(facts))


@query("verification_state", f"WITH {FOLDED} SELECT * FROM state")
def verification_state(spark, sf):
    return _state(spark, sf)


@query("stop_gate", f"""WITH {FOLDED} SELECT project, (CASE WHEN coalesce(verification_status, '') <> 'verified' THEN 'no clean verification;' ELSE '' END) || (CASE WHEN edit_generation <> verified_generation THEN 'the verification is of another edit;' ELSE '' END) AS reasons,
 CASE WHEN verification_status = 'verified' AND (edit_generation = verified_generation) IS NOT FALSE THEN 'allow' ELSE 'block' END AS decision FROM state""")
def stop_gate(spark, sf):
    out = worker.decision(_state(spark, sf), "strict")
    return out.select("project", F.array_join(F.transform("reasons", lambda r: F.concat(r, F.lit(";"))), "").alias("reasons"), "decision")


@query("stop_bursts", f"""WITH {EVENTS}, s AS (SELECT project, ts, min(event_id) // 100 AS generation FROM v GROUP BY project, ts),
f AS (SELECT *, coalesce(epoch(ts) - epoch(lag(ts) OVER w) >= 30 OR generation IS DISTINCT FROM lag(generation) OVER w, true)::INT AS fresh FROM s WINDOW w AS (PARTITION BY project ORDER BY ts)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY project ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM f), c AS (SELECT project, ts, generation, row_number() OVER (PARTITION BY project, run ORDER BY ts)::INT AS count FROM r)
SELECT *, count > 3 AS tripped FROM c""")
def stop_bursts(spark, sf):
    stops = _events(spark, sf).groupBy("project", "ts").agg(F.floor(F.min("event_id") / 100).cast("long").alias("generation"))
    return worker.bursts(stops)


@query("capability_lookup", """WITH p AS (SELECT CASE WHEN event_id % 3 = 0 THEN '*' ELSE event_type END AS kind, CASE WHEN event_id % 4 = 0 THEN '' ELSE 'u' || user_id % 7 END AS who, 'c' || event_id AS capabilities, ts, event_id FROM events WHERE event_id % 5 = 0),
a AS (SELECT DISTINCT event_type AS kind, 'u' || user_id % 9 AS who FROM events), m AS (SELECT a.kind, a.who, arg_max(capabilities, (ts, capabilities)) AS capabilities FROM a JOIN p ON p.kind IN (a.kind, '*') AND p.who IN (a.who, '') GROUP BY a.kind, a.who)
SELECT a.kind, a.who, capabilities FROM a LEFT JOIN m ON a.kind = m.kind AND a.who = m.who""")
def capability_lookup(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    who = lambda n: F.concat(F.lit("u"), (F.col("user_id") % n).cast("string"))
    kind = F.when(F.col("event_id") % 3 == 0, "*").otherwise(F.col("event_type"))
    proofs = events.filter("event_id % 5 = 0").select(kind.alias("kind"), F.when(F.col("event_id") % 4 == 0, "").otherwise(who(7)).alias("who"), F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("capabilities"), F.col("ts").alias("probed_at"))
    return worker.capabilities(proofs, events.select(F.col("event_type").alias("kind"), who(9).alias("who")).distinct(), ["kind", "who"])


@query("candidate_percentiles", "WITH r AS (SELECT user_id AS run_id, count(*) AS candidates FROM events GROUP BY user_id) SELECT quantile_disc(candidates, 0.5) AS p50, quantile_disc(candidates, 0.95) AS p95 FROM r")
def candidate_percentiles(spark, sf):
    runs = spark.read.parquet(f"{sf}/events.parquet").groupBy(F.col("user_id").alias("run_id")).agg(F.count("*").alias("candidates"))
    return impact.percentiles(runs)
