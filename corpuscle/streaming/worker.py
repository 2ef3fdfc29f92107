"""The edit worker: a durable queue of events, one drain at a time, acknowledgements, the verification state and the stop gate."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..sources.corpus import FORMATS

EVENT = "event_id string, created_at timestamp, project string, files array<string>"
# The keys under which an editor's payload names files; states that count as clean; the burst a gate allows.
PATH_KEYS = (
    "file_path", "filepath", "path", "notebook_path", "file", "files", "file_paths", "changed_file", "changed_files", "edited_file", "edited_files",
    "modified_file", "modified_files", "source_path",
)
CLEAN = ("verified", "passed", "clean", "ok", "success")
COUNTERS = ("needs_edit", "unresolved", "uncertain", "unclassified", "scope_drift_files")
BURST, GAP = 3, 30


def changed_paths(payload: dict, folder: str = "") -> list[str]:
    """The source files that a payload names, sorted: texts under PATH_KEYS at any depth, and no other text; of known formats only."""
    found, todo = set(), [(payload, False)]
    while todo:
        value, named = todo.pop()
        if isinstance(value, dict):
            todo += [(v, str(k).lower() in PATH_KEYS) for k, v in value.items()]
        elif isinstance(value, (list, tuple)):
            todo += [(v, named) for v in value]
        elif named and isinstance(value, str) and value.strip():
            path = value.strip()
            found.add(path if path.startswith("/") or not folder else f"{folder.rstrip('/')}/{path}")
    return sorted(p for p in found if p.rsplit(".", 1)[-1].lower() in FORMATS and "." in p.rsplit("/", 1)[-1])


def append(events: DataFrame, queue: str) -> None:
    """Events (EVENT) added to the queue as JSON lines; a file appears when it is whole."""
    events.write.mode("append").json(queue)


def acknowledged(spark: SparkSession, state: str) -> DataFrame:
    """event_id of what was worked off; nothing where no drain has succeeded."""
    return _table(spark, f"{state}/acks", "event_id string, batch long").select("event_id")


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = made.getFileSystem(spark._jsc.hadoopConfiguration()).exists(made)
    return spark.read.schema(schema).json(path) if there else spark.createDataFrame([], schema)


@contextmanager
def only_writer(spark: SparkSession, state: str) -> Iterator[bool]:
    """Whether this is the one writer of state: a lock file that only one can create. Needs a file system that creates atomically."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{state}/lock")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path.getParent())
    try:
        mine = bool(files.createNewFile(path))
    except Exception as e:
        if "FileAlreadyExists" not in str(e):
            raise
        mine = False
    try:
        yield mine
    finally:
        if mine:
            files.delete(path, False)


def drain(spark: SparkSession, queue: str, state: str, work: Callable[[DataFrame], None]) -> dict:
    """Everything in the queue worked off at once: status (indexed, empty, failed or already_running), files and events.

    work gets the distinct files (path) of all events not yet acknowledged. Only when it returns are they acknowledged, under
    the batch's number, so a repeat writes the same; when it raises, the error is kept beside the acknowledgements, the
    events stay pending, and the next drain takes them up. Events repeat safely; lines that are no events are passed over.
    """
    done = {"status": "empty", "files": 0, "events": 0}

    def batch(rows: DataFrame, number: int) -> None:
        whole = rows.filter("event_id IS NOT NULL").dropDuplicates(["event_id"])
        pending = whole.join(acknowledged(spark, state), "event_id", "left_anti").persist()
        try:
            events = pending.count()
            if not events:
                return
            files = pending.select(F.explode("files").alias("path")).filter("path IS NOT NULL").distinct()
            work(files)
            done.update(status="indexed", files=done["files"] + files.count(), events=done["events"] + events)
            pending.select("event_id", F.lit(number).alias("batch")).write.mode("overwrite").json(f"{state}/acks/batch={number}")
        finally:
            pending.unpersist()

    with only_writer(spark, state) as mine:
        if not mine:
            return done | {"status": "already_running"}
        stream = spark.readStream.schema(EVENT).option("mode", "PERMISSIVE").json(queue)
        try:
            stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{state}/progress").trigger(availableNow=True).start().awaitTermination()
        except StreamingQueryException as e:
            error = [(str(e).splitlines()[0][:500],)]
            spark.createDataFrame(error, "error string").withColumn("at", F.current_timestamp()).write.mode("append").json(f"{state}/errors")
            return done | {"status": "failed"}
    return done


def errors(spark: SparkSession, state: str) -> DataFrame:
    """error, at of the drains that failed."""
    return _table(spark, f"{state}/errors", "error string, at timestamp")


def fold(results: DataFrame) -> DataFrame:
    """project, edit_generation, verified_generation, verification_status, baseline_run_id after all results of operations.

    results: project, ts, event_id, operation (index, impact_start, impact_finish), ok, phase, status, run_id,
    baseline_run_id, edit_generation. Failed ones tell nothing. Each fact is the latest of those that state it, so a project
    is folded in parts, whatever the number of its results.
    """
    kept = results.filter("ok")
    start, finish = F.col("operation") == "impact_start", F.col("operation") == "impact_finish"
    verified = finish & (F.lower("status") == "verified")
    sealed = finish & F.col("baseline_run_id").isNotNull()
    told = F.when(verified, "verified").when(sealed, "baseline_sealed").when(start & (F.col("phase") == "verify"), "pending").when(start & F.col("run_id").isNotNull(), "baseline_open")
    base = F.when(sealed, F.col("baseline_run_id")).when(start & (F.coalesce("phase", F.lit("")) != "verify"), F.col("run_id"))
    latest = lambda value: F.max(F.when(value.isNotNull(), F.struct("ts", "event_id", value.alias("value"))))["value"]
    facts = {"edit_generation": F.col("edit_generation"), "verified_generation": F.when(verified, F.col("edit_generation")), "verification_status": told, "baseline_run_id": base}
    return kept.groupBy("project").agg(*(latest(value).alias(name) for name, value in facts.items()))


def reasons(state: DataFrame) -> DataFrame:
    """state with reasons: why a project is not verified as it stands; none if it is.

    Reads verification_status, edit_generation, verified_generation, dirty_files, pending_events and COUNTERS, as far as there.
    """
    there = lambda c: F.col(c) if c in state.columns else F.lit(None)
    clean = F.lower(F.trim(F.coalesce(there("verification_status").cast("string"), F.lit("")))).isin(*CLEAN)
    stale = there("edit_generation").cast("string") != there("verified_generation").cast("string")
    dirty = F.size(there("dirty_files").cast("array<string>")) > 0
    checks = [
        F.when(dirty, F.lit("files wait for indexing")), F.when(there("pending_events").cast("long") > 0, F.lit("events wait for the worker")), F.when(~clean, F.lit("no clean verification")),
        F.when(stale, F.lit("the verification is of another edit")), *(F.when(there(c).cast("long") > 0, F.lit(f"{c} reported")) for c in COUNTERS),
    ]
    return state.withColumn("reasons", F.filter(F.array(*checks), lambda r: r.isNotNull()))


def bursts(stops: DataFrame) -> DataFrame:
    """stops (project, ts, generation) with count, of attempts in a row under one generation less than 30 s apart, and tripped, over 3.

    A project's attempts are people's, so one task holds them.
    """
    by = Window.partitionBy("project").orderBy("ts")
    seconds = lambda c: c.cast("timestamp").cast("double")
    fresh = (seconds(F.col("ts")) - seconds(F.lag("ts").over(by)) >= GAP) | ~F.col("generation").eqNullSafe(F.lag("generation").over(by))
    run = stops.withColumn("run", F.sum(F.coalesce(fresh, F.lit(True)).cast("int")).over(by))
    counted = run.withColumn("count", F.row_number().over(Window.partitionBy("project", "run").orderBy("ts")))
    return counted.withColumn("tripped", F.col("count") > BURST).drop("run")


def decision(state: DataFrame, mode: str = "advisory") -> DataFrame:
    """reasons() with decision: allow, where nothing is amiss or a burst has tripped; else advise, or block in strict mode."""
    out = reasons(state)
    free = F.size("reasons") == 0
    free = free | F.coalesce("tripped", F.lit(False)) if "tripped" in state.columns else free
    return out.withColumn("decision", F.when(free, "allow").otherwise("block" if mode.strip().lower() == "strict" else "advise"))


def capabilities(proofs: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """asked (keys) with the capabilities of the newest proof (keys, capabilities, probed_at) whose keys are equal, empty or *.

    A key left open is empty or *; each row asks for all of the few patterns, so proofs are found by an equality join.
    """
    shape = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))).isin("", "*"), "*").otherwise(c)
    own = proofs.select(*(shape(F.col(k)).alias(k) for k in keys), "capabilities", "probed_at")
    newest = own.groupBy(*keys).agg(F.max(F.struct("probed_at", "capabilities")).alias("proof"))
    pattern = asked.select(*keys).distinct()
    for k in keys:
        pattern = pattern.withColumn(f"at_{k}", F.explode(F.array(F.col(k), F.lit("*"))))
    found = pattern.join(newest.select(*(F.col(k).alias(f"at_{k}") for k in keys), "proof"), [f"at_{k}" for k in keys])
    best = found.groupBy(*keys).agg(F.max("proof")["capabilities"].alias("capabilities"))
    return asked.join(best, keys, "left")


def mode(override: str | None, local: dict) -> str:
    """How strictly edits are held: the override, else the local settings' enforcement mode, else advisory."""
    if override and override.strip():
        return override.strip().lower()
    table = local.get("enforcement")
    found = table.get("mode") if isinstance(table, dict) else table
    return str(found or local.get("enforcement_mode") or local.get("mode") or "advisory").strip().lower()


def first_state(texts: list[str | None]) -> dict:
    """The first of several snapshots that is a JSON object; an empty one if none is."""
    for text in texts:
        try:
            value = json.loads(text or "")
        except ValueError:
            continue
        if isinstance(value, dict):
            return value
    return {}
