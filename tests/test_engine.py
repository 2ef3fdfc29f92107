"""Operators of the document engine on small inputs, and each query against its SQL."""

import dataclasses
import os
import sys

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpuscle import session
from corpuscle.functions import results
from corpuscle.functions import text as X
from corpuscle.operators import chunks, find, impact, index, latex, read, search, status, store
from corpuscle.plans import catalog
from corpuscle.sources import corpus, manifest, mirror
from corpuscle.session import staged
from corpuscle.streaming import feed, worker

SF = "/root/testdata/sf0.001"


def docs(spark, *rows):
    return spark.createDataFrame([(p, "editable", "markdown", c) for p, c in rows], "path string, role string, format string, content string")


def test_find_lists_every_occurrence(spark):
    found = find.literal(docs(spark, ("guide.md", "# Guide\nThe canonical policy applies.\nA second policy policy mention.")), "policy")
    assert sorted((r.line_no, r.start_column, r.end_column) for r in found.collect()) == [(2, 14, 20), (3, 9, 15), (3, 16, 22)]
    assert find.literal(docs(spark, ("n.md", "NEEDLE line\n" * 5000)), "NEEDLE").count() == 5000


def test_find_scope_is_a_folder(spark):
    own = docs(spark, ("paper.md", "needle"), ("paper/draft.md", "needle"))
    assert [r.path for r in find.literal(own, "needle", scope="paper").collect()] == ["paper/draft.md"]
    with pytest.raises(ValueError):
        find.literal(own, "")
    with pytest.raises(ValueError):
        find.regex(own, "[unclosed")


def test_sections_nest_and_skip_fences(spark):
    got = find.sections(docs(spark, ("a.md", "# A\nx\n## B\n```\n# no\n```\n### C ##\n## D\ny\n# E"))).orderBy("start_line").collect()
    assert [(r.breadcrumb, r.start_line, r.end_line) for r in got] == [("A", 1, 2), ("A > B", 3, 6), ("A > B > C", 7, 7), ("A > D", 8, 9), ("E", 10, 10)]


def test_chunks_join_to_the_text():
    for text in ("", "a b c\n" * 400, "x" * 50_000, "word " * 3000, "\n\n\n", "one\n" + "y" * 5000 + "\ntwo", "a-b" * 900, "one\n" + "two, " * 900 + "\nthree"):
        got = chunks.pack_lines(text)
        whole = got[0][0]
        for (_, _, end), (part, start, _) in zip(got, got[1:]):
            whole += ("\n" if start > end else "") + part
        assert whole == text.removesuffix("\n") and all(chunks.count_tokens("\n\n" + t) <= chunks.HARD_TOKENS for t, _, _ in got)
        over = {n for n, line in enumerate(text.split("\n"), 1) if chunks.count_tokens("\n\n" + line) > chunks.MAX_TOKENS}
        assert all(a == b for _, a, b in got if {a, b} & over)  # a line over the target shares no chunk
    with pytest.raises(chunks.TokenBudgetError):
        chunks.pack_lines("a", "b " * 600)
    assert len(chunks.pack_lines("x" * 500_000)) > 1 and {a for _, a, _ in chunks.pack_lines("x" * 500_000)} == {1}


def test_chunks_follow_sections_and_pages(spark):
    text = "# Contract\n\n## Limits\n" + "word " * 80 + "\n## Page 3\nbody"
    own = docs(spark, ("c.md", text))
    got = chunks.chunk(own, 12, 16, find.sections(own)).orderBy("ordinal").collect()
    assert [r.breadcrumb for r in got][:2] == ["Contract", "Contract > Limits"] and all(r.token_count <= 16 for r in got)
    assert [(r.page, r.start_line, r.end_line) for r in got if r.page] == [(3, 5, 6)] and [r.ordinal for r in got] == list(range(len(got)))
    with pytest.raises(ValueError):
        chunks.pieces(["a"], "", 20, 10)


PROSE = "The discussion of this section describes several quite different ordinary words that a reader would recognise at once. "


def test_index_replaces_documents_and_keeps_low_signal_out_of_vectors(spark):
    figure = "# Figure\naxis 0.1 0.2 0.3 0.4 1e-1 axis\n# Discussion\n" + PROSE * 3
    rows = lambda *r: spark.createDataFrame([(p, "editable", f, c, h) for p, f, c, h in r], "path string, role string, format string, content string, file_hash string")
    one = index.update(index.empty(spark), rows(("a.md", "markdown", figure, "1"), ("b.md", "markdown", PROSE, "1"), ("c.pdf", "pdf", "", "1")))
    crumbs = lambda x: sorted((r.path, r.breadcrumb) for r in x.collect())
    assert crumbs(one["chunks"]) == [("a.md", "Discussion"), ("a.md", "Figure"), ("b.md", "")]
    assert crumbs(one["vectors"].join(one["chunks"], ["path", "ordinal"])) == [("a.md", "Discussion")]  # b.md has under 40 words
    assert index.metadata(one["metadata"])["edit_generation"] == 1
    same = index.update(one, one["documents"])
    assert index.metadata(same["metadata"]) == index.metadata(one["metadata"])
    two = index.update(one, rows(("a.md", "markdown", "# New\n" + PROSE * 4, "2"), ("c.pdf", "pdf", "", "1")))
    assert crumbs(two["chunks"]) == [("a.md", "New")] and index.metadata(two["metadata"])["edit_generation"] == 2
    asked = spark.createDataFrame([(1, "axis"), (2, 'reader "recognise"'), (3, "absent")], "query_id int, query string")
    found = index.hybrid(one["chunks"], one["vectors"], asked).collect()
    first = {r.query_id: (r.path, r.start_line, r.lexical_rank, r.vector_rank) for r in found if r["rank"] == 1}
    assert first[2][:2] == ("a.md", 3) and ("a.md", 1, 1, None) in {(r.path, r.start_line, r.lexical_rank, r.vector_rank) for r in found if r.query_id == 1}
    old = one["vectors"].withColumn("strategy_id", F.lit("old")).withColumn("vector", F.array(F.lit(0.0)))
    assert index.refreshed(old, one["chunks"]).collect() == one["vectors"].collect() and index.unchanged(one["documents"], one["documents"], force=True).count() == 0


def test_pdf_rows_are_indexed_through_mirrors(spark):
    pages = spark.createDataFrame([("p.pdf", 1, "first page"), ("p.pdf", 2, "second page")], "path string, page_no int, page_text string").withColumn("pdf_sha256", F.lit("s"))
    pdf = spark.createDataFrame([("p.pdf", "reference", "pdf", "", "1"), ("n.md", "editable", "markdown", "note\nmore", "1")], "path string, role string, format string, content string, file_hash string")
    both = index.with_mirrors(pdf, mirror.mirrors(pages))
    assert {r.path: r.generated_from for r in both.collect()} == {"p.pdf": None, "n.md": None, "mirrors/p.pdf.md": "p.pdf"}
    assert {(r.path, r.page) for r in index.chunked(both).collect()} >= {("mirrors/p.pdf.md", 1), ("mirrors/p.pdf.md", 2), ("n.md", None)}
    assert [r.path for r in index.without(both, both.filter("path = 'p.pdf'")).collect()] == ["n.md"]
    got = read.read(both, "p.pdf", page=2)
    assert got.path == "mirrors/p.pdf.md" and got.content.startswith("## Page 2") and got.generated_from == "p.pdf" and "second page" in got.content
    assert read.read(both, "n.md", 2, 2).content == "more" and read.read(both, "n.md").end_line == 2
    for wrong in ((("n.md",), {"page": 1}), (("n.md", 2, 9), {}), (("n.md", 0, 1), {}), (("p.pdf",), {"page": 7})):
        with pytest.raises(ValueError):
            read.read(both, *wrong[0], **wrong[1])
    with pytest.raises(read.UnknownSource):
        read.read(both, "gone.md")
    with pytest.raises(read.UnknownSource):
        read.read(pdf, "p.pdf")


def test_paths_resolve_as_a_shell_would():
    there = {"/r/sub/a.md"}
    assert read.resolve("a.md", "/r", "/r/sub", there.__contains__) == "/r/sub/a.md" and read.resolve("b.md", "/r", "/r/sub", there.__contains__) == "/r/b.md"
    assert read.resolve("/other/x.md", "/r") == "/other/x.md" and read.resolve(".", "/r") == "/r"
    for wrong in ("../x.md", "../rest/x.md"):
        with pytest.raises(read.UnknownSource):
            read.resolve(wrong, "/r")


def test_matches_span_lines_and_are_ordered(spark):
    own = docs(spark, ("b.md", "# H\nalpha one\ntwo alpha\n"), ("a.md", "x\nalpha")).withColumn("file_hash", F.lit("h"))
    got = find.ordered(find.attributed(find.matches(own, r"^alpha.*\ntwo|alpha$"), find.sections(own))).collect()
    assert [(r.path, r.start_line, r.end_line, r.start_column, r.end_column, r.match, r.breadcrumb) for r in got] == [
        ("a.md", 2, 2, 0, 5, "alpha", ""), ("b.md", 2, 3, 0, 3, "alpha one\ntwo", "H"), ("b.md", 3, 3, 4, 9, "alpha", "H")]
    assert [r.path for r in find.ordered(find.matches(own, "alpha"), "2").collect()] == ["b.md"] and find.ordered(find.matches(own, "alpha"), "x").count() == 3
    import hashlib

    assert got[1].span_hash == hashlib.sha256(b"alpha one\ntwo alpha").hexdigest() and find.matches(docs(spark, ("n.md", "NEEDLE line\n" * 5000)).withColumn("file_hash", F.lit("")), "NEEDLE").count() == 5000
    for wrong in ("[unclosed", ""):
        with pytest.raises(ValueError):
            find.matches(own, wrong)


def test_small_text_functions(spark):
    row = spark.createDataFrame([("a  b\n" + "c" * 200, "x\ny\nz", " On ", 'say "two words" two')], "t string, u string, v string, q string")
    got = row.select(
        X.one_line(F.col("t")).alias("line"), X.bounded(F.col("t"), 3).alias("cut"), X.line_of(F.col("u"), F.lit(2)).alias("at"), X.truthy(F.col("v")).alias("yes"), X.truthy(F.lit(None).cast("string")).alias("no"),
        X.query_terms(F.col("q")).alias("q"), X.whitespace_tokens(F.col("q")).alias("n"), X.embedding_input(F.lit("A > B"), F.lit("p"), "passage: ").alias("e"), X.centered_snippet(F.col("t"), ["b", "cc"], 10).alias("s"),
    ).first()
    assert got.line == "a b " + "c" * 156 + "..." and got.cut == "a  " and got.at == 2 and got.yes and not got.no
    assert got.q == ["say", "two", "words"] and got.n == 4 and got.e == "passage: A > B\n\np" and got.s == "…cccccccccc…"
    assert X.strategy_id(a=1, b="x") == X.strategy_id(b="x", a=1) != X.strategy_id(a=2, b="x")


def test_low_signal(spark):
    rows = spark.createDataFrame([("0.1 0.2 0.3 1e-1",), ("This sentence holds several quite different ordinary words",), ("",)], "t string")
    assert [r[0] for r in rows.select(X.low_signal(F.col("t"))).collect()] == [True, False, True]


def test_fusion_is_symmetric(spark):
    a, b = (spark.createDataFrame(r, "path string, rank int") for r in ([("x", 1), ("y", 2)], [("y", 1), ("z", 2)]))
    one, two = ({r.path: round(r.score, 9) for r in search.fuse(p, q, ["path"]).collect()} for p, q in ((a, b), (b, a)))
    assert one == two and one["y"] == round(1 / 62 + 1 / 61, 9)


def test_store_changes(spark):
    a = spark.createDataFrame([("p/a", "1"), ("p/b", "1"), ("c", "1")], "path string, file_hash string")
    z = spark.createDataFrame([("p/a", "1"), ("p/b", "2"), ("d", "1")], "path string, file_hash string")
    assert {(r.path, r.status) for r in store.delta(a, z).collect()} == {("p/b", "changed"), ("c", "deleted"), ("d", "added")}
    assert {r.path for r in store.relocate(a, "p", "q").collect()} == {"q/a", "q/b", "c"}
    with pytest.raises(ValueError):
        store.relocate(a.unionByName(spark.createDataFrame([("q/a", "9")], a.schema)), "p", "q").count()
    assert store.revision(a, ["path", "file_hash"]).first() == store.revision(a.orderBy(F.desc("path")), ["path", "file_hash"]).first()


def indexed(spark, *rows, before=None):
    now = spark.createDataFrame([(p, r, "markdown", c, str(hash(c))) for p, r, c in rows], "path string, role string, format string, content string, file_hash string")
    tables = index.update(before or index.empty(spark), now)
    return {k: staged(v, k) if k != "metadata" else v for k, v in tables.items()}


def decisions(spark, run, **classes):
    rows = [(r.candidate_id, classes[r.match_kind]) for r in run.candidates.collect() if r.match_kind in classes]
    return spark.createDataFrame(rows, "candidate_id string, classification string")


def test_impact_discovery_and_verification(spark, tmp_path):
    policy = "The cache policy is documented {}. " + PROSE
    rows = [("a.md", "editable", policy.format("here")), ("b.md", "editable", policy.format("there")), ("ref.md", "reference", policy.format("elsewhere"))]
    tables = indexed(spark, *rows)
    bundle = impact.Bundle("cache policy", ("cache policy", "cache policy"), ("documented there", "cache policy"), ("Where is it documented?", " "))
    assert bundle.queries() == ["cache policy", "documented there", "Where is it documented?"] and bundle.terms() == [("exact_term", "cache policy"), ("alias", "documented there")]
    run = impact.start(tables, bundle, "r1", page_size=1)
    got = {r.path: r for r in run.candidates.collect()}
    assert set(got) == {"a.md", "b.md"} and got["b.md"].match_kind == "exact_term" and got["b.md"].matched_terms == ["cache policy", "documented there", "Where is it documented?"]
    assert got["a.md"].channels == ["exact", "search"] and [r.position for r in run.candidates.orderBy("path").collect()] == [0, 1]
    wide = impact.start(tables, bundle, "r2", roles=("editable", "reference"))
    assert {r.path for r in wide.candidates.collect()} == {"a.md", "b.md", "ref.md"}
    impact.save(run, str(tmp_path))
    run = impact.load(spark, str(tmp_path), "r1")
    assert run.facts.bundle == bundle and impact.Facts.loads('{"run_id": "old", "more": 1}') == impact.Facts("old")
    with pytest.raises(impact.ReviewStateError, match="unknown run"):
        impact.load(spark, str(tmp_path), "r9")

    run, page = impact.page(run)
    assert (page.total, page.returned, page.remaining, page.next_cursor, page.number) == (2, 1, 1, "1", 0) and len(page.rows.first()["snippet"]) <= 163
    with pytest.raises(impact.ReviewStateError, match="unread"):
        impact.finish(run, tables)
    run, page = impact.page(run, page.next_cursor)
    assert page.next_cursor is None
    for cursor in ("x", -1, 9):
        with pytest.raises(ValueError):
            impact.page(run, cursor)
    with pytest.raises(impact.ReviewStateError, match="undecided"):
        impact.finish(run, tables, spark.createDataFrame([], "candidate_id string, classification string"))
    for wrong in ([("none", "needs_edit")], [(got["a.md"].candidate_id, "maybe")], [(got["a.md"].candidate_id, None)]):
        with pytest.raises(ValueError):
            impact.classify(run, spark.createDataFrame(wrong, "candidate_id string, classification string"))
    one = spark.createDataFrame([(got["a.md"].candidate_id, "uncertain", 1), (got["a.md"].candidate_id, "needs_edit", 0)], "candidate_id string, classification string, ordinal int")
    bulk = [{"selector": {"path_prefix": "a"}, "classification": "unrelated"}, {"selector": {"role": ["editable"], "match_kind": ["exact_term"]}, "classification": "consistent"}]
    unsure = impact.classify(run, one, bulk)
    assert {r.path: r.classification for r in unsure.classified().collect()} == {"a.md": "uncertain", "b.md": "consistent"}
    assert impact.progress(run, unsure) == {"decided": 2, "unclassified": 0, "first_unclassified": []} and len(unsure.facts.selectors) == 2
    with pytest.raises(impact.ReviewStateError, match="uncertain"):
        impact.finish(unsure, tables)
    edit = spark.createDataFrame([(got["a.md"].candidate_id, "needs_edit")], "candidate_id string, classification string")
    with pytest.raises(impact.ReviewStateError, match="read first"):
        impact.classify(unsure, edit)
    known, span = impact.read_candidate(unsure, tables, got["a.md"].candidate_id)
    assert span.content == rows[0][2]
    with pytest.raises(impact.ReviewStateError, match="unknown candidate"):
        impact.read_candidate(unsure, tables, "none")
    ready = impact.classify(known, edit)
    edited = indexed(spark, ("a.md", "editable", policy.format("nowhere")), *rows[1:], before=tables)
    for step in (lambda: impact.finish(ready, edited), lambda: impact.read_candidate(ready, edited, got["a.md"].candidate_id)):
        with pytest.raises(impact.CorpusChanged):
            step()
    counts = impact.metrics(ready).first()
    assert (counts.candidates, counts.relevant, counts.ratio, counts.exact_term, counts.consistent) == (2, 1, 2.0, 2, 1)
    sealed = impact.finish(ready, tables)
    assert [r.path for r in sealed.inventory.collect()] == ["a.md"]
    for step in (lambda: impact.classify(sealed.run, edit), lambda: impact.finish(sealed.run, tables)):
        with pytest.raises(impact.ReviewStateError, match="sealed"):
            step()

    verify = lambda **x: impact.start(edited, run_id="v", phase="verify", **x)
    for wrong in ({}, {"baseline": sealed, "bundle": impact.Bundle("other")}, {"baseline": sealed, "roles": ("reference",)}):
        with pytest.raises(impact.ReviewStateError):
            verify(**wrong)
    again = verify(baseline=sealed)
    assert [(r.path, r.status, r.unexpected) for r in again.drift.collect()] == [("a.md", "changed", False)]
    again, _ = impact.page(again, size=500)
    with pytest.raises(impact.ReviewStateError, match="remain"):
        impact.finish(impact.classify(again, decisions(spark, again, exact_term="needs_edit")), edited)
    done = impact.classify(again, decisions(spark, again, exact_term="consistent"))
    assert impact.finish(done, edited).facts.status == "verified"
    newer = dict(edited, metadata=index.with_metadata(edited["metadata"], {"edit_generation": 99}))
    with pytest.raises(impact.CorpusChanged):
        impact.finish(done, newer)
    for wrong in ({"phase": "x"}, {"page_size": 0}, {"bundle": impact.Bundle(" ")}, {"bundle": None}, {"roles": ("x",)}):
        with pytest.raises(ValueError):
            impact.start(tables, **{"bundle": bundle, **wrong})


def test_impact_places_that_moved(spark):
    rows = [("a.md", "editable", "intro\nneedle one"), ("b.md", "editable", "needle two")]
    tables = indexed(spark, *rows)
    run = impact.start(tables, impact.Bundle("needle"), semantic=0)
    later = indexed(spark, ("a.md", "editable", "new\n" + "\n" * 3 + "needle one"), ("b.md", "editable", "nothing left"), before=tables)
    got = {r.path: r for r in impact.resolved(run.candidates.filter("match_kind = 'exact_term'").drop("resolved"), later, "needle").collect()}
    assert got["a.md"].resolved and (got["a.md"].start_line, got["a.md"].end_line) == (1, 5) and not got["b.md"].resolved
    lost = dataclasses.replace(run, candidates=impact.positioned(impact.resolved(run.candidates.filter("path = 'b.md' AND match_kind = 'exact_term'").drop("position", "resolved"), later, "needle")))
    lost, _ = impact.page(dataclasses.replace(lost, facts=dataclasses.replace(lost.facts, revision=impact.revision(later))))
    with pytest.raises(impact.StaleSource):
        impact.finish(impact.classify(lost, None, [{"selector": {}, "classification": "consistent"}]), later)
    assert impact.start(tables, impact.Bundle("needle"), semantic=0).candidates.filter("match_kind = 'semantic_only'").count() == 0


def test_worker_acknowledges_after_success_only(spark, tmp_path):
    queue, state, seen = str(tmp_path / "q"), str(tmp_path / "s"), []
    events = spark.createDataFrame([("e1", "p", ["a.md", "b.md"]), ("e1", "p", ["a.md", "b.md"]), ("e2", "p", ["b.md"])], "event_id string, project string, files array<string>").withColumn("created_at", F.current_timestamp())
    worker.append(events, queue)
    (tmp_path / "q" / "z.json").write_text('{"event_id": "e3", "files": ["c.md"\nnot json\n')

    def work(files):
        if not seen:
            seen.append(None)
            raise ValueError("not now")
        seen.append(sorted(r.path for r in files.collect()))

    assert worker.drain(spark, queue, state, work)["status"] == "failed" and worker.acknowledged(spark, state).count() == 0
    assert "not now" in worker.errors(spark, state).first()["error"] or worker.errors(spark, state).count() == 1
    assert worker.drain(spark, queue, state, work) == {"status": "indexed", "files": 2, "events": 2} and seen[1] == ["a.md", "b.md"]
    assert {r.event_id for r in worker.acknowledged(spark, state).collect()} == {"e1", "e2"}
    worker.append(events.limit(2), queue)  # told again under the same ids
    assert worker.drain(spark, queue, state, work)["status"] == "empty" and len(seen) == 2
    with worker.only_writer(spark, state) as mine:
        assert mine and worker.drain(spark, queue, state, work)["status"] == "already_running"
    with worker.only_writer(spark, state) as mine:
        assert mine


def test_gate_and_small_state(spark):
    rows = spark.createDataFrame([("a", "Verified", 3, 3, [], 0), ("b", "verified", 3, 2, ["x.md"], 1), ("c", None, None, None, None, None)], "project string, verification_status string, edit_generation int, verified_generation int, dirty_files array<string>, needs_edit int")
    got = {r.project: (r.decision, len(r.reasons)) for r in worker.decision(rows, "strict").collect()}
    assert got == {"a": ("allow", 0), "b": ("block", 3), "c": ("block", 1)}
    assert {r.decision for r in worker.decision(rows).collect()} == {"allow", "advise"}
    assert {r.decision for r in worker.decision(rows.withColumn("tripped", F.lit(True)), "strict").collect()} == {"allow"}
    payload = {"tool_input": {"file_path": " a.md ", "text": "b.md", "edits": [{"path": "sub/c.TXT"}, {"files": ["d.png", "/e.tex", "f"]}]}, "path": 7}
    assert worker.changed_paths(payload, "/r") == ["/e.tex", "/r/a.md", "/r/sub/c.TXT"]
    assert worker.mode(None, {}) == "advisory" and worker.mode(" Strict ", {}) == "strict" and worker.mode(None, {"enforcement": {"mode": "strict"}}) == worker.mode("", {"mode": "strict"}) == "strict"
    assert worker.first_state([None, "[1]", "{bad", '{"a": 1}', '{"a": 2}']) == {"a": 1} and worker.first_state([]) == {}


def test_latex_findings(spark):
    tex = "\\label{a} \\label{a}\n50\\% \\ref{a} \\Cref{gone} % \\ref{no}\n\\iffalse\n\\ref{no}\n\\fi\n\\citep{x, y}\\label{free}\n\\def\\z{\\label{no}}\n\\begin{comment}\\ref{no}\n\\end{comment} \\autoref{late}"
    own = spark.createDataFrame([("m.tex", "latex", tex), ("b.bib", "bibtex", "@article{x,\n}\n@book{x ,\n}\n@misc{w,}"), ("n.md", "markdown", "\\ref{no}"), ("e.tex", "latex", None)], "path string, format string, content string")
    got = sorted((r.finding, r.key, r.line_no) for r in latex.check(own).collect())
    assert got == [("dangling_ref", "gone", 2), ("duplicate_entry", "x", 1), ("duplicate_entry", "x", 3), ("duplicate_label", "a", 1), ("duplicate_label", "a", 1), ("uncited_entry", "w", 5), ("undefined_citation", "y", 6), ("unused_label", "free", 6)]


def test_results_keep_text_apart_and_within_budget():
    value = {"path": "a", "Source-Snippet": {"x": ["s1", "s2"]}, "items": [{"text": "t", "line": 1}, 5], "section_breadcrumb": "b"}
    got = results.split(value)
    assert got["facts"] == {"path": "a", "items": [{"line": 1}, 5]}
    assert {(t["field"], t["value"]) for t in got["texts"]} == {("Source-Snippet.x[0]", "s1"), ("Source-Snippet.x[1]", "s2"), ("items[0].text", "t"), ("section_breadcrumb", "b")}
    assert results.bounded(value) is value
    big = {"rows": [{"n": i} for i in range(2000)], "deep": {"texts": ["y" * 900] * 500}, "one": "z" * 30_000}
    cut = results.bounded(big)
    import json

    assert len(json.dumps(cut, ensure_ascii=False)) <= 16_000 and cut["truncated"] and cut["omitted"]["rows"] > 0 and cut["note"] and len(big["rows"]) == 2000 and len(cut["one"]) == 503


def test_status_setup_and_summary(spark):
    files = spark.createDataFrame([("a.md", "editable", "markdown", None, 3), ("b.pdf", "reference", "pdf", None, 4), ("c.png", "editable", None, "unsupported", 9)], "path string, role string, format string, reason string, bytes long")
    got = {(r.included, r.role, r.format, r.reason): (r.files, r.bytes) for r in status.summary(files).collect()}
    assert got == {(True, None, None, None): (2, 7), (False, None, None, None): (1, 9), (True, "editable", None, None): (1, 3), (True, "reference", None, None): (1, 4), (True, None, "markdown", None): (1, 3), (True, None, "pdf", None): (1, 4), (False, None, None, "unsupported"): (1, 9)}
    written = []
    assert tuple(status.setup(files, written.append).first())[:2] == (2, 7) and not written
    status.setup(files, written.append, approve=True)
    assert written[0].count() == 2
    with pytest.raises(status.NotSetUp):
        status.checked(None)


def test_work_tables_are_discarded(spark):
    kept = staged(spark.range(3).toDF("id"), "kept")
    assert kept.count() == 3 and session.discard(spark) >= 1
    assert session.discard(spark) == 0


def test_pending_events(spark):
    events = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "event_id long, path string")
    assert [r.path for r in feed.pending(events, spark.createDataFrame([(2,)], "event_id long")).collect()] == ["a"]


def test_files_from_a_folder(spark, tmp_path):
    (tmp_path / "generated").mkdir()
    (tmp_path / "guide.md").write_bytes(b"\xef\xbb\xbf# Title\nBody")
    (tmp_path / "generated/x.md").write_bytes(b"text")
    (tmp_path / "bad.md").write_bytes(bytes(range(256)))
    (tmp_path / "pic.png").write_bytes(b"x")
    got = {r.path.rsplit("/", 1)[1]: r for r in corpus.files(spark, str(tmp_path)).collect()}
    assert got["guide.md"].content.startswith("# Title") and got["guide.md"].role == "editable" and got["x.md"].role == "mirror"
    assert got["bad.md"].reason == "binary" and got["pic.png"].reason == "unsupported"


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), con.execute(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    text = lambda v: "None" if pd.isna(v) else str(int(v)) if isinstance(v, float) and v == int(v) else str(v)
    rows = lambda d: sorted(tuple(map(text, r)) for r in d[sorted(d.columns)].astype(object).itertuples(index=False, name=None))
    assert rows(got) == rows(want)


def crumbs(found):
    return sorted((r.start_line, r.end_line, r.breadcrumb) for r in found.collect())


def test_markdown_preamble_and_setext(spark):
    text = "intro\n\nTitle\n=====\n## A ##\n```\n# no\n```\n\nB\n---\n# Next"
    assert crumbs(find.sections(docs(spark, ("a.md", text)))) == [(1, 2, ""), (3, 4, "Title"), (5, 9, "Title > A"), (10, 11, "Title > B"), (12, 12, "Next")]
    assert crumbs(find.sections(docs(spark, ("a.md", "\n# A")))) == [(2, 2, "A")]
    assert crumbs(find.sections(docs(spark, ("a.md", "")))) == [(1, 1, "")]
    assert crumbs(find.sections(docs(spark))) == []


def test_latex_sections_keep_rank_and_preamble(spark):
    text = "\n\\chapter{One}\n\\section*{A}\n\\paragraph{p}\nx\n\\section{B}\n\\part{Two}"
    assert crumbs(find.latex_sections(docs(spark, ("a.tex", text)))) == [(1, 1, ""), (2, 2, "One"), (3, 3, "One > A"), (4, 5, "One > A > p"), (6, 6, "One > B"), (7, 7, "Two")]


def test_bibtex_entries(spark):
    text = "% list\n@article{knuth84,\n title={x}\n}\n@Book(no\n@book{lamport94}"
    assert crumbs(find.bibtex_sections(docs(spark, ("a.bib", text)))) == [(1, 1, ""), (2, 5, "article: knuth84"), (6, 6, "book: lamport94")]


def test_jsonl_marks_malformed_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n[1]\n{"b": \n {"c": "x"}\n')
    rows = corpus.jsonl(spark, str(tmp_path / "a.jsonl")).select("malformed", F.to_json("record").alias("r"), "line").collect()
    assert [(r.malformed, r.r) for r in rows] == [(False, '{"a":1}'), (True, None), (True, None), (False, '{"c":"x"}')]


def test_mirror_of_pages(spark):
    rows = [("a.pdf", 2, "Has\x00NUL and\x0bvtab and\x0cformfeed here.", "s1"), ("a.pdf", 1, "The compres-\nsion of X-\nrays\n\n\n\nend", "s1"), ("b.pdf", 1, None, None), (None, 1, "x", "s")]
    pages = spark.createDataFrame(rows, "path string, page_no int, page_text string, pdf_sha256 string")
    made = mirror.mirrors(pages)
    got = {r.path: r for r in made.collect()}
    assert set(got) == {"a.pdf", "b.pdf"} and got["a.pdf"].pages == 2
    text = got["a.pdf"].content
    assert text.index("## Page 1") < text.index("## Page 2") and "compression" in text and "X-\nrays" in text and "\n\n\n" not in text
    assert text.endswith("HasNUL and\nvtab and\nformfeed here.\n") and "sha256: s1; format: 1; pages: 2" in text.split("\n")[0]
    assert {r.path for r in mirror.outdated(pages, made.filter("path = 'a.pdf'")).collect()} == {"b.pdf", None}
    assert [(r.path, r.span.split("\n")[0]) for r in mirror.page(made, 2).collect()] == [("a.pdf", "## Page 2")]
    assert mirror.mirrors(pages.limit(0)).count() == 0


def test_manifest_round_trip_and_discovery(spark):
    own = manifest.Manifest(("**/*.md", "notes/*"), ("draft*",), (manifest.Source("notes/\"q\".md", "reference"), manifest.Source("off.md", enabled=False), manifest.Source("draft.md")))
    assert manifest.loads(manifest.dumps(own)) == own
    with pytest.raises(ValueError):
        manifest.loads('[[sources]]\npath = "a"\nrole = "x"')
    files = spark.createDataFrame([(p, "editable", r) for p, r in [("a.md", None), ("x/a.md", None), ("notes/b.txt", None), ("c.txt", None), ("x/draft1.md", None), ("off.md", None), ("draft.md", None), ('notes/"q".md', None), ("bad.md", "binary")]], "path string, role string, reason string")
    got = {r.path: (r.role, r.reason) for r in manifest.discover(files, own).collect()}
    assert {p: v[1] for p, v in got.items() if v[1]} == {"c.txt": "not_included", "x/draft1.md": "excluded", "off.md": "disabled", "bad.md": "binary"}
    assert got['notes/"q".md'][0] == "reference" and len(got) == 9


def test_containing_in_blocks(spark):
    texts = docs(spark, ("a", "x needle y"), ("b", "pin"), ("c", "needle pin"))
    asked = spark.createDataFrame([(1, "needle"), (2, "pin"), (3, None), (4, "gone")], "query_id long, query string")
    for block in (8 << 20, 16):
        assert sorted(map(tuple, search.containing(texts, "path", "content", asked, block).collect())) == [(1, "a"), (1, "c"), (2, "b"), (2, "c")]


def test_nearest_answers_every_query(spark):
    rows = spark.createDataFrame([(i, [float(i % 7 + 1), float(i % 5), 1.0]) for i in range(40)], "vec_id long, embedding array<double>")
    asked = rows.filter("vec_id % 10 = 0").withColumn("query_id", F.col("vec_id"))
    vectors = {r.vec_id: r.embedding for r in rows.collect()}
    like = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5, 9)
    want = sorted((q, r, v) for q in (0, 10, 20, 30) for r, v in enumerate(sorted(vectors, key=lambda v: (-like(vectors[q], vectors[v]), v))[:6], 1))
    for block in (8 << 20, 64):
        assert sorted((r.query_id, r["rank"], r.vec_id) for r in search.nearest(rows, "vec_id", "embedding", asked, 6, block).collect()) == want
