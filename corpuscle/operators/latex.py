"""Consistency of LaTeX and BibTeX sources: references without labels, citations without entries, and the reverse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

# The commands that define and use keys.
LABEL = r"\\label\{([^}]*)\}"
REF = r"\\(?:[Cc]?ref|eqref|autoref)\{([^}]*)\}"
CITE = r"\\cite[a-zA-Z]*\{([^}]*)\}"
ENTRY = r"@\w+\{([^,\s]+)\s*,"
MACRO = r"\\(?:newcommand|renewcommand|providecommand|def|let)\b"
SEVERITY = {"dangling_ref": "error", "unused_label": "warning", "undefined_citation": "error", "uncited_entry": "warning", "duplicate_label": "error", "duplicate_entry": "error"}


def source_lines(docs: DataFrame) -> DataFrame:
    """path, format, line_no, line of LaTeX and BibTeX sources, without comments, comment environments, disabled parts and lines that define macros.

    A comment starts at a % without a backslash before it. Environments are paired by a running balance over a file's lines.
    """
    own = docs.filter(F.col("format").isin("latex", "bibtex")).select("path", "format", F.posexplode(F.split("content", "\n", -1)).alias("at", "line"))
    free = F.regexp_replace("line", r"(?<!\\)%.*$", "")
    count = lambda pattern: F.size(F.regexp_extract_all(free, F.lit(f"({pattern})"), F.lit(1)))
    by = Window.partitionBy("path").orderBy("at")
    kept = own
    for name, begin, end in (("comment", r"\\begin\{comment\}", r"\\end\{comment\}"), ("iffalse", r"\\iffalse\b", r"\\fi\b")):
        kept = kept.withColumn(f"{name}_open", count(begin)).withColumn(f"{name}_shut", count(end))
        before = F.sum(F.col(f"{name}_open") - F.col(f"{name}_shut")).over(by.rowsBetween(Window.unboundedPreceding, -1))
        kept = kept.withColumn(f"in_{name}", (F.coalesce(before, F.lit(0)) > 0) | (F.col(f"{name}_open") > 0))
    hidden = F.col("in_comment") | F.col("in_iffalse") | F.col("line").rlike(MACRO)
    return kept.filter(~hidden).select("path", "format", (F.col("at") + 1).alias("line_no"), free.alias("line"))


def keys(lines: DataFrame) -> DataFrame:
    """kind (label, ref, cite, entry), key, path, line_no of every key in use; a citation's several keys are one row each."""
    held = lambda pattern: F.regexp_extract_all("line", F.lit(pattern), F.lit(1))
    named = lambda kind, found: F.transform(found, lambda k: F.struct(F.lit(kind).alias("kind"), F.trim(k).alias("key")))
    cited = F.flatten(F.transform(held(CITE), lambda g: F.split(g, ",")))
    tex = F.concat(named("label", held(LABEL)), named("ref", held(REF)), named("cite", cited))
    found = F.when(F.col("format") == "bibtex", named("entry", held(ENTRY))).otherwise(tex)
    return lines.select("path", "line_no", F.explode(found).alias("k")).select("k.kind", "k.key", "path", "line_no").filter("key <> ''")


def check(docs: DataFrame) -> DataFrame:
    """finding, severity, key, path, line_no: each place of a key that is used but not defined, defined but not used, or defined twice."""
    from ..session import staged

    found = staged(keys(source_lines(docs)), "keys")
    kind = lambda name: found.filter(F.col("kind") == name).drop("kind")
    missing = lambda name, rows, others: rows.join(others.select("key").distinct(), "key", "left_anti").withColumn("finding", F.lit(name))
    twice = lambda name, rows: rows.join(rows.groupBy("key").count().filter("count > 1").select("key"), "key", "left_semi").withColumn("finding", F.lit(name))
    label, ref, cite, entry = (kind(x) for x in ("label", "ref", "cite", "entry"))
    out = [
        missing("dangling_ref", ref, label), missing("unused_label", label, ref), missing("undefined_citation", cite, entry), missing("uncited_entry", entry, cite),
        twice("duplicate_label", label), twice("duplicate_entry", entry),
    ]
    rows = out[0]
    for x in out[1:]:
        rows = rows.unionByName(x)
    return rows.withColumn("severity", severity(F.col("finding"))).select("finding", "severity", "key", "path", "line_no")


def severity(finding: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in SEVERITY.items() for x in pair)), finding)
