"""The manifest: which files belong to a corpus, and the roles given to some of them."""

from __future__ import annotations

import json
import re
import tomllib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLES = ("editable", "reference", "mirror")


@dataclass(frozen=True)
class Source:
    path: str
    role: str | None = None
    enabled: bool = True


@dataclass(frozen=True)
class Manifest:
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    sources: tuple[Source, ...] = field(default=())


def loads(text: str) -> Manifest:
    """A manifest from TOML; raises ValueError for what it can't hold."""
    read = tomllib.loads(text)
    sources = tuple(Source(s["path"], s.get("role"), s.get("enabled", True)) for s in read.get("sources", []))
    if wrong := [s for s in sources if s.role not in (None, *ROLES)]:
        raise ValueError(f"unknown role: {wrong[0].role}")
    return Manifest(tuple(read.get("include", ())), tuple(read.get("exclude", ())), sources)


def dumps(manifest: Manifest) -> str:
    """TOML that loads() reads back. JSON's strings and arrays are TOML's too."""
    quoted = lambda v: json.dumps(v).replace("\x7f", "\\u007f")
    out = [f"include = {quoted(list(manifest.include))}", f"exclude = {quoted(list(manifest.exclude))}"]
    for s in manifest.sources:
        out += ["", "[[sources]]", f"path = {quoted(s.path)}", *([f"role = {quoted(s.role)}"] if s.role else []), f"enabled = {quoted(s.enabled)}"]
    return "\n".join(out) + "\n"


def _glob(pattern: str) -> str:
    """A regular expression: * and ** match any characters, a leading **/ may match nothing; a pattern without / holds for names."""
    bare = pattern.removeprefix("**/")
    free = bare != pattern or "/" not in pattern
    body = "".join(".*" if part.startswith("*") else "." if part == "?" else re.escape(part) for part in re.findall(r"\*+|\?|[^*?]+", bare.lstrip("/")))
    return ("^(?:.*/)?" if free else "^") + body + "$"


def matches(path: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for pattern in patterns:
        out = out | path.rlike(_glob(pattern))
    return out


def discover(files: DataFrame, manifest: Manifest) -> DataFrame:
    """files (path, role, reason, ...) with role and reason as the manifest has them.

    A source of the manifest gives its role; a disabled one excludes its file; excluded files and those that no include
    pattern matches are given a reason, unless they have one. Sources are joined, so there may be any number.
    """
    spark = files.sparkSession
    own = spark.createDataFrame([(s.path, s.role, s.enabled) for s in manifest.sources], "path string, given string, enabled boolean").dropDuplicates(["path"])
    out = files.join(own, "path", "left")
    listed = F.col("enabled").isNotNull()
    inside = matches(F.col("path"), manifest.include) if manifest.include else F.lit(True)
    reason = F.when(~F.col("enabled"), "disabled").when(~listed & matches(F.col("path"), manifest.exclude), "excluded").when(~listed & ~inside, "not_included")
    return out.withColumns({"role": F.coalesce("given", "role"), "reason": F.coalesce("reason", reason)}).select(*files.columns)
