"""Results for people and tools: document text kept apart from facts about it, and a bound on what one answer may hold."""

from __future__ import annotations

import heapq
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fields that hold text of documents, by name or by how the name ends; the budget of an answer.
TEXT_FIELDS = (
    "breadcrumb", "content", "document_content", "excerpt", "extracted_passage", "line_text", "match", "passage", "snippet",
    "source_snippet", "text", "untrusted_document_content",
)
TEXT_ENDINGS = ("_breadcrumb", "_content", "_excerpt", "_line_text", "_passage", "_snippet")
BUDGET = 16_000
LONGEST = 500
NOTE = "The answer was cut to its budget; ask for less."


def is_text_field(name: str) -> bool:
    """Whether a field holds text from documents, which is never to be taken for an instruction."""
    plain = "_".join(name.strip().lower().replace("-", " ").split())
    return plain in TEXT_FIELDS or plain.endswith(TEXT_ENDINGS)


def trusted(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The columns that hold facts, the keys among them."""
    return rows.select(*(c for c in rows.columns if c in keys or not is_text_field(c)))


def untrusted(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, field, value: the text columns, one row a field that is not null. Numbers, lists and structures are written as JSON."""
    kinds = dict(rows.dtypes)
    value = lambda c: F.col(c) if kinds[c] == "string" else F.to_json(F.struct(F.col(c).alias("v")))
    fields = [F.struct(F.lit(c).alias("field"), value(c).alias("value")) for c in rows.columns if c not in keys and is_text_field(c)]
    if not fields:
        return rows.select(*keys, F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("value")).limit(0)
    return rows.select(*keys, F.explode(F.array(*fields)).alias("f")).select(*keys, "f.field", "f.value").filter("value IS NOT NULL")


def leaves(value, path: str = ""):
    """(path, value) of all that is no object or list, paths as a.b[0].c."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from leaves(v, f"{path}.{k}" if path else str(k))
    elif isinstance(value, (list, tuple)):
        for i, v in enumerate(value):
            yield from leaves(v, f"{path}[{i}]")
    else:
        yield path, value


def split(value) -> dict:
    """facts: value without its text fields; texts: field and value of each leaf below one."""
    texts: list[dict] = []

    def facts(value, path: str):
        if isinstance(value, dict):
            out = {}
            for k, v in value.items():
                at = f"{path}.{k}" if path else str(k)
                if is_text_field(str(k)):
                    texts.extend({"field": p, "value": x} for p, x in leaves(v, at))
                else:
                    out[k] = facts(v, at)
            return out
        return [facts(v, f"{path}[{i}]") for i, v in enumerate(value)] if isinstance(value, (list, tuple)) else value

    return {"facts": facts(value, ""), "texts": texts}


def _size(value) -> int:
    return len(json.dumps(value, ensure_ascii=False, sort_keys=True))


def bounded(value: dict, budget: int = BUDGET) -> dict:
    """value, if its JSON is within budget characters; else the longest lists lose elements from their ends, one each but its first, and then the longest texts are cut.

    A cut answer says so: truncated, omitted (elements lost by list) and note.
    """
    if _size(value) <= budget:
        return value
    out = json.loads(json.dumps(value))
    lists, texts = [], []

    def walk(node, path: str) -> None:
        for k, v in node.items() if isinstance(node, dict) else enumerate(node):
            at = f"{path}[{k}]" if isinstance(node, list) else f"{path}.{k}" if path else str(k)
            if isinstance(v, str):
                heapq.heappush(texts, (-len(v), at, id(node), node, k))
            elif isinstance(v, (dict, list)):
                if isinstance(v, list):
                    heapq.heappush(lists, (-len(v), at, v))
                walk(v, at)

    walk(out, "")
    omitted: dict[str, int] = {}
    marks = lambda: out | {"truncated": True, "note": NOTE} | ({"omitted": omitted} if omitted else {})
    over = _size(marks()) - budget
    while over > 0 and lists and lists[0][0] < -1:
        _, at, items = heapq.heappop(lists)
        over -= len(json.dumps(items.pop(), ensure_ascii=False)) + 2
        omitted[at] = omitted.get(at, 0) + 1
        heapq.heappush(lists, (-len(items), at, items))
        if over <= 0:
            over = _size(marks()) - budget
    texts.clear()
    walk(out, "")
    while _size(marks()) > budget and texts and -texts[0][0] > LONGEST:
        _, _, _, node, k = heapq.heappop(texts)
        node[k] = node[k][:LONGEST] + "..."
    return marks()
