"""Calls as JSON objects within replies, found by scanning for objects; in Arrow batches."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_DECODER = json.JSONDecoder()
TAGS = ("think", "action", "answer", "observation")


def objects(text: str) -> list[tuple[int, int, dict]]:
    """Start, end and value of the outermost JSON objects of a text, in order."""
    out, at = [], text.find("{")
    while at >= 0:
        try:
            value, end = _DECODER.raw_decode(text, at)
            out.append((at, end, value))
        except (ValueError, RecursionError):
            end = at + 1
        at = text.find("{", end)
    return out


def _first(text: str | None) -> dict | None:
    """The first object with a tool's name and an input; its input's values as strings."""
    for _, _, v in objects(text or ""):
        if isinstance(v.get("tool"), str) and isinstance(v.get("input"), dict):
            return {"tool": v["tool"], "input": {k: x if isinstance(x, str) else json.dumps(x) for k, x in v["input"].items()}}
    return None


def _rest(text: str | None) -> str | None:
    if text is None:
        return None
    for start, end, v in reversed(objects(text)):
        if "tool" in v:
            text = text[:start] + text[end:]
    for tag in TAGS:
        text = text.replace(f"<{tag}>", "").replace(f"</{tag}>", "")
    return text.strip()


def bare_call(text: Column) -> Column:
    """tool and input of the first JSON call that stands in a text without tags; null where there is none or it is broken."""
    found = F.pandas_udf(lambda s: s.map(lambda x: json.dumps(v) if (v := _first(x)) else None), "string")(text)
    return F.from_json(found, "tool string, input map<string,string>")


def without_tags_and_calls(text: Column) -> Column:
    """A reply without the agent's tags and without JSON objects that name a tool, stripped."""
    return F.pandas_udf(lambda s: pd.Series([_rest(x) for x in s], dtype=object), "string")(text)
