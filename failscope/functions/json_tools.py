"""JSON at the two ends where Catalyst's own functions can't keep its identity: argument keys at
ingest, and free-form answers of a judge."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(value) -> str:
    """Sorted keys, default separators, ASCII: ``1`` and ``1.0`` stay different."""
    return json.dumps(value, sort_keys=True, default=str)


def compact(value, limit: int = 80) -> str:
    text = json.dumps(value, separators=(",", ":"), default=str)
    return text if len(text) <= limit else text[: limit - 1] + "…"


def object_in(text: str | None):
    """The JSON value in an answer: all of it, else its fenced block, else the first balanced object.

    Raises ValueError where there is none.
    """
    body = (text or "").strip()
    fenced = re.search(r"```(?:json)?\s*(.*?)```", body, re.DOTALL)
    for candidate in (body, fenced and fenced.group(1).strip()):
        if candidate:
            try:
                return json.loads(candidate)
            except ValueError:
                continue
    begin = body.find("{")
    if begin >= 0 and (end := _balanced_end(body, begin)) is not None:
        return json.loads(body[begin:end])
    raise ValueError("no JSON object in the answer")


#: What matters to the balance of braces: strings whole (an open one reaches the end), and braces.
_BRACES = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\Z)|[{}]', re.DOTALL)


def _balanced_end(body: str, begin: int) -> int | None:
    depth = 0
    for token in _BRACES.finditer(body, begin):
        depth += {"{": 1, "}": -1}.get(token.group(), 0)
        if depth == 0 and token.group() == "}":
            return token.end()
    return None


def split_reasoning(text: str | None) -> tuple[str, str]:
    """(answer, reasoning) of a model that thinks aloud between ``<think>`` and ``</think>``.

    A first block is cut out. Where the tag was opened before the answer began, all up to the first
    closing tag is reasoning; where it is never closed, there is no answer.
    """
    body = text or ""
    low = body.lower()
    opened, closed = low.find("<think>"), low.find("</think>")
    if opened >= 0 and (end := low.find("</think>", opened)) >= 0:
        end += len("</think>")
        return (body[:opened] + body[end:]).strip(), body[opened:end].strip()
    if closed >= 0:
        end = closed + len("</think>")
        return body[end:].strip(), body[:end].strip()
    if opened >= 0:
        return "", body.strip()
    return body.strip(), ""


def args_keys(arguments: Column) -> Column:
    """JSON array of JSON texts -> JSON array of their canonical texts; what can't be parsed stays."""

    def one(item):
        try:
            return canonical(json.loads(item))
        except (TypeError, ValueError):
            return item

    def over(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: json.dumps([one(item) for item in json.loads(text or "[]")]))

    return F.pandas_udf(over, "string")(arguments)


ANSWER = "struct<ok: boolean, critical_step: string, category: string, cause: string, counterfactual: string, confidence: string>"


def parse_answer(answer: Column | str) -> Column:
    """The fields of a judge's answer as JSON texts (cause and counterfactual as plain texts)."""
    fields = ("critical_step", "category", "cause", "counterfactual", "confidence")

    def one(text):
        try:
            found = object_in(text)
        except ValueError:
            return (False, *[None] * len(fields))
        found = found if isinstance(found, dict) else {}
        raw = [found.get(f) for f in fields]
        return (True, *[str(v or "") if f in ("cause", "counterfactual") else None if v is None else json.dumps(v) for f, v in zip(fields, raw, strict=True)])

    def over(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t) for t in texts], columns=["ok", *fields])

    return F.pandas_udf(over, ANSWER)(answer)
