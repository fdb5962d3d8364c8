"""Exports of observations below traces."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from failscope.sources.messages import assemble, calls_of, documents, first_of, flat_text, maybe_json, read_payloads

#: Where a payload's text is, and what the names of tools contain.
TEXT_KEYS = ("content", "text", "output", "result", "value")
TOOL_WORDS = ("tool", "function", "retriever", "api")
CHAT_ROLES = frozenset(("system", "user", "assistant", "tool"))

_nested = partial(maybe_json, only_nested=True)
_text = partial(flat_text, keys=TEXT_KEYS, keep_empty=True)


def observations_of(payload) -> Iterator[tuple[str, dict | None, dict | None]]:
    """(trace, observation, trace record) of lists, pages, traces and bare observations."""
    if isinstance(payload, list):
        for item in payload:
            yield from observations_of(item)
    elif isinstance(payload, dict) and isinstance(payload.get("data"), list):
        yield from observations_of(payload["data"])
    elif isinstance(payload, dict) and isinstance(payload.get("observations"), list):
        trace = str(first_of(payload, "id", "traceId", "trace_id", default="langfuse-trace"))
        yield trace, None, payload
        yield from ((trace, o, None) for o in payload["observations"] if isinstance(o, dict))
    elif isinstance(payload, dict):
        yield str(first_of(payload, "traceId", "trace_id", default="langfuse-trace")), payload, None


def chat_of(value) -> list[dict]:
    """Chat messages of a payload: a list below a known field, the payload itself, or its items."""
    value = _nested(value)
    if isinstance(value, dict):
        below = (_nested(value[k]) for k in ("messages", "input", "prompt") if k in value)
        inner = next((x for x in below if isinstance(x, list)), None)
        if inner is not None:
            return [m for m in inner if isinstance(m, dict)]
        return [value] if "role" in value else []
    return [m for m in value if isinstance(m, dict) and "role" in m] if isinstance(value, list) else []


def is_tool(observation: dict) -> bool:
    kind, name = str(first_of(observation, "type", default="")).upper(), str(first_of(observation, "name", default="")).lower()
    return kind != "GENERATION" and (kind == "TOOL" or any(w in name for w in TOOL_WORDS))


def _calls(message: dict) -> list[dict]:
    return calls_of(first_of(message, "tool_calls", "toolCalls"), ("args",), _nested)


def rows_of(text: str, file: str) -> Iterator[dict]:
    found = [x for payload in documents(text, file) for x in observations_of(payload)]
    for number, (trace, observation, record) in enumerate(found):
        if record is not None:
            title = record.get("name")
            yield {"trace": trace, "record_no": number, "message_no": -1, "role": "hidden", "kind": "context", "fallback": _text(first_of(record, "input", default="")), "title": None if title is None else str(title)}
            continue
        head = {"trace": trace, "sort_text": str(first_of(observation, "startTime", "start_time", default="")), "record_no": number}
        yield head | {"message_no": -1, "role": "hidden", "kind": "context"}
        name = str(first_of(observation, "name", default=""))
        if is_tool(observation):
            body = _text(first_of(observation, "output", default=""))
            failed = str(first_of(observation, "level", default="")).upper() in ("ERROR", "WARNING") or bool(_text(first_of(observation, "statusMessage", "status_message", default="")))
            yield head | {"message_no": 0, "role": "tool", "agent": name or "tool", "content": body, "result": {"call_id": None, "name": name or None, "content": body, "is_error": failed}}
            continue
        asked = chat_of(first_of(observation, "input"))
        if str(first_of(observation, "type", default="")).upper() != "GENERATION" and not asked:
            continue
        said: list[dict] = []
        for message in asked:
            role = str(message.get("role", "user")).lower()
            said.append({"role": role if role in CHAT_ROLES else "agent", "content": _text(message.get("content")), "calls": _calls(message)})
        output = _nested(first_of(observation, "output"))
        answers = chat_of(output)
        if answers:
            said += [{"role": "assistant", "agent": name or None, "content": _text(m.get("content")), "calls": _calls(m)} for m in answers]
        elif output is not None and _text(output):
            said.append({"role": "assistant", "agent": name or None, "content": _text(output), "calls": _calls(output) if isinstance(output, dict) else []})
        for place, message in enumerate(said):
            yield head | {"message_no": place} | message


def read_langfuse(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(trajectories, steps), a trace for each trace id."""
    return assemble(read_payloads(spark, path, rows_of), "langfuse")
