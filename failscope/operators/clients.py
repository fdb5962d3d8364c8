"""Clients of models over HTTP, with the standard library alone."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field

from failscope.functions.coercion import PRICES
from failscope.functions.json_tools import split_reasoning
from failscope.operators.judge import Response

#: Statuses that pass, and the longest pause between two attempts.
TRANSIENT = frozenset((408, 409, 429, 500, 502, 503, 504))
LONGEST_PAUSE = 30.0


class TransportError(Exception):
    """The request got no answer."""


def call_price(model: str, tokens_in: int, tokens_out: int) -> float:
    rates = next(((i, o) for name, i, o in PRICES if model.startswith(name)), (0.0, 0.0))
    return (tokens_in * rates[0] + tokens_out * rates[1]) / 1e6


def with_retries(send: Callable[[], tuple[int, dict]], retries: int = 13, pause: Callable[[float], None] = time.sleep) -> dict:
    """The body of the first answer with a good status.

    Transport errors and transient statuses are tried again after 1, 2, 4 ... up to 30 seconds; any
    other bad status raises at once.
    """
    last = ""
    for attempt in range(retries + 1):
        try:
            status, body = send()
        except TransportError as failure:
            last = str(failure)
        else:
            if status < 400:
                return body
            if status not in TRANSIENT:
                raise RuntimeError(f"request refused with status {status}: {body}")
            last = f"status {status}"
        if attempt < retries:
            pause(min(2.0**attempt, LONGEST_PAUSE))
    raise RuntimeError(f"no answer after {retries + 1} attempts: {last}")


def post_json(url: str, payload: dict, headers: dict[str, str], timeout: float) -> tuple[int, dict]:
    request = urllib.request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.status, json.loads(answer.read() or b"{}")
    except urllib.error.HTTPError as refused:
        return refused.code, {"error": refused.read().decode(errors="replace")[:500]}
    except (urllib.error.URLError, TimeoutError, ConnectionError) as failure:
        raise TransportError(str(failure)) from failure


@dataclass
class ChatClient:
    """A chat-completions endpoint. ``structured``: ask for JSON by schema; models that think aloud must
    be left free, and their reasoning is cut off before the answer is parsed."""

    model: str
    base_url: str
    api_key: str = ""
    timeout: float = 300.0
    retries: int = 13
    structured: bool | None = None
    post: Callable = post_json
    extra: dict = field(default_factory=dict)

    def complete(self, prompt: str, *, system: str | None = None, schema: dict | None = None, max_tokens: int = 8192) -> Response:
        messages = ([{"role": "system", "content": system}] if system else []) + [{"role": "user", "content": prompt}]
        payload = {"model": self.model, "messages": messages, "max_tokens": max_tokens, **self.extra}
        structured = "thinking" not in self.model.lower() if self.structured is None else self.structured
        if schema and structured:
            payload["response_format"] = {"type": "json_schema", "json_schema": {"name": "answer", "schema": schema}}
        began = time.perf_counter()
        body = with_retries(lambda: self.post(f"{self.base_url.rstrip('/')}/chat/completions", payload, {"Authorization": f"Bearer {self.api_key}"}, self.timeout), self.retries)
        usage = body.get("usage") or {}
        spent = int(usage.get("prompt_tokens") or 0), int(usage.get("completion_tokens") or 0)
        text = ((body.get("choices") or [{}])[0].get("message") or {}).get("content") or ""
        return Response(split_reasoning(text)[0], self.model, *spent, time.perf_counter() - began, call_price(self.model, *spent))


@dataclass
class MessagesClient:
    """A messages endpoint. Sampling parameters are not sent; a refusal is an answer without text."""

    model: str
    api_key: str = ""
    base_url: str = "https://api.anthropic.com"
    effort: str = "high"
    timeout: float = 300.0
    retries: int = 13
    post: Callable = post_json

    def complete(self, prompt: str, *, system: str | None = None, schema: dict | None = None, max_tokens: int = 8192) -> Response:
        shape = {"format": {"type": "json_schema", "schema": schema}} if schema else {}
        payload = {"model": self.model, "max_tokens": max_tokens, "messages": [{"role": "user", "content": prompt}], "output_config": {"effort": self.effort, **shape}}
        if system:
            payload["system"] = system
        headers = {"x-api-key": self.api_key, "anthropic-version": "2023-06-01"}
        began = time.perf_counter()
        body = with_retries(lambda: self.post(f"{self.base_url.rstrip('/')}/v1/messages", payload, headers, self.timeout), self.retries)
        parts = [] if body.get("stop_reason") == "refusal" else body.get("content") or []
        usage, model = body.get("usage") or {}, body.get("model") or self.model
        spent = int(usage.get("input_tokens") or 0), int(usage.get("output_tokens") or 0)
        return Response("".join(p.get("text", "") for p in parts if p.get("type") == "text"), model, *spent, time.perf_counter() - began, call_price(model, *spent))


#: The tiers, their clients and the models they use unless another is named.
TIERS = {"frontier": (MessagesClient, "claude-opus-5"), "small": (ChatClient, "qwen3:4b")}


def build_client(tier: str, model: str | None = None, **options):
    """The client of a tier; ``options`` are its fields."""
    if tier not in TIERS:
        raise ValueError(f"unknown tier {tier!r}; known: {', '.join(sorted(TIERS))}")
    kind, usual = TIERS[tier]
    name = model or usual
    if kind is ChatClient:
        options = {"base_url": "http://localhost:11434/v1", "structured": "thinking" not in name.lower(), **options}
    return kind(name, **options)
