"""Calls to model endpoints from partitions: bounded concurrency, retries, structured answers."""

from __future__ import annotations

import asyncio
import hashlib
import json
import urllib.error
import urllib.request
from collections.abc import Awaitable, Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from millrace.plans.row import Row

#: Statuses that are worth another try.
RETRIED = (408, 409, 429)


class RequestError(Exception):
    def __init__(self, status: int | None, message: str, headers: Mapping[str, str] | None = None):
        super().__init__(message)
        self.status, self.headers = status, {k.lower(): v for k, v in (headers or {}).items()}


class OutputError(ValueError):
    """An answer that does not have the form that was asked for."""


def retryable(e: Exception) -> bool:
    if isinstance(e, RequestError):
        return e.status is None or e.status in RETRIED or e.status >= 500
    return isinstance(e, (ConnectionError, TimeoutError))


def delay(e: Exception, tries: int, base: float = 2.0) -> float:
    """Seconds to wait: what the answer asks for if it is under a minute, else doubling."""
    headers = e.headers if isinstance(e, RequestError) else {}
    for name, unit in (("retry-after-ms", 1e-3), ("retry-after", 1.0)):
        try:
            asked = float(headers[name]) * unit
        except (KeyError, ValueError):
            continue
        if 0 <= asked < 60:
            return asked
    return base * 2**tries


async def with_retries(call: Callable[[], Awaitable[Any]], retries: int = 2, sleep: Callable[[float], Awaitable[None]] = asyncio.sleep) -> Any:
    for tries in range(retries + 1):
        try:
            return await call()
        except Exception as e:
            if tries == retries or not retryable(e):
                raise
            await sleep(delay(e, tries))


@dataclass(frozen=True)
class Endpoint:
    """A server of the usual chat and pooling interface."""

    base_url: str
    model: str
    api_key: str | None = None
    timeout: float = 600.0

    async def send(self, path: str, payload: Mapping[str, Any]) -> dict:
        return await asyncio.to_thread(self._post, path, payload)

    def _post(self, path: str, payload: Mapping[str, Any]) -> dict:
        headers = {"content-type": "application/json"} | ({"authorization": f"Bearer {self.api_key}"} if self.api_key else {})
        request = urllib.request.Request(f"{self.base_url.rstrip('/')}/{path}", json.dumps(payload).encode(), headers)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as r:
                return json.load(r)
        except urllib.error.HTTPError as e:
            raise RequestError(e.code, e.read().decode("utf-8", "replace"), dict(e.headers)) from e
        except urllib.error.URLError as e:
            raise RequestError(None, str(e.reason)) from e


@dataclass(frozen=True)
class FakeEndpoint:
    """Answers from a function, for tests and dry runs."""

    answer: Callable[[str, Mapping[str, Any]], Mapping[str, Any]]
    model: str = "fake"

    async def send(self, path: str, payload: Mapping[str, Any]) -> dict:
        return dict(self.answer(path, payload))


@dataclass
class _Caller:
    """Makes requests for one callback; in each Python worker it has its own limit."""

    fn: Callable
    provider: Any
    defaults: Mapping[str, Any]
    most: int
    retries: int
    kind: str
    schema: Any = None
    _gate: dict = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_gate": {}}

    async def __call__(self, row: Row) -> Any:
        loop = asyncio.get_running_loop()
        gate = self._gate.setdefault(id(loop), asyncio.Semaphore(self.most))

        async def request(messages: Any = None, raw_payload: Mapping[str, Any] | None = None, **params: Any) -> Any:
            if (messages is None) == (raw_payload is None):
                raise ValueError("give either messages or raw_payload")
            own = {"messages": messages} if raw_payload is None else dict(raw_payload)
            payload = {"model": self.provider.model, **self._asked(), **self.defaults, **own, **params}
            async with gate:
                got = await with_retries(lambda: self.provider.send("chat/completions" if self.kind == "text" else "pooling", payload), self.retries)
            return self._answer(got)

        return await self.fn(row, request)

    def _asked(self) -> dict:
        """The wanted structure of the answer, for servers that hold to it; a mapping is a JSON schema itself."""
        if self.schema is None:
            return {}
        is_model = hasattr(self.schema, "model_json_schema")
        if not is_model and not isinstance(self.schema, Mapping):
            return {"response_format": {"type": "json_object"}}
        name, schema = (self.schema.__name__, self.schema.model_json_schema()) if is_model else (self.schema.get("title", "answer"), dict(self.schema))
        return {"response_format": {"type": "json_schema", "json_schema": {"name": name, "schema": schema, "strict": True}}}

    def _answer(self, got: Mapping[str, Any]) -> Any:
        if self.kind == "pooling":
            return got["data"]
        choice = got["choices"][0]
        text = choice["message"]["content"]
        if self.schema is None:
            return text
        try:
            return self.schema.model_validate_json(text) if hasattr(self.schema, "model_validate_json") else json.loads(text)
        except ValueError as e:
            raise OutputError(str(e)) from e


def generate_text(fn: Callable, provider: Any, default_generation_params: Mapping[str, Any] | None = None, max_concurrent_requests: int = 256, retries: int = 2, output_schema: Any = None) -> Callable[[Row], Awaitable[Any]]:
    """A callback for ``map_async``: ``fn(row, request)`` asks by ``await request(messages=...)``.

    Parameters of a call win over those of the payload, and those over the defaults.
    """
    if max_concurrent_requests < 1:
        raise ValueError("one request at least")
    return _Caller(fn, provider, default_generation_params or {}, max_concurrent_requests, retries, "text", output_schema)


def generate_pooling(fn: Callable, provider: Any, max_concurrent_requests: int = 256, retries: int = 2) -> Callable[[Row], Awaitable[Any]]:
    return _Caller(fn, provider, {}, max_concurrent_requests, retries, "pooling")


def service_name(config: Mapping[str, Any]) -> str:
    """A stable name of a served model, from its configuration."""
    return "vllm-" + hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:12]


def reward_score(provider: Any, images: Callable[[Row], list], task: Callable[[Row], str], output: str = "reward") -> Callable[[Row], Awaitable[Any]]:
    """A callback that adds the progress and the success of a pooling model's logits to a row."""
    import math

    async def score(row: Row, request: Callable) -> dict:
        data = await request(raw_payload={"images": images(row), "task": task(row)})
        logits = data[0]["data"] if isinstance(data, list) and data and isinstance(data[0], Mapping) else data
        if len(logits) < 13:
            raise OutputError("13 logits at least")
        top = max(logits[:10])
        weights = [math.exp(x - top) for x in logits[:10]]
        return {f"{output}_progress": sum(w * i / 9 for i, w in enumerate(weights)) / sum(weights), f"{output}_success": 1 / (1 + math.exp(-logits[10]))}

    return generate_pooling(score, provider)


def subtask_annotation(provider: Any, prompt: Callable[[Row], list], output: str = "segments", when_blocked: str = "empty") -> Callable[[Row], Awaitable[Any]]:
    """A callback that asks for segments as JSON and adds them as an array of (start, end, label); see ``media.normalize_segments``."""

    async def annotate(row: Row, request: Callable) -> dict:
        try:
            text = await request(messages=prompt(row))
            found = json.loads(text)
        except RequestError as e:
            if when_blocked == "empty" and e.status == 400:
                return {output: []}
            raise
        return {output: [{"start": float(s["start"]), "end": float(s["end"]), "label": s.get("label")} for s in found]}

    return generate_text(annotate, provider)


def subtask_labeling(provider: Any, prompt: Callable[[Row, Any, Any, Any], list], segments: str = "segments", output: str = "labeled_segments", when_blocked: str = "seed") -> Callable[[Row], Awaitable[Any]]:
    """A callback that labels given segments anew, one request each, into ``output``; their times stay.

    ``prompt`` gets the row, the segment before, the segment and the one after, None at the ends. New labels are
    in lower case with single spaces. A segment keeps its own label where the new one is empty, and
    where the server refuses the request, unless ``when_blocked`` is "raise".
    """
    if when_blocked not in ("seed", "raise"):
        raise ValueError(when_blocked)
    schema = {"title": "Label", "type": "object", "properties": {"label": {"type": "string"}}, "required": ["label"], "additionalProperties": False}

    async def relabel(row: Row, request: Callable) -> dict:
        given = list(row[segments] or [])

        async def one(i: int) -> dict:
            around = [None, *given, None]
            try:
                label = " ".join(str((await request(messages=prompt(row, *around[i : i + 3])))["label"] or "").lower().split())
            except RequestError as e:
                if when_blocked == "raise" or e.status != 400:
                    raise
                label = ""
            return {**_plain(given[i]), "label": label or _plain(given[i]).get("label")}

        return {output: [await one(i) for i in range(len(given))]}

    return generate_text(relabel, provider, output_schema=schema)


def _plain(segment: Any) -> dict:
    return segment.asDict() if hasattr(segment, "asDict") else dict(segment)


def track_hands(model: Callable[[list[Row]], list[dict]], output: str = "hands") -> Callable[[list[Row]], list[Row]]:
    """A callback for ``batch_map``: one result of ``model`` for each row."""

    def run(rows: list[Row]) -> list[Row]:
        got = model(rows)
        if len(got) != len(rows):
            raise ValueError(f"{len(got)} results for {len(rows)} rows")
        return [r.update({output: g}) for r, g in zip(rows, got, strict=True)]

    return run
