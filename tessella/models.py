"""Language models behind plain functions: a chat client that learns which parameters a service takes, judges, wrappers."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from tessella.config import prices

Messages = Sequence[Mapping[str, str]]


@dataclass(frozen=True)
class Usage:
    """What calls have used; sums by +."""

    tokens_in: int = 0
    tokens_out: int = 0
    calls: int = 0
    cost_usd: float = 0.0

    def __add__(self, other: Usage) -> Usage:
        return Usage(*(a + b for a, b in zip(self._values(), other._values())))

    def _values(self) -> tuple:
        return self.tokens_in, self.tokens_out, self.calls, self.cost_usd


@dataclass(frozen=True)
class Reply:
    text: str
    usage: Usage = Usage()
    latency_ms: float = 0.0
    model: str = ""


class Refused(Exception):
    """A service's refusal of a request; message names what it does not take."""


#: What is asked instead of a parameter that is refused.
INSTEAD = {"max_completion_tokens": "max_tokens"}


@dataclass
class Chat:
    """send: a request (model, messages, parameters) -> {"text", "tokens_in", "tokens_out"}, or Refused.

    A parameter that a refusal names is left out from then on, or replaced where INSTEAD has another name for it.
    """

    send: Callable[[dict[str, Any]], Mapping[str, Any]]
    model: str
    parameters: dict[str, Any] = field(default_factory=dict)
    refused: set[str] = field(default_factory=set)
    pieces: Callable[[dict[str, Any]], Iterator[Mapping[str, Any]]] | None = None

    def _request(self, messages: Messages, more: Mapping[str, Any]) -> dict[str, Any]:
        out = {}
        for name, value in {**self.parameters, **more}.items():
            while name in self.refused and name in INSTEAD:
                name = INSTEAD[name]
            if name not in self.refused and value is not None:
                out[name] = value
        return {"model": self.model, "messages": list(messages), **out}

    def _tried(self, run: Callable[[dict[str, Any]], Any], messages: Messages, more: Mapping[str, Any]) -> Any:
        while True:
            request = self._request(messages, more)
            try:
                return run(request)
            except Refused as no:
                named = {n for n in request if n not in ("model", "messages") and re.search(rf"\b{re.escape(n)}\b", str(no))}
                if not named:
                    raise
                self.refused |= named

    def _used(self, raw: Mapping[str, Any]) -> Usage:
        a, b = int(raw.get("tokens_in") or 0), int(raw.get("tokens_out") or 0)
        rate = prices().get(self.model, (0.0, 0.0))
        return Usage(a, b, 1, (a * rate[0] + b * rate[1]) / 1_000_000)

    def complete(self, messages: Messages, **more: Any) -> Reply:
        start = time.perf_counter()
        raw = self._tried(self.send, messages, more)
        return Reply((raw.get("text") or "").strip(), self._used(raw), 1000 * (time.perf_counter() - start), self.model)

    def stream(self, messages: Messages, **more: Any) -> Iterator[str | Reply]:
        """Pieces of text, then the whole reply. Without a streaming service the reply comes in one piece."""
        if self.pieces is None:
            reply = self.complete(messages, **more)
            if reply.text:
                yield reply.text
            yield reply
            return
        start, text, last = time.perf_counter(), "", {}
        for part in self._tried(self.pieces, messages, more):
            last = {**last, **{k: v for k, v in part.items() if k != "text" and v is not None}}
            if part.get("text"):
                text += part["text"]
                yield part["text"]
        yield Reply(text.strip(), self._used(last), 1000 * (time.perf_counter() - start), self.model)


@dataclass
class AtTemperature:
    """Another model, asked at one temperature."""

    inner: Any
    temperature: float

    def complete(self, messages: Messages, **more: Any) -> Reply:
        return self.inner.complete(messages, **{**more, "temperature": self.temperature})


def first_object(said: str) -> dict | None:
    """The JSON object in noisy text; None where there is none."""
    m = re.search(r"\{.*\}", said, re.DOTALL)
    try:
        found = json.loads(m[0]) if m else None
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


@dataclass
class Judge:
    """A model's view of answers: correct (None where it can't be told) and faithful (share of claims that the sources support)."""

    model: Any

    def correct(self, question: str, answer: str, golds: Sequence[str], answerable: bool = True) -> float | None:
        if not answerable:
            return None
        ask = f'Question: {question}\nAccepted answers: {"; ".join(golds)}\nAnswer: {answer}\nReply with JSON: {{"correct": true or false}}'
        got = first_object(self.model.complete([{"role": "user", "content": ask}]).text)
        return float(got["correct"]) if got and isinstance(got.get("correct"), bool) else None

    def faithful(self, answer: str, sources: Sequence[str]) -> float | None:
        ask = "Sources:\n" + "\n\n".join(sources) + f'\n\nAnswer: {answer}\nReply with JSON: {{"supported": claims the sources support, "total": all claims}}'
        got = first_object(self.model.complete([{"role": "user", "content": ask}]).text)
        try:
            total = float(got["total"])
            return min(1.0, float(got["supported"]) / total) if total > 0 else None
        except (TypeError, KeyError, ValueError):
            return None


def chat_for(key: str, base_url: str, model: str, send: Callable | None, **parameters: Any) -> Chat | None:
    """A client if there is a key or a place to ask, else none."""
    return Chat(send, model, parameters) if (key or base_url) and send is not None else None
