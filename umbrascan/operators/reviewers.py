"""Reviewers: who gives the second opinion. A reviewer turns a prompt into the model's raw text or raises Unavailable.

`choose` reads the settings once and says which reviewer they name, or why there is none.
"""

from __future__ import annotations

import http.client
import json
import urllib.error
import urllib.request
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any, Protocol

#: Settings, words that switch the review off, the messages of a missing reviewer, and how much of an error is kept.
PROVIDER, URL, MODEL, KEY, VERSION = "LLM_PROVIDER", "LLM_URL", "LLM_MODEL", "LLM_KEY", "LLM_VERSION"
#: Fixed value: the header by which the public messages interface is told its version.
VERSION_HEADER = "anthropic-version"
SWITCHED_OFF = frozenset({"none", "off", "disabled", "false", "0"})
DISABLED, UNCONFIGURED = "AI review disabled (LLM_PROVIDER=none)", "AI review not configured for LLM_PROVIDER={}"
ERROR_LENGTH = 200


class Unavailable(Exception):
    """The model gave no usable text."""


class Reviewer(Protocol):
    name: str
    retries: int
    wrapped: bool

    def answer(self, system: str, body: str, ids: list[str]) -> str:
        """The model's raw text."""
        ...


@dataclass
class FixedReviewer:
    """Labels every snippet alike; for tests and benchmarks."""

    label: str = "suspicious"
    reason: str = "mock"
    name: str = "mock"
    retries: int = 0
    wrapped: bool = False

    def answer(self, system: str, body: str, ids: list[str]) -> str:
        return json.dumps([{"id": i, "label": self.label, "reason": self.reason} for i in ids])


@dataclass(frozen=True)
class Call:
    """One HTTP exchange of JSON texts."""

    url: str
    payload: dict[str, Any]
    headers: tuple[tuple[str, str], ...] = ()

    def result(self, seconds: float) -> dict[str, Any]:
        """The answered object; whatever goes wrong on the way becomes Unavailable with a short text."""
        sent = urllib.request.Request(self.url, method="POST", data=json.dumps(self.payload).encode("utf-8"))
        for name, value in (("Content-Type", "application/json"), *self.headers):
            sent.add_header(name, value)
        try:
            with urllib.request.urlopen(sent, timeout=seconds) as got:
                found = json.load(got)
        except urllib.error.HTTPError as e:
            raise Unavailable(f"HTTP {e.code}: {e.read(ERROR_LENGTH).decode('utf-8', 'replace')}".rstrip(": ")) from e
        except (urllib.error.URLError, http.client.HTTPException, OSError) as e:
            late = isinstance(e, TimeoutError) or isinstance(getattr(e, "reason", None), TimeoutError)
            raise Unavailable(f"no answer within {seconds:g} s" if late else f"not reachable: {e}"[:ERROR_LENGTH]) from e
        except ValueError as e:
            raise Unavailable("the answer is no JSON text") from e
        if not isinstance(found, dict):
            raise Unavailable("the answer is no JSON object")
        return found


@dataclass
class LocalReviewer:
    """A chat model served on this network, which takes a JSON schema for its answer. One retry fills what a first try left out."""

    url: str = "http://localhost:11434"
    model: str = "default"
    seconds: float = 30.0
    retries: int = 1
    wrapped: bool = True

    @property
    def name(self) -> str:
        return f"local:{self.model}"

    def call(self, system: str, body: str, ids: list[str]) -> Call:
        # The interface's names.
        limits = {"temperature": 0, "num_predict": 100 + 150 * len(ids), "repeat_penalty": 1.1}
        chat = [{"role": who, "content": what} for who, what in (("system", system), ("user", body))]
        return Call(f"{self.url.rstrip('/')}/api/chat", {"model": self.model, "stream": False, "format": answer_schema(ids), "options": limits, "messages": chat})

    def answer(self, system: str, body: str, ids: list[str]) -> str:
        match self.call(system, body, ids).result(self.seconds):
            case {"done_reason": str(ended)} if ended != "stop":
                raise Unavailable(f"the answer ended by {ended}")
            case {"message": {"content": str(text)}}:
                return text
        return ""


@dataclass
class HostedReviewer:
    """A hosted chat model behind a messages interface with a key. It is not asked twice: a scan does not wait for it."""

    url: str
    model: str
    key: str
    version: str = "2023-06-01"
    seconds: float = 5.0
    retries: int = 0
    wrapped: bool = False

    @property
    def name(self) -> str:
        return f"hosted:{self.model}"

    def call(self, system: str, body: str, ids: list[str]) -> Call:
        # The interface's names.
        payload = {"model": self.model, "system": system, "messages": [{"role": "user", "content": body}], "temperature": 0, "max_tokens": min(4096, 100 + 120 * len(ids))}
        return Call(f"{self.url.rstrip('/')}/v1/messages", payload, (("x-api-key", self.key), (VERSION_HEADER, self.version)))

    def answer(self, system: str, body: str, ids: list[str]) -> str:
        found = self.call(system, body, ids).result(self.seconds)
        if found.get("stop_reason") not in {"end_turn", "stop_sequence"}:
            raise Unavailable(f"the answer ended by {found.get('stop_reason')}")
        parts = found.get("content")
        return "".join(p["text"] for p in parts if isinstance(p, dict) and p.get("type") == "text") if isinstance(parts, list) else ""


def answer_schema(ids: list[str]) -> dict[str, Any]:
    """The JSON schema of a wrapped answer for these ids."""
    from .review import LABELS, MAX_REASON

    text = {"type": "string"}
    item = {"type": "object", "properties": {"id": text | {"enum": ids}, "label": text | {"enum": list(LABELS)}, "reason": text | {"maxLength": MAX_REASON}}, "required": ["id", "label", "reason"], "additionalProperties": False}
    return {"type": "object", "properties": {"results": {"type": "array", "items": item}}, "required": ["results"], "additionalProperties": False}


Settings = Mapping[str, str]


def local(settings: Settings) -> Reviewer:
    return LocalReviewer(**{k: v for k, v in (("url", settings.get(URL)), ("model", settings.get(MODEL))) if v})


def hosted(settings: Settings) -> Reviewer | None:
    """None unless it is known where, whom and with what key to ask."""
    found = [(settings.get(k) or "").strip() for k in (URL, MODEL, KEY)]
    version = (settings.get(VERSION) or "").strip()
    return HostedReviewer(*found, **({"version": version} if version else {})) if all(found) else None


MAKERS: dict[str, Callable[[Settings], Reviewer | None]] = {"http": local, "hosted": hosted, "mock": lambda settings: FixedReviewer()}


@dataclass(frozen=True)
class Choice:
    """The reviewer that settings name, or why there is none."""

    reviewer: Reviewer | None
    reason: str | None

    def row(self) -> dict[str, Any]:
        return {"enabled": self.reviewer is not None, "provider": self.reviewer.name if self.reviewer else None, "reason": self.reason}


def choose(settings: Settings) -> Choice:
    named = (settings.get(PROVIDER) or "").strip().lower()
    if not named or named in SWITCHED_OFF:
        return Choice(None, DISABLED)
    maker = MAKERS.get(named)
    found = maker(settings) if maker else None
    return Choice(found, None if found else UNCONFIGURED.format(named))
