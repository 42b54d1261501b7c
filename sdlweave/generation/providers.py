"""Model providers: the protocol, a scripted one for tests, one HTTP client for chat services, and tool turns."""

from __future__ import annotations

import json
import re
import urllib.request
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any, Protocol

Message = dict[str, str]
MAX_TOOL_TURNS = 10


class LanguageModel(Protocol):
    """``complete`` takes ``role, content`` messages; options that are None keep the provider's default."""

    name: str
    model: str

    def complete(self, messages: list[Message], temperature: float | None = None, max_tokens: int | None = None) -> str: ...


@dataclass
class ScriptedModel:
    """Replies by the first pattern found in the last user message, else ``default``; keeps its calls.

    A list of replies is used up one at a time, the last one staying.
    """

    script: Mapping[str, str | list[str]]
    default: str = ""
    name: str = "scripted"
    model: str = "scripted"
    calls: list[dict[str, Any]] = field(default_factory=list)

    def complete(self, messages: list[Message], temperature: float | None = None, max_tokens: int | None = None) -> str:
        self.calls.append({"messages": messages, "temperature": temperature, "max_tokens": max_tokens})
        last = next((m["content"] for m in reversed(messages) if m["role"] == "user"), "")
        for pattern, reply in self.script.items():
            if re.search(pattern, last, re.I | re.S):
                if isinstance(reply, list):
                    return reply.pop(0) if len(reply) > 1 else reply[0]
                return reply
        return self.default


def merge_messages(messages: Iterable[Message], greeting: str = "Hello", filler: str = "Please continue.") -> tuple[str, list[Message]]:
    """System text, and the turns in alternation: equal neighbours joined, a user turn first, never empty."""
    system = "\n\n".join(m["content"] for m in messages if m["role"] == "system")
    turns: list[Message] = []
    for m in messages:
        if m["role"] == "system":
            continue
        if turns and turns[-1]["role"] == m["role"]:
            turns[-1] = {"role": m["role"], "content": turns[-1]["content"] + "\n\n" + m["content"]}
        else:
            turns.append(dict(m))
    if not turns:
        turns = [{"role": "user", "content": greeting}]
    if turns[0]["role"] != "user":
        turns.insert(0, {"role": "user", "content": filler})
    return system, turns


#: Fixed values of four services: path, default model, and whether the system text is a field of its own.
SERVICES = {
    "ollama": {"url": "http://localhost:11434", "path": "/api/chat", "model": "qwen2.5"},
    "ollama_cloud": {"url": "https://ollama.com", "path": "/api/chat", "model": "qwen2.5"},
    "openai": {"url": "https://api.openai.com", "path": "/v1/chat/completions", "model": "gpt-4o-mini"},
    "anthropic": {"url": "https://api.anthropic.com", "path": "/v1/messages", "model": "claude-3-haiku-20240307"},
}


@dataclass
class HttpModel:
    """Chat over HTTP; ``service`` names the request form. Options of a call win over the provider's."""

    service: str = "ollama"
    model: str = ""
    key: str = ""
    url: str = ""
    temperature: float | None = None
    top_k: int | None = None
    top_p: float | None = None
    max_tokens: int | None = None
    timeout: float = 120

    @property
    def name(self) -> str:
        return self.service

    def request(self, messages: list[Message], temperature: float | None = None, max_tokens: int | None = None) -> tuple[str, dict[str, str], dict[str, Any]]:
        """URL, headers and body; only options that are set occur."""
        s = SERVICES[self.service]
        t = self.temperature if temperature is None else temperature
        n = self.max_tokens if max_tokens is None else max_tokens
        given = lambda **kw: {k: v for k, v in kw.items() if v is not None}
        body: dict[str, Any] = {"model": self.model or s["model"]}
        headers = {"Content-Type": "application/json"}
        if self.service == "anthropic":
            system, turns = merge_messages(messages)
            body |= {"messages": turns, "max_tokens": n or 4096} | ({"system": system} if system else {}) | given(temperature=t, top_k=self.top_k, top_p=self.top_p)
            headers |= {"x-api-key": self.key, "anthropic-version": "2023-06-01"}
        elif self.service == "openai":
            body |= {"messages": messages} | given(temperature=t, top_p=self.top_p, max_tokens=n)
            headers |= {"Authorization": f"Bearer {self.key}"}
        else:
            body |= {"messages": messages, "stream": False, "options": given(temperature=t, top_k=self.top_k, top_p=self.top_p, num_predict=n)}
            headers |= {"Authorization": f"Bearer {self.key}"} if self.key else {}
        return (self.url or s["url"]).rstrip("/") + s["path"], headers, body

    def answer(self, body: dict[str, Any]) -> str:
        if self.service == "anthropic":
            return "".join(b.get("text", "") for b in body.get("content", []) if b.get("type") == "text")
        if self.service == "openai":
            return body["choices"][0]["message"].get("content") or ""
        return body.get("message", {}).get("content") or ""

    def complete(self, messages: list[Message], temperature: float | None = None, max_tokens: int | None = None) -> str:
        url, headers, body = self.request(messages, temperature, max_tokens)
        with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), headers), timeout=self.timeout) as r:
            return self.answer(json.load(r))


def complete_with_tools(ask: Callable[[list[dict]], dict], messages: list[dict], tools: Mapping[str, Callable[..., str]], turns: int = MAX_TOOL_TURNS) -> str:
    """Ask until the answer calls no tool; raises RuntimeError after ``turns`` rounds.

    ``ask`` returns ``{"text": ..., "calls": [{"id", "name", "arguments"}]}``. A failing tool answers with its error.
    """
    talk = list(messages)
    for _ in range(turns):
        got = ask(talk)
        if not got.get("calls"):
            return got.get("text", "")
        talk.append({"role": "assistant", "content": got.get("text", ""), "calls": got["calls"]})
        for c in got["calls"]:
            try:
                said = tools[c["name"]](**(c.get("arguments") or {}))
            except Exception as e:  # noqa: BLE001 - the model is told
                said = f"error: {e}"
            talk.append({"role": "tool", "id": c.get("id"), "content": said})
    raise RuntimeError(f"no answer after {turns} tool turns")
