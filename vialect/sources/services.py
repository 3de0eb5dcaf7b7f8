"""Adapters to outside services, as callables for ``operators.enrich``; each request has a time-out."""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable
from typing import Any

from vialect.settings import DEFAULTS, Settings

# Addresses of the services and the variables that hold their keys.
ENTITIES = "https://www.wikidata.org/wiki/Special:EntityData"
ADDRESSES = {"openai": "https://api.openai.com/v1/chat/completions", "anthropic": "https://api.anthropic.com/v1/messages", "gemini": "https://generativelanguage.googleapis.com/v1beta/models"}
KEYS = {"openai": "OPENAI_API_KEY", "anthropic": "ANTHROPIC_API_KEY", "gemini": "GEMINI_API_KEY"}
AGENT = "vialect"


def _asked(url: str, settings: Settings, headers: dict[str, str] | None = None, body: dict[str, Any] | None = None) -> str:
    data = None if body is None else json.dumps(body).encode()
    request = urllib.request.Request(url, data, {"User-Agent": AGENT, "Content-Type": "application/json", **(headers or {})})  # noqa: S310  fixed addresses
    with urllib.request.urlopen(request, timeout=settings.request_timeout) as reply:  # noqa: S310
        return reply.read().decode()


def entity_source(settings: Settings = DEFAULTS, address: str = ENTITIES) -> Callable[[str], str]:
    """The record of an entity as JSON text."""
    return lambda qid: _asked(f"{address}/{qid}.json", settings)


def model_source(provider: str, model: str, settings: Settings = DEFAULTS, address: str | None = None) -> Callable[[str, str, int], str] | None:
    """A model's reply to (task, message, most tokens) at temperature 0; None where the provider's key isn't set."""
    key = os.environ.get(KEYS[provider])
    if not key:
        return None
    url = address or ADDRESSES[provider]

    def openai(task: str, message: str, most: int) -> str:
        messages = [{"role": "system", "content": task}, {"role": "user", "content": message}]
        found = json.loads(_asked(url, settings, {"Authorization": f"Bearer {key}"}, {"model": model, "messages": messages, "max_tokens": most, "temperature": 0}))
        return found["choices"][0]["message"]["content"]

    def anthropic(task: str, message: str, most: int) -> str:
        body = {"model": model, "system": task, "messages": [{"role": "user", "content": message}], "max_tokens": most, "temperature": 0}
        found = json.loads(_asked(url, settings, {"x-api-key": key, "anthropic-version": "2023-06-01"}, body))
        return found["content"][0]["text"]

    def gemini(task: str, message: str, most: int) -> str:
        body = {"system_instruction": {"parts": [{"text": task}]}, "contents": [{"parts": [{"text": message}]}], "generationConfig": {"maxOutputTokens": most, "temperature": 0}}
        found = json.loads(_asked(f"{url}/{model}:generateContent", settings, {"x-goog-api-key": key}, body))
        return found["candidates"][0]["content"]["parts"][0]["text"]

    return {"openai": openai, "anthropic": anthropic, "gemini": gemini}[provider]
