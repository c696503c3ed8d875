"""Structured scenarios from loose requests; the chat client is injected.

A scenario is a mapping with the keys of ``FIELDS``; each has a kind, and each kind one way to read loose values.
"""

from __future__ import annotations

import copy
import json
from collections.abc import Callable
from typing import Any

from quillon.sources.config import parse, unfenced

Chat = Callable[[list[dict[str, str]]], str]

#: The fields of a scenario, their kinds and what holds where nothing is said.
FIELDS: dict[str, tuple[str, Any]] = {
    "raw": ("text", ""),
    "market": ("text", "generic"),
    "universe": ("names", ["ASSET"]),
    "frequency": ("text", "5min"),
    "horizon": ("whole", 1),
    "target": ("text", "direction"),
    "factor_type": ("text", "single_asset_timing"),
    "fields": ("names", ["open", "high", "low", "close", "volume"]),
    "constraints": ("notes", {}),
    "preferred_signals": ("names", []),
}


def _names(x: Any) -> list[str]:
    """A comma text or a sequence; anything else is one name."""
    many = x.split(",") if isinstance(x, str) else x if isinstance(x, list | tuple) else [x]
    return [y.strip() if isinstance(y, str) else str(y) for y in many if str(y).strip()]


def _whole(x: Any) -> int:
    """A whole number, else 1."""
    text = str(x).strip()
    return int(float(text)) if text.lstrip("+-").replace(".", "", 1).isdigit() else 1


READ: dict[str, Callable[[Any], Any]] = {"text": lambda x: x, "names": _names, "whole": _whole, "notes": lambda x: x if isinstance(x, dict) else {"notes": x}}


def scenario(given: dict[str, Any] | None = None, **more: Any) -> dict[str, Any]:
    """All fields, read from what is given; unknown keys go, absent and null ones take their defaults."""
    said = {k: v for k, v in {**(given or {}), **more}.items() if v is not None}
    return {name: READ[kind](said[name]) if name in said else copy.copy(default) for name, (kind, default) in FIELDS.items()}


def context(s: dict[str, Any]) -> str:
    """A scenario as lines of a prompt."""
    line = lambda v: ", ".join(v) if isinstance(v, list) else json.dumps(v, ensure_ascii=False) if isinstance(v, dict) else str(v)
    return "\n".join(f"{name.replace('_', ' ')}: {line(s[name])}" for name in FIELDS if name != "raw")


def refine(request: str, chat: Chat, system: str = "Answer with YAML only, one key for each field of the scenario.", **overrides: Any) -> dict[str, Any]:
    """One question to the client; its answer, fenced or not, JSON or YAML, becomes a scenario.  The request is kept as raw."""
    answer = unfenced(chat([{"role": "system", "content": system}, {"role": "user", "content": request}]))
    try:
        data = json.loads(answer)
    except ValueError:
        data = parse(answer)
    if not isinstance(data, dict):
        raise ValueError("the answer is not a mapping")
    return scenario({**data, "raw": data.get("raw") or request}, **overrides)
