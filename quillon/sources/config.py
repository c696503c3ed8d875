"""Small configuration files on the driver: YAML or JSON by suffix."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

try:  # JSON works without it
    import yaml
except ImportError:
    yaml = None


def _kind(path: str | Path) -> str:
    suffix = Path(path).suffix.lower()
    if suffix == ".json":
        return "json"
    if suffix in (".yaml", ".yml"):
        if yaml is None:
            raise ValueError("YAML is not installed")
        return "yaml"
    raise ValueError(f"neither YAML nor JSON: {path}")


def parse(text: str, kind: str = "yaml") -> Any:
    """The document in a text; {} if it is empty."""
    if not text.strip():
        return {}
    if kind == "json" or yaml is None:
        return json.loads(text)
    got = yaml.safe_load(text)
    return {} if got is None else got


def unfenced(answer: str) -> str:
    """The body of the first fenced block of an answer, else the answer."""
    parts = answer.split("```")
    return parts[1].partition("\n")[2] if len(parts) > 2 else answer


def read_config(path: str | Path) -> Any:
    kind = _kind(path)
    return parse(Path(path).read_text(encoding="utf-8"), kind)


def write_config(obj: Any, path: str | Path) -> None:
    """Folders are made, key order is kept, text is not escaped."""
    kind, path = _kind(path), Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    text = json.dumps(obj, ensure_ascii=False, indent=2) if kind == "json" else yaml.safe_dump(obj, sort_keys=False, allow_unicode=True)
    path.write_text(text, encoding="utf-8")
