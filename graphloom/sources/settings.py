"""Settings in layers: registered data sets, a file, environment, command line; later layers win."""

from __future__ import annotations

import json
import os
import tomllib
from pathlib import Path
from typing import Any

from graphloom.sources.readers import expand

#: Data sets by name, each with the settings in which it differs.
REGISTRY: dict[str, dict[str, Any]] = {}


def register(name: str, **settings: Any) -> None:
    REGISTRY[name.lower()] = settings


def scalar(text: str) -> Any:
    """A setting as it is written: true, null, a number, or a text with or without quotes; ${VAR:-default} is filled in."""
    value = expand(text.strip())
    low = value.lower()
    if low in ("true", "false"):
        return low == "true"
    if low in ("null", "none", "~"):
        return None
    try:
        return float(value) if any(c in value for c in ".eE") else int(value)
    except ValueError:
        return value.strip('"').strip("'")


def flag(text: str | None, default: bool = False) -> bool:
    return default if not (text or "").strip() else text.strip().lower() in ("1", "true", "yes", "y", "on")


def number(text: str | None, default: float, kind: type = float) -> float:
    try:
        return kind((text or "").strip())
    except ValueError:
        return default


def uncommented(text: str) -> str:
    """A value without the comment behind it; a hash within quotes or inside a word begins none."""
    quote = ""
    for k, c in enumerate(text):
        if c in "'\"":
            quote = "" if c == quote else quote or c
        elif c == "#" and not quote and (k == 0 or text[k - 1].isspace()):
            return text[:k].rstrip()
    return text


def env_file(path: str | Path) -> dict[str, str]:
    """Variables of an environment file."""
    out = {}
    for line in Path(path).read_text(encoding="utf-8-sig").splitlines():
        name, sep, value = line.strip().removeprefix("export ").partition("=")
        if sep and name and not name.startswith("#"):
            out[name.strip()] = uncommented(value.strip()).strip("'\"")
    return out


def read(path: str | Path) -> dict[str, Any]:
    """Settings of a TOML, JSON or flat YAML file (name: value lines, lists in brackets or with dashes)."""
    path = Path(path)
    text = path.read_text(encoding="utf-8-sig")
    if path.suffix == ".toml":
        return tomllib.loads(text)
    if path.suffix == ".json":
        return json.loads(text)
    out: dict[str, Any] = {}
    name = None
    for line in text.splitlines():
        line = uncommented(line).rstrip()
        if not line.strip():
            continue
        if name is not None and line.lstrip().startswith("- "):
            out[name] = [*(out[name] if isinstance(out[name], list) else []), scalar(line.lstrip()[2:])]
            continue
        name, _, value = (x.strip() for x in line.partition(":"))
        out[name] = [scalar(x) for x in value[1:-1].split(",") if x.strip()] if value.startswith("[") and value.endswith("]") else scalar(value) if value else ""
    return out


def load(defaults: dict[str, Any], file: str | Path | None = None, dataset: str | None = None, prefix: str = "GRAPHLOOM_", given: dict[str, Any] | None = None, environment: dict[str, str] | None = None) -> dict[str, Any]:
    """All layers in one: defaults, the data set, the file, variables with the prefix, and what was given (None is not given)."""
    environment = os.environ if environment is None else environment
    from_file = read(file) if file else {}
    name = (given or {}).get("dataset") or dataset or environment.get(f"{prefix}DATASET") or from_file.get("dataset") or defaults.get("dataset")
    if name is not None and name.lower() not in REGISTRY:
        raise ValueError(f"unknown data set {name}: {', '.join(sorted(REGISTRY)) or 'none are registered'}")
    out = {**defaults, **(REGISTRY[name.lower()] if name else {}), **from_file}
    out |= {k[len(prefix) :].lower(): scalar(v) for k, v in environment.items() if k.startswith(prefix)}
    out |= {k: v for k, v in (given or {}).items() if v is not None}
    return out | ({"dataset": name} if name else {})
