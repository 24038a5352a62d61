"""Settings: defaults, then the environment, then overrides; what is not valid leaves the value before it."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Config:
    idle_gap_minutes: int = 25
    recurrence_threshold: float = 0.90
    dedupe_threshold: float = 0.95
    history_days: int = 7
    timezone: str = "UTC"
    embedding_url: str | None = None
    embedding_path: str = "/v1/embeddings"
    embedding_headers: Mapping[str, str] | None = None
    embedding_key: str | None = None
    embedding_model: str = "text-embedding"
    embedding_auth_header: str = "Authorization"
    embedding_auth_scheme: str = "Bearer"
    model_version: str = ""
    extract_calls: int = 5
    score_calls: int = 3
    engagement_calls: int = 5
    embedding_calls: int = 5


def _positive(text: str) -> int | None:
    return int(text) if text.strip().isdigit() and int(text) > 0 else None


def _share(text: str) -> float | None:
    try:
        x = float(text)
    except ValueError:
        return None
    return x if 0 < x <= 1 else None


def _headers(text: str) -> dict[str, str] | None:
    try:
        found = json.loads(text)
    except ValueError:
        return None
    return found if isinstance(found, dict) and all(isinstance(v, str) for v in found.values()) else None


_READERS: dict[str, Callable[[str], object]] = {
    "idle_gap_minutes": _positive,
    "recurrence_threshold": _share,
    "dedupe_threshold": _share,
    "history_days": _positive,
    "timezone": lambda t: t or None,
    "embedding_url": lambda t: t or None,
    "embedding_path": lambda t: t if t.startswith("/") else None,
    "embedding_headers": _headers,
    "embedding_key": lambda t: t or None,
    "embedding_model": lambda t: t or None,
    "embedding_auth_header": lambda t: t or None,
    "embedding_auth_scheme": lambda t: t,
    "model_version": lambda t: t,
    "extract_calls": _positive,
    "score_calls": _positive,
    "engagement_calls": _positive,
    "embedding_calls": _positive,
}


def load_config(environment: Mapping[str, str] | None = None, prefix: str = "LOOMLINE_", **overrides: object) -> Config:
    """S11."""
    environment = os.environ if environment is None else environment
    config = Config()
    for f in fields(Config):
        text = environment.get(prefix + f.name.upper())
        value = _READERS[f.name](text) if text is not None else None
        if value is not None:
            config = replace(config, **{f.name: value})
    return replace(config, **{k: v for k, v in overrides.items() if v is not None})
