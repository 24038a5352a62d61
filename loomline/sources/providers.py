"""Models over HTTP."""

from __future__ import annotations

import json
import logging
import time
import urllib.request
from collections.abc import Callable

from loomline.sources.config import Config

WARN_SECONDS = 300
TIMEOUT_SECONDS = 60


class HttpEmbedder:
    """M7: one POST a text, {model, input}, answered by {data: [{embedding}]}; None on any failure.

    A failure of a kind is logged once in WARN_SECONDS. Objects travel to the tasks
    with their settings only.
    """

    def __init__(self, url: str, headers: dict[str, str], model: str) -> None:
        self.url, self.headers, self.model = url, headers, model
        self.warned: dict[str, float] = {}

    def _warn(self, kind: str, what: object) -> None:
        if time.monotonic() - self.warned.get(kind, -WARN_SECONDS) >= WARN_SECONDS:
            self.warned[kind] = time.monotonic()
            logging.warning("embeddings, %s: %s (not told again for %s s)", kind, what, WARN_SECONDS)

    def one(self, text: str) -> list | None:
        body = json.dumps({"model": self.model, "input": text}).encode()
        request = urllib.request.Request(self.url, body, {**self.headers, "Content-Type": "application/json"}, method="POST")
        try:
            with urllib.request.urlopen(request, timeout=TIMEOUT_SECONDS) as response:
                raw = response.read()
        except OSError as e:
            self._warn("request", e)
            return None
        try:
            return json.loads(raw)["data"][0]["embedding"]
        except (ValueError, KeyError, IndexError, TypeError) as e:
            self._warn("answer", repr(e))
            return None

    def __call__(self, texts: list[str]) -> list[list | None]:
        return [self.one(t) for t in texts]


def embedder_of(config: Config) -> Callable | None:
    """The embedder of the settings; None, and so no links to earlier insights, without a URL or a key."""
    if not config.embedding_url or not config.embedding_key:
        return None
    value = f"{config.embedding_auth_scheme} {config.embedding_key}" if config.embedding_auth_scheme else config.embedding_key
    headers = {config.embedding_auth_header: value, **(config.embedding_headers or {})}
    return HttpEmbedder(config.embedding_url.rstrip("/") + config.embedding_path, headers, config.embedding_model)
