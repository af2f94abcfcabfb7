"""Configuration: routes, budgets, synonyms and concepts, with rules across fields."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field
from urllib.parse import urlparse

KINDS = ("channel", "direct_message")


class InvalidConfig(ValueError):
    pass


@dataclass(frozen=True)
class Route:
    alias: str
    kind: str
    name: str
    id: str | None = None
    priority: int = 0
    scopes: tuple[str, ...] = ()
    repositories: tuple[str, ...] = ()


@dataclass(frozen=True)
class Budgets:
    max_characters: int = 24_000
    per_thread_characters: int = 8_000
    max_threads: int = 8
    match_radius: int = 2
    ticket_radius: int = 8
    merge_gap: int = 2


@dataclass(frozen=True)
class Config:
    url: str
    routes: tuple[Route, ...]
    budgets: Budgets = Budgets()
    synonyms: tuple[tuple[str, ...], ...] = ()
    concepts: dict[str, tuple[str, ...]] = field(default_factory=dict)
    freshness_seconds: int = 300
    overlap_seconds: int = 30
    history_days: int = 365

    def fingerprint(self) -> str:
        """Changes when the concept index has to be built again."""
        return hashlib.sha256(json.dumps(self.concepts, sort_keys=True, ensure_ascii=False).encode()).hexdigest()

    def to_dict(self) -> dict:
        return asdict(self)


def server_url(text: str) -> str:
    """The address without a trailing slash; plain HTTP only for the local host."""
    at = urlparse(text.strip())
    if at.scheme not in ("http", "https") or not at.hostname or at.username or at.query or at.fragment:
        raise InvalidConfig(f"not a server address: {text!r}")
    if at.scheme == "http" and at.hostname not in ("localhost", "127.0.0.1", "::1"):
        raise InvalidConfig("HTTPS is needed")
    return text.strip().rstrip("/")


def load(raw: dict) -> Config:
    try:
        routes = tuple(Route(**{k: tuple(v) if isinstance(v, list) else v for k, v in r.items()}) for r in raw["routes"])
        rest = {k: v for k, v in raw.items() if k not in ("url", "routes", "budgets", "synonyms", "concepts")}
        config = Config(server_url(raw["url"]), routes, Budgets(**raw.get("budgets", {})), tuple(map(tuple, raw.get("synonyms", []))), {k: tuple(v) for k, v in raw.get("concepts", {}).items()}, **rest)
    except (KeyError, TypeError) as e:
        raise InvalidConfig(str(e)) from None
    aliases = [r.alias for r in routes]
    if len(set(aliases)) != len(aliases):
        raise InvalidConfig("an alias stands twice")
    for r in routes:
        if r.kind not in KINDS or not r.alias or not r.name:
            raise InvalidConfig(f"not a route: {r}")
    b = config.budgets
    if b.per_thread_characters > b.max_characters or min(asdict(b).values()) < 0:
        raise InvalidConfig("budgets don't fit together")
    return config
