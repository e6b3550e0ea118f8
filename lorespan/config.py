"""Engine settings: defaults, then a TOML file, then environment variables with ``__`` for nesting, then clamped."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields, replace
from typing import ClassVar


@dataclass(frozen=True)
class Settings:
    budget: int = 8000
    degree_cap: int = 50
    node_budget: int = 100
    retention_days: int = 30
    shuffle_partitions: int = 200
    block_docs: int = 512
    scope_aliases: dict[str, tuple[str, ...]] = field(default_factory=dict)
    blocklist: tuple[str, ...] = ()

    #: The range each setting is held to.
    RANGES: ClassVar[dict[str, tuple[int, int]]] = {"budget": (1000, 100_000), "degree_cap": (5, 500), "node_budget": (10, 10_000), "retention_days": (1, 365), "block_docs": (1, 65_536)}

    def clamped(self) -> Settings:
        return replace(self, **{k: min(max(getattr(self, k), low), high) for k, (low, high) in self.RANGES.items()})


def load(path: str | None = None, environ: dict[str, str] | None = None, prefix: str = "LORESPAN") -> Settings:
    found: dict = {}
    if path and os.path.exists(path):
        with open(path, "rb") as f:
            found |= tomllib.load(f)
    for key, value in (os.environ if environ is None else environ).items():
        head, _, name = key.partition("__")
        if head == prefix and name:
            found[name.lower()] = value
    kinds = {f.name: f.type for f in fields(Settings)}
    known = {k: int(v) if kinds.get(k) == "int" else v for k, v in found.items() if k in kinds}
    if "scope_aliases" in known:
        known["scope_aliases"] = {k: (v,) if isinstance(v, str) else tuple(v) for k, v in known["scope_aliases"].items()}
    return Settings(**known).clamped()
