"""Settings from the environment; each has a default, and values that cannot be read count as absent."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

_TRUE = ("1", "true", "yes", "on")


@dataclass(frozen=True)
class Settings:
    """What can be set by ``AFFINITY_`` variables of the same names.

    Host, port and origins of an HTTP service have no counterpart here: there is none.
    """

    log_level: str = "WARNING"
    log_json: bool = False
    redact: bool = False
    max_upload_mb: int = 64
    max_graph_nodes: int = 6000

    @property
    def max_upload_bytes(self) -> int:
        return self.max_upload_mb * 1024 * 1024

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ) -> Settings:
        found = {}
        for name, default in vars(cls()).items():
            said = env.get(f"AFFINITY_{name.upper()}", "").strip()
            if not said:
                continue
            if isinstance(default, bool):
                found[name] = said.lower() in _TRUE
            elif isinstance(default, int):
                if said.isdigit() and int(said) > 0:
                    found[name] = int(said)
            else:
                found[name] = said.upper()
        return cls(**found)
