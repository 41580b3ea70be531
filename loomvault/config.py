"""Settings of a vault, from arguments or from the environment."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path


class ConfigError(ValueError):
    """A setting that is missing or has no meaning."""


@dataclass(frozen=True)
class Settings:
    """Where a vault is and where its index is kept. storage: `local`, or `uri` for any store that Spark reads."""

    path: str
    storage: str = "local"
    index: str | None = None

    def __post_init__(self):
        if self.storage not in ("local", "uri"):
            raise ConfigError(f"no storage is called {self.storage!r}")
        if not self.path:
            raise ConfigError("a vault needs a path")

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ) -> Settings:
        """STORAGE__PATH, and STORAGE__TYPE and INDEX__PATH where they are set."""
        if not env.get("STORAGE__PATH"):
            raise ConfigError("STORAGE__PATH is not set")
        return cls(env["STORAGE__PATH"], env.get("STORAGE__TYPE", "local"), env.get("INDEX__PATH"))

    @property
    def name(self) -> str:
        return self.path.rstrip("/").rsplit("/", 1)[-1]

    def index_path(self) -> str:
        """The index's folder: as set, or one for this vault alone. A vault in a store has no default, since a machine's own folder would not be shared."""
        if self.index:
            return self.index
        if self.storage != "local":
            raise ConfigError("the index of a vault in a store needs a path")
        base = os.environ.get("XDG_DATA_HOME") or str(Path.home() / ".local" / "share")
        return f"{base}/loomvault/{hashlib.sha256(os.path.realpath(self.path).encode()).hexdigest()[:16]}"
