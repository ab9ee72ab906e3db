"""Per-account settings: accounts.<id>.ignore_contacts and ignore_tags of a TOML file."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path


@dataclass
class Settings:
    ignore_contacts: list[str] = field(default_factory=list)
    ignore_tags: list[str] = field(default_factory=list)

    @classmethod
    def load(cls, path: str, account: str) -> Settings:
        """Values trimmed, blank ones left out; a missing file or account has none."""
        if not Path(path).is_file():
            return cls()
        own = tomllib.loads(Path(path).read_text(encoding="utf-8")).get("accounts", {}).get(account, {})
        clean = lambda k: [x.strip() for x in own.get(k, []) if x.strip()]
        return cls(clean("ignore_contacts"), clean("ignore_tags"))
