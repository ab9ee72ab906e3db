"""Result pages: a DataFrame of items with paging and statistics beside it."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from talkweave.schema import DEFAULT_LIMIT, MAX_LIMIT


def effective_limit(limit: int) -> int:
    """0 is the default; nothing is above the maximum."""
    return min(limit or DEFAULT_LIMIT, MAX_LIMIT)


@dataclass
class Page:
    """items: at most MAX_LIMIT rows in order. total: rows before paging; scanned: rows looked at; skipped: damaged rows."""

    items: DataFrame
    limit: int
    offset: int = 0
    total: int | None = None
    scanned: int | None = None
    skipped: int = 0
    warnings: list[str] = field(default_factory=list)

    def to_dict(self) -> dict:
        """The JSON envelope; null fields of items and empty warnings are left out."""
        items = [json.loads(x) for x in self.items.toJSON().collect()]
        total = self.total if self.total is not None else self.offset + len(items)
        paging = {"limit": self.limit, "offset": self.offset, "total": total, "returned": len(items), "has_more": self.offset + len(items) < total}
        stats = {"scanned": self.scanned if self.scanned is not None else total, "skipped": self.skipped}
        return {"items": items, "paging": paging, "stats": stats | ({"warnings": self.warnings} if self.warnings else {})}

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), ensure_ascii=False)
