"""Which tables and columns a transform acts on; regular expressions are tried once, at plan time."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from millrace.schema import TableId


@dataclass(frozen=True)
class Selector:
    """Unanchored expressions; what is excluded stays out, and no inclusions means all."""

    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        for pattern in (*self.include, *self.exclude):
            re.compile(pattern)

    def matches(self, name: str) -> bool:
        if any(re.search(p, name) for p in self.exclude):
            return False
        return not self.include or any(re.search(p, name) for p in self.include)

    def columns(self, names: list[str]) -> list[str]:
        return [n for n in names if self.matches(n)]

    def table(self, table: TableId) -> bool:
        """A table is matched by its plain or its quoted name."""
        if any(re.search(p, v) for p in self.exclude for v in table.variants()):
            return False
        return not self.include or any(re.search(p, v) for p in self.include for v in table.variants())
