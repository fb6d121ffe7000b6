"""Select-project-join queries as graphs: relations, filters, join classes, outputs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..functions.predicates import Predicate

Attr = tuple[str, str]  # relation alias, column


class Classes:
    """Attributes that joins force to be equal (union-find)."""

    def __init__(self) -> None:
        self._up: dict[Attr, Attr] = {}

    def find(self, a: Attr) -> Attr:
        self._up.setdefault(a, a)
        while self._up[a] != a:
            self._up[a] = self._up[self._up[a]]
            a = self._up[a]
        return a

    def unite(self, a: Attr, b: Attr) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self._up[max(a, b)] = min(a, b)

    def groups(self) -> list[list[Attr]]:
        out: dict[Attr, list[Attr]] = {}
        for a in sorted(self._up):
            out.setdefault(self.find(a), []).append(a)
        return list(out.values())


@dataclass
class Query:
    """aggregates: (function min, max, sum or count, attribute or None for count(*), name); with them `outputs` is empty."""

    relations: dict[str, DataFrame]
    joins: list[tuple[Attr, Attr]] = field(default_factory=list)
    filters: dict[str, list[Predicate]] = field(default_factory=dict)
    outputs: list[tuple[Attr, str]] = field(default_factory=list)
    aggregates: list[tuple[str, Attr | None, str]] = field(default_factory=list)
    keys: dict[str, set[str]] = field(default_factory=dict)  # declared unique columns of each relation

    def where(self, alias: str, *predicates: Predicate) -> Query:
        self.filters.setdefault(alias, []).extend(predicates)
        return self

    def classes(self) -> list[list[Attr]]:
        c = Classes()
        for a, b in self.joins:
            c.unite(a, b)
        return c.groups()

    def needed(self) -> list[Attr]:
        return list(dict.fromkeys([a for a, _ in self.outputs] + [a for _, a, _ in self.aggregates if a]))

    def duplicate_insensitive(self) -> bool:
        return bool(self.aggregates) and all(f in ("min", "max") for f, _, _ in self.aggregates)
