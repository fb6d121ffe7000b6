"""The predicate language: comparisons of a column with a literal, under AND, OR, NOT, with ANSI null semantics."""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Literal = int | float | str | bool
Columns = Callable[[str], Column]
COMPARE = {"=": operator.eq, "<>": operator.ne, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


class Predicate:
    def column(self, of: Columns = F.col) -> Column:
        raise NotImplementedError

    def holds(self, row: Mapping[str, Literal | None]) -> bool | None:
        """The value for a row on the driver, None for unknown. A literal of another type than its column may raise TypeError."""
        raise NotImplementedError

    def columns(self) -> set[str]:
        return {self.name} if hasattr(self, "name") else set()

    def __and__(self, other: Predicate) -> Predicate:
        return And((self, other))

    def __or__(self, other: Predicate) -> Predicate:
        return Or((self, other))

    def __invert__(self) -> Predicate:
        return Not(self)


def _compared(how: Callable, a: Literal, b: Literal) -> bool:
    if isinstance(a, str) != isinstance(b, str):
        raise TypeError(f"{a!r} and {b!r} can't be compared")
    return how(a, b)


def _quoted(v: Literal) -> str:
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


@dataclass(frozen=True)
class Cmp(Predicate):
    name: str
    op: str
    value: Literal

    def column(self, of: Columns = F.col) -> Column:
        return COMPARE[self.op](of(self.name), F.lit(self.value))

    def holds(self, row: Mapping[str, Literal | None]) -> bool | None:
        v = row[self.name]
        return None if v is None else _compared(COMPARE[self.op], v, self.value)

    def __str__(self) -> str:
        return f"{self.name} {self.op} {_quoted(self.value)}"


@dataclass(frozen=True)
class Like(Predicate):
    """% and _ are wild; no character escapes, so backslashes in the pattern stand for themselves."""

    name: str
    pattern: str
    negated: bool = False

    def column(self, of: Columns = F.col) -> Column:
        found = of(self.name).like(self.pattern.replace("\\", "\\\\"))
        return ~found if self.negated else found

    def holds(self, row: Mapping[str, Literal | None]) -> bool | None:
        v = row[self.name]
        if v is None:
            return None
        wild = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in self.pattern)
        return (re.fullmatch(wild, v, re.DOTALL) is not None) != self.negated

    def __str__(self) -> str:
        return f"{self.name} {'NOT ' * self.negated}LIKE {_quoted(self.pattern)}"


@dataclass(frozen=True)
class Between(Predicate):
    name: str
    low: Literal
    high: Literal

    def column(self, of: Columns = F.col) -> Column:
        return of(self.name).between(self.low, self.high)

    def holds(self, row: Mapping[str, Literal | None]) -> bool | None:
        v = row[self.name]
        return None if v is None else _compared(operator.ge, v, self.low) and _compared(operator.le, v, self.high)

    def __str__(self) -> str:
        return f"{self.name} BETWEEN {_quoted(self.low)} AND {_quoted(self.high)}"


@dataclass(frozen=True)
class In(Predicate):
    name: str
    values: tuple[Literal, ...]

    def column(self, of: Columns = F.col) -> Column:
        return of(self.name).isin(*self.values)

    def holds(self, row: Mapping[str, Literal | None]) -> bool | None:
        v = row[self.name]
        return None if v is None else any(_compared(operator.eq, v, x) for x in self.values)

    def __str__(self) -> str:
        return f"{self.name} IN ({', '.join(map(_quoted, self.values))})"


@dataclass(frozen=True)
class IsNull(Predicate):
    name: str
    negated: bool = False

    def column(self, of: Columns = F.col) -> Column:
        return of(self.name).isNotNull() if self.negated else of(self.name).isNull()

    def holds(self, row: Mapping[str, Literal | None]) -> bool | None:
        return (row[self.name] is None) != self.negated

    def __str__(self) -> str:
        return f"{self.name} IS {'NOT ' * self.negated}NULL"


@dataclass(frozen=True)
class _Many(Predicate):
    parts: tuple[Predicate, ...]
    word = ""

    def columns(self) -> set[str]:
        return set().union(*(p.columns() for p in self.parts))

    def __str__(self) -> str:
        return "(" + f" {self.word} ".join(map(str, self.parts)) + ")"


class And(_Many):
    word = "AND"

    def column(self, of: Columns = F.col) -> Column:
        out = F.lit(True)
        for p in self.parts:
            out = out & p.column(of)
        return out

    def holds(self, row: Mapping[str, Literal | None]) -> bool | None:
        found = [p.holds(row) for p in self.parts]
        return False if False in found else None if None in found else True


class Or(_Many):
    word = "OR"

    def column(self, of: Columns = F.col) -> Column:
        out = F.lit(False)
        for p in self.parts:
            out = out | p.column(of)
        return out

    def holds(self, row: Mapping[str, Literal | None]) -> bool | None:
        found = [p.holds(row) for p in self.parts]
        return True if True in found else None if None in found else False


@dataclass(frozen=True)
class Not(Predicate):
    part: Predicate

    def column(self, of: Columns = F.col) -> Column:
        return ~self.part.column(of)

    def holds(self, row: Mapping[str, Literal | None]) -> bool | None:
        found = self.part.holds(row)
        return None if found is None else not found

    def columns(self) -> set[str]:
        return self.part.columns()

    def __str__(self) -> str:
        return f"NOT ({self.part})"
