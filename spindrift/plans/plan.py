"""Positional plans: scans and equi-joins over numbered inputs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import TYPES
from . import deal
from .stats import counts, is_plain


@dataclass(frozen=True)
class Scan:
    """Columns of an input by position: (position, type name)."""

    table: int
    outputs: tuple[tuple[int, str], ...]


@dataclass(frozen=True)
class Join:
    """left[left_key] = right[right_key], and so for each pair of `more`; outputs index left's columns, then right's.
    build_left is a hint that Catalyst replaces by sizes."""

    left: Scan | Join
    right: Scan | Join
    left_key: int
    right_key: int
    outputs: tuple[tuple[int, str], ...]
    build_left: bool = True
    more: tuple[tuple[int, int], ...] = ()


@dataclass
class _Built:
    """What a node gives: rows, estimated (none: unknown) and of its one input, and the input and column of each output."""

    df: DataFrame
    rows: float | None
    table_rows: float
    of: list[tuple[int, str]]

    @property
    def bytes(self) -> float:
        return self.table_rows * deal.width(self.df)


def execute(node: Scan | Join, inputs: list[DataFrame]) -> DataFrame:
    """The plan's rows as c0, c1 ... in bag semantics; null keys match nothing. The tree only states the query."""
    return _built(node, inputs).df


def _built(node: Scan | Join, inputs: list[DataFrame]) -> _Built:
    if isinstance(node, Scan):
        df = inputs[node.table]
        rows = counts([df])[0] if is_plain(df) else None
        out = df.select(*(F.col(f"`{df.columns[i]}`").cast(TYPES[t]).alias(f"c{k}") for k, (i, t) in enumerate(node.outputs)))
        return _Built(out, rows, float("inf") if rows is None else rows, [(node.table, df.columns[i]) for i, _ in node.outputs])
    a, b = _built(node.left, inputs), _built(node.right, inputs)
    pairs = ((node.left_key, node.right_key), *node.more)
    on = [f"k{i}" for i in range(len(pairs))]
    left, right = (x.df.toDF(*(f"{side}{i}" for i in range(len(x.of)))) for side, x in (("l", a), ("r", b)))
    left = left.select("*", *(F.col(f"l{i}").alias(k) for k, (i, _) in zip(on, pairs, strict=True)))
    right = right.select("*", *(F.col(f"r{j}").alias(k) for k, (_, j) in zip(on, pairs, strict=True)))
    made = None
    if a.rows is not None and b.rows is not None:
        made = max(a.rows, b.rows)
        if a.rows * b.rows >= deal.MANY_ROWS:
            # Only keys of one table on each side: what several keep together isn't known.
            (x, _), (y, _) = a.of[pairs[0][0]], b.of[pairs[0][1]]
            names = [(a.of[i][1], b.of[j][1]) for i, j in pairs if a.of[i][0] == x and b.of[j][0] == y]
            made = a.rows * b.rows * deal.selectivity(inputs[x], counts([inputs[x]])[0], inputs[y], counts([inputs[y]])[0], names)
    both = deal.joined(left, right, on, (a.rows or 0.0, b.rows or 0.0), made or 0.0, (a.bytes, b.bytes))
    names = [f"l{i}" for i in range(len(a.of))] + [f"r{i}" for i in range(len(b.of))]
    out = both.select(*(F.col(names[i]).cast(TYPES[t]).alias(f"c{k}") for k, (i, t) in enumerate(node.outputs)))
    return _Built(out, made, float("inf"), [(a.of + b.of)[i] for i, _ in node.outputs])


def drawn(node: Scan | Join, names: list[str] | None = None, depth: int = 0) -> str:
    """The tree, a line for each node, children indented. names: of the inputs."""
    pad = "  " * depth
    if isinstance(node, Scan):
        return f"{pad}scan {names[node.table] if names else node.table} {[i for i, _ in node.outputs]}"
    on = ", ".join(f"left {a} = right {b}" for a, b in ((node.left_key, node.right_key), *node.more))
    below = "\n".join(drawn(x, names, depth + 1) for x in (node.left, node.right))
    return f"{pad}join {on} (build {'left' if node.build_left else 'right'}) {[i for i, _ in node.outputs]}\n{below}"
