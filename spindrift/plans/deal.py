"""Joins that make far more rows than they read, dealt to tasks by rows. Catalyst deals rows by key and merges small
partitions, so few keys would leave all the work to a few tasks, however many rows they make.

Nothing here changes a result: a bounded side is broadcast to shares of the other one, or rows of one side get a share by
their hash and the other side a copy for each share.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import kept_rows

#: Joins that make so many rows, and so many times what they read, are dealt; a task makes about TASK_ROWS.
MANY_ROWS, GAIN, TASK_ROWS, TASKS = 20_000_000, 4, 8_000_000, 10_000
#: Pairs of sampled rows that tell how often keys meet; with fewer, a key is taken to meet its references.
PAIRS = 20
#: Broadcast up to so many bytes.
BROADCAST = 16 << 20
SHARE = "_share"


def width(df: DataFrame) -> float:
    return float(sum(f.dataType.jsonValue() in ("integer", "float", "date") and 4 or f.dataType.jsonValue() == "string" and 20 or 8 for f in df.schema) + 8)


def selectivity(a: DataFrame, a_rows: float, b: DataFrame, b_rows: float, on: list[tuple[str, str]]) -> float:
    """The part of all pairs of rows of two tables that agree on these columns, from the rows kept of each."""
    x, y = ([tuple(r[c] for c in names) for r in kept_rows(t, n)] for t, n, names in ((a, a_rows, [k for k, _ in on]), (b, b_rows, [k for _, k in on])))
    known = Counter(k for k in y if None not in k)
    pairs = sum(known[k] for k in x if None not in k)
    if kept_rows(a, a_rows) is kept_rows(b, b_rows):  # a row meets itself in one pair of all, not of the sample
        pairs -= sum(k == m for k, m in zip(x, y, strict=True) if None not in k)
    return pairs / (len(x) * len(y)) if pairs >= PAIRS else 1 / max(a_rows, b_rows, 1.0)


def joined(left: DataFrame, right: DataFrame, on: list[str], rows: tuple[float, float], made: float, bytes_: tuple[float, float], light: int | None = None) -> DataFrame:
    """Equi-join on columns of both (a cross product without any). rows: estimated, of left, right and the result;
    bytes_: at most, of left and right; light: the side (0 or 1) to broadcast if the join isn't dealt."""
    if made < MANY_ROWS or made < GAIN * sum(rows):
        left, right = (F.broadcast(df) if light == x else df for x, df in enumerate((left, right)))
        return left.join(right, on) if on else left.crossJoin(right)
    n = min(TASKS, math.ceil(made / TASK_ROWS))
    if min(bytes_) <= BROADCAST:
        # Rows of a key follow one another, so do their partners: that compresses well.
        part = lambda df: df.repartition(n).sortWithinPartitions(*on) if on else df.repartition(n)
        left, right = (F.broadcast(left), part(right)) if bytes_[0] < bytes_[1] else (part(left), F.broadcast(right))
        return left.join(right, on) if on else left.crossJoin(right)
    share = F.pmod(F.xxhash64(*(left if rows[0] >= rows[1] else right).columns), F.lit(n)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left, right = (left.withColumn(SHARE, share), right.withColumn(SHARE, copies)) if rows[0] >= rows[1] else (left.withColumn(SHARE, copies), right.withColumn(SHARE, share))
    left, right = (df.repartition(n, *on, SHARE) for df in (left, right))
    return left.join(right, [*on, SHARE]).drop(SHARE)
