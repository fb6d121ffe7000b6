"""What the planner learns of relations, and keeps for the session: row counts from file footers, small samples of a few
files, and the rows of filtered small tables. Nothing here reads a large table whole.

Facts are kept by table (a DataFrame of its own, which is a new one when files have changed) and by the predicates put on
it, so a query that is planned again starts no job.
"""

from __future__ import annotations

import functools
import itertools
import random
import weakref
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import Predicate

SAMPLE, FEW = 64, 32
#: Rows kept of a table to estimate predicates from, and the files they come from at most.
KEPT_ROWS, KEPT_FILES = 512, 4
#: Facts kept at once; the oldest go first.
KEPT_FACTS = 10_000
_FACTS: dict[tuple, object] = {}


_NUMBERS: weakref.WeakKeyDictionary[DataFrame, int] = weakref.WeakKeyDictionary()
_NEXT = itertools.count()


def key_of(df: DataFrame) -> tuple:
    """A number of df's own. tables.read_parquet() gives the same DataFrame as long as a table's files are the same, so
    facts are found again; nothing that only looks alike shares them."""
    if df not in _NUMBERS:
        _NUMBERS[df] = next(_NEXT)
    return (_NUMBERS[df],)


def fact(key: tuple, find: Callable[[], object]) -> object:
    if key not in _FACTS:
        while len(_FACTS) >= KEPT_FACTS:
            _FACTS.pop(next(iter(_FACTS)))
        _FACTS[key] = find()
    return _FACTS[key]


def forget() -> None:
    _FACTS.clear()


def is_plain(df: DataFrame) -> bool:
    """Whether df is columns of a file table, with all rows."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() == "Project":
        node = node.children().head()
    return node.nodeName() == "LogicalRelation"


def sample(df: DataFrame, n: int = SAMPLE, seed: int = 7) -> list:
    """n rows drawn uniformly with replacement, in the table's order (none of an empty table).

    Rows are numbered by file and place in it (footers tell how many a file has), so only files with a drawn row are
    read; what isn't a plain table is numbered by partition and read once.
    """
    draw = random.Random(seed)
    plain = is_plain(df)
    block = F.col("_metadata.file_path") if plain else F.spark_partition_id()
    per = sorted(tuple(r) for r in df.groupBy(block).count().collect())
    total = sum(c for _, c in per)
    picks = [(per[i][0], k) for i, k in _places([c for _, c in per], sorted(draw.randrange(total) for _ in range(n)))] if total else []
    if not picks:
        return []
    if plain:
        some = df.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("_place"))
        some = some.where(F.col("_place.file").isin(sorted({f for f, _ in picks})) & F.col("_place.row").isin(sorted({k for _, k in picks})))
        found, places = {tuple(r["_place"]): r for r in some.collect()}, picks
    else:
        places = [(i << 33) + k for i, k in picks]
        some = df.withColumn("_place", F.monotonically_increasing_id())
        found = {r["_place"]: r for r in some.where(F.col("_place").isin(places)).collect()}
    return [tuple(found[p])[:-1] for p in places]


def _places(counts: list[int], ordinals: list[int]) -> list[tuple[int, int]]:
    """(which, how far in it) of ascending ordinals over consecutive blocks of these sizes."""
    out, i, before = [], 0, 0
    for o in ordinals:
        while o - before >= counts[i]:
            before += counts[i]
            i += 1
        out.append((i, o - before))
    return out


def counts(tables: Iterable[DataFrame]) -> list[float]:
    """Rows of each table: footers only, in one job for all that aren't known yet."""
    tables = list(tables)
    keys = [("rows", *key_of(t)) for t in tables]
    new = {k: t for k, t in zip(keys, tables, strict=True) if k not in _FACTS}
    if new:
        parts = [t.select(F.lit(i).alias("i")) for i, t in enumerate(new.values())]
        got = dict(tuple(r) for r in functools.reduce(DataFrame.unionAll, parts).groupBy("i").count().collect())
        for i, k in enumerate(new):
            fact(k, lambda n=got.get(i, 0): float(n))
    return [_FACTS[k] for k in keys]


def kept_rows(table: DataFrame, rows: float, seed: int = 7) -> list[dict]:
    """About KEPT_ROWS rows of a few files, to estimate predicates from; all rows of a table that has no more."""

    def find() -> list[dict]:
        files = sorted(table.inputFiles())
        some, share = table, 1.0
        if len(files) > KEPT_FILES:
            some = table.where(F.col("_metadata.file_path").isin(random.Random(seed).sample(files, KEPT_FILES)))
            share = KEPT_FILES / len(files)
        if rows <= KEPT_ROWS:
            return [r.asDict() for r in table.collect()]
        return [r.asDict() for r in some.sample(fraction=min(1.0, 2.0 * KEPT_ROWS / max(rows * share, 1)), seed=seed).limit(KEPT_ROWS).collect()]

    return fact(("kept", *key_of(table)), find)


def estimate(table: DataFrame, rows: float, predicates: list[Predicate], same: list[tuple[str, str]]) -> float:
    """Rows that the predicates (and equalities of columns) keep: from the kept rows; no match counts as half a row of them."""
    if not predicates and not same or not rows:
        return rows
    kept = kept_rows(table, rows)
    try:
        hits = sum(all(p.holds(r) for p in predicates) and all(r[a] is not None and r[a] == r[b] for a, b in same) for r in kept)
    except TypeError:  # a literal of another type than its column: Spark casts, Python doesn't
        return rows / 10
    return rows * max(hits, 0.5) / max(len(kept), 1)


def matching(table: DataFrame, rows: float, predicates: list[Predicate], same: list[tuple[str, str]], needed: list[str], names: dict[str, str]) -> list[dict] | None:
    """All rows of a table with at most KEPT_ROWS that the predicates keep and that have the needed columns, as `names`
    (new -> old); None if the driver can't tell."""
    try:
        kept = [r for r in kept_rows(table, rows) if all(p.holds(r) for p in predicates) and all(r[a] is not None and r[a] == r[b] for a, b in same)]
    except TypeError:
        return None
    return [{new: r[old] for new, old in names.items()} for r in kept if all(r[c] is not None for c in needed)]


@dataclass
class Few:
    """All rows of a relation, which are few."""

    rows: list[dict]

    def values(self, column: str) -> list:
        return list(dict.fromkeys(r[column] for r in self.rows))


def few(df: DataFrame, key: tuple, most: int) -> Few | None:
    """The rows of df if there are at most `most`; reads no further than one more. key: what df is."""

    def find() -> Few | None:
        rows = df.limit(most + 1).collect()
        return Few([r.asDict() for r in rows]) if len(rows) <= most else None

    return fact(("few", most, *key), find)


def key_range(df: DataFrame, column: str, key: tuple) -> tuple:
    """The least and the greatest value of a column."""
    return fact(("range", column, *key), lambda: tuple(df.agg(F.min(column), F.max(column)).first()))


def is_unique(df: DataFrame, column: str, key: tuple) -> bool:
    """Whether no value repeats. Shuffles the column (counts are combined before): for relations of bounded size."""
    return fact(("unique", column, *key), lambda: df.where(F.col(column).isNotNull()).groupBy(column).count().where("count > 1").isEmpty())
