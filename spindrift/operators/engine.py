"""Queries to DataFrames: closure, rewrites and join order, decided while the DataFrame is built; Catalyst executes.

Decisions rest on facts that stats.py keeps for the session: counts, small samples, and the rows of filtered small tables.
Only relations whose tables have at most Options.probe_rows rows are asked for more than that.
"""

from __future__ import annotations

import weakref
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, TimestampType

from ..functions.predicates import Cmp, Predicate
from ..plans import deal
from ..plans.graph import Attr, Query
from ..plans.order import Tree, best_order
from ..plans.stats import FEW, KEPT_ROWS, Few, counts, estimate, few, is_plain, is_unique, kept_rows, key_of, key_range, matching

#: Rows that a relation is read for whole, to find one-row tables and small key sets.
FETCH = 4 * FEW
#: Copies of a row that one array of the expansion stands for.
CHUNK = 10_000
#: A relation is broadcast if its rows are estimated at LIGHT bytes at most, and all of its table's wouldn't take more than BOUND.
LIGHT, BOUND = 8 << 20, 64 << 20
#: A range of keys goes to relations that are so many times larger.
RANGE_GAIN = 10


@dataclass(frozen=True)
class Options:
    """Switches; none changes a result."""

    order: bool = True
    singletons: bool = True
    small_keys: bool = True
    key_ranges: bool = True
    semi_joins: bool = True
    compress: bool = False
    staged: bool = False
    #: Joins of few keys with many rows are dealt to tasks by rows.
    deal: bool = True
    #: Light relations are broadcast.
    broadcast: bool = True
    #: Tables of so many rows are probed: read for few rows, ranges of keys, repeated keys.
    probe_rows: int = 100_000


AS_WRITTEN = Options(order=False, singletons=False, small_keys=False, key_ranges=False, semi_joins=False)


@dataclass
class _Relation:
    alias: str
    df: DataFrame
    keys: set[int]  # classes; column _k{class}
    payload: list[Attr]
    rows: float = 0.0  # estimated
    table_rows: float = 0.0
    table: tuple = ()  # what stats.py keeps its facts by
    said: tuple[str, ...] = ()  # predicates so far
    unique: set[int] = field(default_factory=set)
    distinct: bool = False  # a declared key is among its columns
    one_row: bool = False  # an equality on a declared key
    local: list[dict] | None = None  # all rows, if the table is tiny
    base: DataFrame | None = None
    columns: dict[int, str] = field(default_factory=dict)  # of the base, by class
    of: list[_Relation] = field(default_factory=list)  # that a stage has joined

    def keep(self, condition, text: str, column: str, holds: Callable[[object], bool]) -> None:
        self.df = self.df.where(condition)
        self.said = (*self.said, text)
        if self.local is not None:
            self.local = [r for r in self.local if holds(r[column])]

    @property
    def fact(self) -> tuple:
        return *self.table, *self.df.columns, *self.said

    @property
    def light(self) -> bool:
        """Whether to broadcast it. Strings count as long as they are in the kept rows of the table. A negative threshold of
        the session's switches this off, as it does Catalyst's own choice."""
        width = deal.width(self.df)
        if self.rows * width > LIGHT or self.table_rows * width > BOUND or not is_plain(self.base):
            return False
        if self.df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold").startswith("-"):
            return False
        names = {*self.columns.values(), *(c for _, c in self.payload)}
        strings = [f.name for f in self.base.schema if f.name in names and not isinstance(f.dataType, (NumericType, DateType, TimestampType, BooleanType))]
        if strings:
            kept = kept_rows(self.base, self.table_rows)
            width += sum(len(str(r[c])) for r in kept for c in strings) / max(len(kept), 1)
        return self.rows * width <= LIGHT and self.table_rows * width <= BOUND


class _Plan:
    """A query's filtered, pruned relations, with a column for each join class they are in."""

    def __init__(self, query: Query, options: Options):
        self.query, self.options = query, options
        classes = [c for c in query.classes() if len(c) > 1]
        self.class_of = {a: i for i, c in enumerate(classes) for a in c}
        members = [{a for a, _ in c} for c in classes]
        self.name = {a: f"_p{i}" for i, a in enumerate(query.needed())}
        self.constants: dict[str, object] = {}  # column of the joined rows -> value
        self.empty = False
        probing = options.order or options.singletons or options.small_keys or options.key_ranges or options.semi_joins
        rows = dict(zip(query.relations, counts(query.relations.values()) if probing or options.deal or options.broadcast else [0.0] * len(query.relations), strict=True))
        self.relations = {alias: self._relation(alias, base, rows[alias], members, probing) for alias, base in query.relations.items()}

    def _relation(self, alias: str, base: DataFrame, rows: float, members: list[set[str]], probing: bool) -> _Relation:
        by: dict[int, list[str]] = {}
        for (a, col), i in sorted(self.class_of.items()):
            if a == alias:
                by.setdefault(i, []).append(col)
        predicates: list[Predicate] = self.query.filters.get(alias, [])
        same = [(cols[0], other) for cols in by.values() for other in cols[1:]]  # two columns of one class: a local filter
        live = {i: cols for i, cols in by.items() if len(members[i]) > 1}
        conditions = [p.column() for p in predicates] + [F.col(a) == F.col(b) for a, b in same] + [F.col(cols[0]).isNotNull() for cols in live.values()]
        df = base.where(reduce(Column.__and__, conditions)) if conditions else base
        payload = [(a, c) for a, c in self.query.needed() if a == alias and self.class_of.get((a, c)) not in live]
        df = df.selectExpr(*(f"`{cols[0]}` AS _k{i}" for i, cols in sorted(live.items())), *(f"`{c}` AS {self.name[a, c]}" for a, c in payload))
        declared = self.query.keys.get(alias, set())
        said = (*map(str, predicates), *(f"{a} = {b}" for a, b in same), *(f"{c} AS {n}" for n, c in [(f"_k{i}", cols[0]) for i, cols in sorted(live.items())] + [(self.name[a, c], c) for a, c in payload]))
        found = _Relation(alias, df, set(live), payload, rows, rows, key_of(base) if probing else (), said, base=base, columns={i: cols[0] for i, cols in live.items()})
        found.unique = {i for i, cols in live.items() if set(cols) & declared}
        found.distinct = bool(found.unique) or any(c in declared for _, c in payload)
        found.one_row = any(isinstance(p, Cmp) and p.op == "=" and p.name in declared for p in predicates)
        if probing or self.options.deal or self.options.broadcast:
            found.rows = min(1.0, rows) if found.one_row else estimate(base, rows, predicates, same)
            if probing and rows <= KEPT_ROWS and rows <= self.options.probe_rows:
                names = {f"_k{i}": cols[0] for i, cols in live.items()} | {self.name[a, c]: c for a, c in payload}
                found.local = matching(base, rows, predicates, same, [cols[0] for cols in live.values()], names)
                found.rows = found.rows if found.local is None else float(len(found.local))
        return found

    def small(self, r: _Relation) -> bool:
        return r.one_row or r.table_rows <= self.options.probe_rows

    def fetched(self, r: _Relation):
        """r's rows if they are few and its table is small."""
        if r.local is not None:
            return Few(r.local) if len(r.local) <= FETCH else None
        return few(r.df, r.fact, FETCH) if self.small(r) and r.rows <= FETCH else None

    def singletons(self) -> None:
        """One-row relations become constants of their classes, and filters of the other relations."""
        again = True
        while again and len(self.relations) > 1 and not self.empty:
            again = False
            for alias in sorted(self.relations, key=lambda a: (self.relations[a].rows, a)):
                r = self.relations[alias]
                found = self.fetched(r)
                if found is None or len(found.rows) > 1 or len(self.relations) == 1:
                    continue
                if not found.rows:
                    self.empty = True
                    return
                (row,) = found.rows
                del self.relations[alias]
                self.constants |= {self.name[a]: row[self.name[a]] for a in r.payload}
                for i in sorted(r.keys):
                    column, value = f"_k{i}", row[f"_k{i}"]
                    self.constants[column] = value
                    for other in self.relations.values():
                        if i in other.keys:
                            other.keep(F.col(column) == F.lit(value), f"{column} = {value!r}", column, lambda v, value=value: v == value)
                            other.one_row |= i in other.unique
                            other.rows = float(len(other.local)) if other.local is not None else min(other.rows, 1.0 if i in other.unique else max(1.0, other.rows / 10))
                            other.keys.discard(i)
                            other.df = other.df.drop(column)
                again = True

    def small_keys(self) -> None:
        """Up to FEW keys of a relation become an IN filter of the others of the class; a range, if there are more."""
        for r in list(self.relations.values()):
            for i in sorted(r.keys):
                column = f"_k{i}"
                others = [o for o in self.relations.values() if o is not r and i in o.keys and o.rows > FEW]
                found = self.fetched(r) if others else None
                values = found.values(column) if found else None
                if values is not None and len(values) <= FEW:
                    if self.options.small_keys:
                        for o in others:
                            o.keep(F.col(column).isin(values), f"{column} IN {values!r}", column, set(values).__contains__)
                    continue
                others = [o for o in others if o.rows >= RANGE_GAIN * r.rows]
                if others and self.options.key_ranges and self.small(r) and r.rows < r.table_rows / 2:
                    low, high = key_range(r.df, column, r.fact)
                    if low is None:
                        self.empty = True
                        return
                    for o in others:
                        o.keep(F.col(column).between(low, high), f"{column} BETWEEN {low!r} AND {high!r}", column, lambda v, low=low, high=high: low <= v <= high)

    def semi_joins(self) -> None:
        """A relation that only gives a key, each once (or to minimums), filters the smallest other scan of the class; the
        joins pass it on. A class that no other relation has any more is no key, so whole branches fold into one scan."""
        placed = {self.class_of[a] for a in self.query.needed() if a in self.class_of}
        again = True
        while again:
            again = False
            for alias in sorted(self.relations, key=lambda a: (-self.relations[a].rows, a)):
                r = self.relations[alias]
                shared = {i for i in r.keys if any(i in o.keys for o in self.relations.values() if o is not r)}
                if r.payload or len(shared) != 1 or (r.keys - shared) & placed:
                    continue
                (i,) = shared
                others = [o for o in self.relations.values() if o is not r and i in o.keys]
                if self.query.duplicate_insensitive() or i in r.unique or (self.small(r) and is_unique(r.df, f"_k{i}", r.fact)):
                    target = min(others, key=lambda o: (o.rows, o.alias))
                    target.df = target.df.join(F.broadcast(r.df) if self.options.broadcast and r.light else r.df, f"_k{i}", "left_semi")
                    target.said, target.local = (*target.said, f"IN {r.fact!r}"), None
                    target.rows = min(target.rows, max(1.0, target.rows * r.rows / max(r.table_rows, 1.0)))
                    del self.relations[alias]
                    again = True


def run(query: Query, options: Options = Options()) -> DataFrame:
    plan = _Plan(query, options)
    relations = plan.relations
    if options.singletons:
        plan.singletons()
    if (options.small_keys or options.key_ranges) and not plan.empty:
        plan.small_keys()
    if options.semi_joins and not plan.empty:
        plan.semi_joins()
    many: list[str] = []
    if options.compress and not query.duplicate_insensitive():
        for r in relations.values():
            if r.distinct:  # nothing to compress
                continue
            many.append(f"_m{len(many)}")
            count = F.count("*").alias(many[-1])
            r.df = r.df.groupBy(*r.df.columns).agg(count) if r.df.columns else r.df.agg(count)
    kept: list[DataFrame] = []
    joined = _staged(relations, options, kept) if options.staged and len(relations) > 1 else _joined(relations, options)
    if plan.empty:
        joined = joined.limit(0)
    for n, v in plan.constants.items():
        if n not in joined.columns:
            joined = joined.withColumn(n, F.lit(v))
    weight = F.lit(1).cast("long")
    for m in many:
        weight = weight * F.coalesce(F.col(m), F.lit(0))

    def place(a: Attr):
        declared = query.relations[a[0]].schema[a[1]].dataType
        i = plan.class_of.get(a)
        name = f"_k{i}" if i is not None and f"_k{i}" in joined.columns else plan.name[a]
        return F.lit(None).cast(declared) if plan.empty and name not in joined.columns else F.col(name).cast(declared)

    if query.aggregates:
        made = []
        for f, a, name in query.aggregates:
            if f == "count":
                x = F.coalesce(F.sum(weight if a is None else F.when(place(a).isNotNull(), weight)), F.lit(0).cast("long")) if many else F.count("*" if a is None else place(a))
            elif f == "sum":
                x = F.sum(place(a) * weight) if many else F.sum(place(a))
            else:
                x = getattr(F, f)(place(a))
            made.append(x.alias(name))
        out = joined.agg(*made)
    else:
        if many:
            joined = expanded(joined.withColumn("_copies", weight), "_copies")
        out = joined.select(*(place(a).alias(n) for a, n in query.outputs))
    if kept:
        weakref.finalize(out, _release, kept).atexit = False
    return out


def expanded(df: DataFrame, copies: str) -> DataFrame:
    """Each row as often as `copies` says, through arrays of at most CHUNK."""
    zero = F.lit(0).cast("long")
    blocks = F.when(F.col(copies) > 0, F.sequence(zero, F.floor((F.col(copies) - 1) / CHUNK).cast("long")))
    df = df.withColumn("_block", F.explode(blocks))
    left = F.least(F.col(copies) - F.col("_block") * CHUNK, F.lit(CHUNK).cast("long"))
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), left)))


@dataclass
class _Side:
    """One side of a join: a relation, or a join of several."""

    df: DataFrame
    keys: set[int]
    rows: float
    of: list[_Relation]

    @property
    def bytes(self) -> float:
        """At most; only known of a relation."""
        return self.of[0].table_rows * deal.width(self.df) if len(self.of) == 1 else float("inf")

    @property
    def light(self) -> bool:
        return len(self.of) == 1 and self.of[0].light


def _selectivity(left: _Side, right: _Side, both: list[int]) -> float:
    """The part of all pairs of rows that a join on these classes keeps."""
    unique = [r.table_rows for r in left.of + right.of if r.unique & set(both)]
    if unique:
        return 1 / max(*unique, 1.0)
    if left.rows * right.rows < deal.MANY_ROWS:
        return 1 / max(left.rows, right.rows, 1.0)
    a, b = (max(side.of, key=lambda r: len(r.columns.keys() & set(both))) for side in (left, right))
    on = [(a.columns[i], b.columns[i]) for i in both if i in a.columns and i in b.columns]
    return deal.selectivity(a.base, a.table_rows, b.base, b.table_rows, on) if on else 1 / max(left.rows, right.rows, 1.0)


def _pair(left: _Side, right: _Side, options: Options) -> _Side:
    """All classes that both sides have are keys; without one it is a cross product."""
    both = sorted(left.keys & right.keys)
    made = left.rows * right.rows
    if options.deal and both:
        made *= _selectivity(left, right, both)
    light = [x for x, side in enumerate((left, right)) if options.broadcast and both and side.light]
    light = min(light, key=lambda x: (left, right)[x].rows, default=None)
    df = deal.joined(left.df, right.df, [f"_k{i}" for i in both], (left.rows, right.rows), made if options.deal else 0.0, (left.bytes, right.bytes), light)
    return _Side(df, left.keys | right.keys, made, left.of + right.of)


def _edges(relations: dict[str, _Relation]) -> set[frozenset[str]]:
    return {frozenset((a, b)) for a, r in relations.items() for b, s in relations.items() if a != b and r.keys & s.keys}


def join_trees(relations: dict[str, _Relation], options: Options) -> list[Tree]:
    if options.order:
        return best_order({a: (r.rows, deal.width(r.df)) for a, r in relations.items()}, _edges(relations))
    done: list[str] = []
    todo = list(relations)  # as written, but never a cross product where a join is left
    tree: Tree | None = None
    while todo:
        keys = set().union(*(relations[a].keys for a in done)) if done else set()
        pick = next((a for a in todo if relations[a].keys & keys), todo[0])
        todo.remove(pick)
        done.append(pick)
        tree = pick if tree is None else (tree, pick)
    return [tree] if tree is not None else []


def _joined(relations: dict[str, _Relation], options: Options) -> DataFrame:
    sides = {a: _Side(r.df, r.keys, r.rows, r.of or [r]) for a, r in relations.items()}

    def build(t: Tree) -> _Side:
        return sides[t] if isinstance(t, str) else _pair(build(t[0]), build(t[1]), options)

    parts = [build(t) for t in join_trees(relations, options)]
    out = parts[0]
    for p in parts[1:]:
        out = _pair(out, p, options)
    return out.df


def _release(frames: list[DataFrame]) -> None:
    for df in frames:
        df.unpersist()


def _staged(relations: dict[str, _Relation], options: Options, kept: list[DataFrame]) -> DataFrame:
    """Joins the cheapest pair, counts its rows, and plans again, until two are left, which leave nothing to plan. What a
    stage made is persisted (memory and disk, with lineage) for as long as the result's DataFrame lives; it's appended to
    `kept`."""
    left = dict(relations)
    while len(left) > 2:
        edges = _edges(left)
        if not edges:
            break
        a, b = min((sorted(e) for e in edges), key=lambda e: (left[e[0]].rows + left[e[1]].rows, e))
        side = _pair(*(_Side(r.df, r.keys, r.rows, r.of or [r]) for r in (left[a], left[b])), options)
        df = side.df.persist()
        kept.append(df)
        r = _Relation(f"{a}+{b}", df, side.keys, left[a].payload + left[b].payload, float(df.count()), of=side.of)
        del left[a], left[b]
        left[r.alias] = r
    return _joined(left, options)


def explained(query: Query, options: Options = Options()) -> str:
    """The join trees that the planner chooses, with the estimated rows of their relations."""
    plan = _Plan(query, options)
    if options.singletons:
        plan.singletons()
    if (options.small_keys or options.key_ranges) and not plan.empty:
        plan.small_keys()
    if options.semi_joins and not plan.empty:
        plan.semi_joins()
    lines = [f"constants: {', '.join(f'{k} = {v!r}' for k, v in sorted(plan.constants.items()))}"] if plan.constants else []

    def show(t: Tree, depth: int) -> None:
        if isinstance(t, str):
            r = plan.relations[t]
            lines.append("  " * depth + f"{t} ({r.rows:.0f} of {r.table_rows:.0f} rows)" + "".join(f" [{s}]" for s in r.said if " AS " not in s))
        else:
            lines.append("  " * depth + "join")
            for x in t:
                show(x, depth + 1)

    if plan.empty:
        lines.append("no rows")
    for t in join_trees(plan.relations, options):
        show(t, 0)
    return "\n".join(lines)
