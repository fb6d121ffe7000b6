"""Bags compared, and random queries to compare with."""

from __future__ import annotations

import random
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .plans.graph import Query
from .plans.sql import parse
from .sources.tables import printed

#: Joins of the test schema: child column, parent column.
LINKS = [("lineitem.l_partkey", "part.p_partkey"), ("lineitem.l_suppkey", "supplier.s_suppkey"), ("lineitem.l_orderkey", "orders.o_orderkey"), ("orders.o_custkey", "customer.c_custkey"), ("supplier.s_nationkey", "nation.n_nationkey"), ("customer.c_nationkey", "nation.n_nationkey"), ("nation.n_regionkey", "region.r_regionkey")]
PREDICATES = {
    "part": ["p_size = {n}", "p_size BETWEEN {n} AND {m}", "p_type IN ('PROMO', 'LARGE')", "p_name LIKE '%red%'", "p_name NOT LIKE 's%'", "p_brand < 'Brand#2'"],
    "supplier": ["s_nationkey <= {n}", "s_suppkey <> {n}"],
    "orders": ["o_orderstatus = 'F'", "o_orderpriority IN ('1-URGENT', '2-HIGH')", "o_orderkey < {k}"],
    "customer": ["c_mktsegment = 'BUILDING'", "(c_nationkey = {n} OR c_nationkey > {m})", "NOT c_mktsegment = 'MACHINERY'"],
    "nation": ["n_nationkey < {m}", "n_name IS NOT NULL"],
    "region": ["r_name = 'ASIA'", "r_name >= 'ASIA'"],
    "lineitem": ["l_returnflag = 'R'", "l_linenumber <= 3", "l_orderkey < {k}"],
}

#: Buckets that unequal bags are compared by; the driver gets one digest of each.
BUCKETS = 4096
#: Shuffle files of a query go when it has ended, instead of when the driver happens to collect its garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows with more copies on one side, side 0 or 1 first; none if the bags are equal. Columns meet by position."""
    b = b.toDF(*a.columns)
    return a.exceptAll(b).selectExpr("0 AS side", "*").union(b.exceptAll(a).selectExpr("1 AS side", "*"))


def _hash(df: DataFrame, seed: int, nulls: list[str]) -> Column:
    """64 bits of a row. xxhash64 passes over nulls, so which columns are null is hashed too, as the bits of a number for each
    60 columns; the first number has the seed as well."""
    flags = [F.lit(seed).cast("long")] + [F.lit(0).cast("long")] * ((len(nulls) - 1) // 60)
    for i, c in enumerate(nulls):
        flags[i // 60] += F.col(c).isNull().cast("long") * (2 << i % 60)
    return F.xxhash64(*flags, *df.columns)


def _digest(df: DataFrame, nulls: list[str], *by: Column) -> DataFrame:
    """How many rows there are and the sums of the parts of two hashes, by these columns of the hashes h0 and h1, or of all
    rows; parts are so short that sums of 2 ** 41 rows don't overflow."""
    rows = df.select(*(_hash(df, seed, nulls).alias(f"h{seed}") for seed in (0, 1)))
    parts = [F.sum(F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << 22) - 1).cast("long"))) for h in ("h0", "h1") for at in (0, 22, 44)]
    return rows.groupBy(*by).agg(F.count("*"), *parts)


def differing(a: DataFrame, b: DataFrame) -> int:
    """How many rows difference() has, without shuffling equal bags: every row of both sides is made and goes into the
    digest of its side, which takes no table of groups. If the two differ, rows go into the digests of their buckets, and
    the rows of buckets whose digests differ are compared one by one."""
    names = [f"c{i}" for i in range(len(a.columns))]
    a, b = a.toDF(*names), b.toDF(*names)
    if [f.dataType for f in a.schema] != [f.dataType for f in b.schema]:
        return difference(a, b).count()  # equal values of unlike types have unlike hashes
    spark = a.sparkSession
    old = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        nulls = [n for n, f, g in zip(names, a.schema, b.schema, strict=True) if f.nullable or g.nullable]

        def unlike(*by: Column) -> set[tuple]:
            # A job for each side: in one, Spark would make the rows of equal plans only once.
            x, y = ({tuple(r) for r in _digest(df, nulls, *by).collect()} for df in (a, b))
            return x ^ y

        if not unlike():
            return 0
        buckets = {d[0] for d in unlike(F.pmod("h0", F.lit(BUCKETS)).alias("bucket"))}
        return difference(*(df.where(F.pmod(_hash(df, 0, nulls), F.lit(BUCKETS)).isin(sorted(buckets))) for df in (a, b))).count()
    finally:
        spark.conf.set(CLEAN_UP, old)


def explained(a: DataFrame, b: DataFrame, limit: int = 20) -> str:
    return printed(difference(a, b), limit)


def random_sql(seed: int) -> str:
    """A connected query of two to five relations with up to eight predicates."""
    r = random.Random(seed)
    table = lambda c: c.split(".")[0]
    used, joins = {table(r.choice(LINKS)[0])}, []
    for _ in range(r.randint(1, 4)):
        near = [(a, b) for a, b in LINKS if (table(a) in used) != (table(b) in used)]
        if not near:
            break
        a, b = r.choice(near)
        joins.append(f"{a} = {b}")
        used |= {table(a), table(b)}
    where = [p.format(n=r.randint(1, 20), m=r.randint(21, 40), k=r.randint(100, 3000)) for t in sorted(used) for p in r.sample(PREDICATES[t], r.randint(0, min(2, len(PREDICATES[t]))))][:8]
    if "lineitem" in used:
        where.append("lineitem.l_orderkey < 2000")
    columns = {"part": "p_name", "supplier": "s_suppkey", "orders": "o_orderkey", "customer": "c_name", "nation": "n_name", "region": "r_name", "lineitem": "l_linenumber"}
    outs = r.sample(sorted(used), r.randint(1, len(used)))
    shape = r.choice(["rows", "min", "count"])
    if shape == "rows":
        select = ", ".join(f"{t}.{columns[t]} AS o{i}" for i, t in enumerate(outs))
    elif shape == "min":
        select = ", ".join(f"MIN({t}.{columns[t]}) AS o{i}" for i, t in enumerate(outs))
    else:
        select = "COUNT(*) AS n"
    return f"SELECT {select} FROM {', '.join(sorted(used))} WHERE {' AND '.join(joins + where)}"


def random_query(seed: int, tables: Mapping[str, DataFrame]) -> tuple[str, Query]:
    text = random_sql(seed)
    return text, parse(text, tables)
