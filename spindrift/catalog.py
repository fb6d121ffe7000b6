"""Every registered query of the engine, built through its predicates, plans and planner, and SQL for DuckDB."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .check import differing, random_sql
from .functions.predicates import Between, Cmp, In, IsNull, Like, Not, Predicate
from .operators.engine import AS_WRITTEN, Options, run
from .plans.graph import Query
from .plans.pgplan import from_explain
from .plans.plan import Join, Scan, execute
from .plans.sql import parse
from .plans.stats import sample
from .sources.tables import Folder, Tables, csv_to_parquet, literal, read_csv, read_parquet, rows, schema

Build = Callable[[SparkSession, str], DataFrame]
NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
#: Primary keys of the tables.
KEYS = {"region": {"r_regionkey"}, "nation": {"n_nationkey"}, "customer": {"c_custkey"}, "supplier": {"s_suppkey"}, "part": {"p_partkey"}, "orders": {"o_orderkey"}}
QUERIES: dict[str, Build] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    def add(f: Build) -> Build:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _tables(spark: SparkSession, sf_dir: str) -> Folder:
    return Folder(spark, sf_dir, NAMES)


def _folder(spark: SparkSession, tag: str) -> str:
    """A new folder for a query's own files, deleted when the driver ends; it is shared where spark.checkpoint.dir is set."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="spindrift-")
    path = f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def _filter(name: str, table: str, columns: list[str], where: Predicate, sql: str) -> None:
    @_query(name, sql)
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Tables.of(spark, sf_dir, table).get(table, where).select(*columns)


def _nulls(name: str, columns: list[str], where: Predicate, sql: str) -> None:
    @_query(name, sql)
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        x = read_parquet(spark, sf_dir, "part").select("p_partkey", F.nullif(F.col("p_size") % 7, F.lit(0)).alias("s"), F.nullif("p_name", F.lit("small ring")).alias("n"))
        return Tables({"x": x}).get("x", where).select(*columns)


def _spj(name: str, sql: str, options: Options = Options()) -> None:
    """SQL of the select-project-join kind, through the parser and the planner."""

    @_query(name, sql)
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(parse(sql, _tables(spark, sf_dir), keys=KEYS), options)


@_query("scan_project", "SELECT p_partkey, p_name, p_size FROM part")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_parquet(spark, sf_dir, "part")
    at = [part.columns.index(c) for c in ("p_partkey", "p_name", "p_size")]
    return execute(Scan(0, tuple(zip(at, ("int64", "varchar", "int32"), strict=True))), [part]).toDF("p_partkey", "p_name", "p_size")


@_query("project_reorder_dup", "SELECT r_name AS a, r_regionkey AS k, r_name AS b FROM region")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = read_parquet(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return execute(Scan(0, ((1, "varchar"), (0, "int32"), (1, "varchar"))), [region]).toDF("a", "k", "b")


_filter("filter_eq_int", "part", ["p_partkey"], Cmp("p_size", "=", 10), "SELECT p_partkey FROM part WHERE p_size = 10")
_filter("filter_eq_str", "customer", ["c_custkey"], Cmp("c_mktsegment", "=", "BUILDING"), "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
_filter("filter_neq_str", "customer", ["c_custkey", "c_mktsegment"], Cmp("c_mktsegment", "<>", "BUILDING"), "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING'")
_filter("filter_range", "part", ["p_partkey", "p_size"], Cmp("p_size", ">", 5) & Cmp("p_size", "<=", 20) & Cmp("p_partkey", "<", 1500) & Cmp("p_partkey", ">=", 10), "SELECT p_partkey, p_size FROM part WHERE p_size > 5 AND p_size <= 20 AND p_partkey < 1500 AND p_partkey >= 10")
_filter("filter_str_range", "part", ["p_partkey", "p_brand"], Cmp("p_brand", "<", "Brand#2") & Cmp("p_brand", ">=", "Brand#12"), "SELECT p_partkey, p_brand FROM part WHERE p_brand < 'Brand#2' AND p_brand >= 'Brand#12'")
_filter("filter_like", "part", ["p_partkey", "p_name"], Like("p_name", "%red%") | Like("p_name", "sm_ll%"), "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%red%' OR p_name LIKE 'sm_ll%'")
_filter("filter_between", "part", ["p_partkey"], Between("p_size", 10, 20), "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20")
_filter("filter_in", "part", ["p_partkey", "p_type"], In("p_type", ("PROMO", "LARGE")) & In("p_size", (1, 2, 3, 49)), "SELECT p_partkey, p_type FROM part WHERE p_type IN ('PROMO', 'LARGE') AND p_size IN (1, 2, 3, 49)")
_filter("filter_and_or_not", "part", ["p_partkey"], (Cmp("p_size", "<", 5) | Cmp("p_brand", "=", "Brand#3")) & ~Cmp("p_type", "=", "PROMO"), "SELECT p_partkey FROM part WHERE (p_size < 5 OR p_brand = 'Brand#3') AND NOT (p_type = 'PROMO')")
_nulls("filter_not_like", ["p_partkey"], Like("n", "%red%", negated=True), "SELECT p_partkey FROM (SELECT p_partkey, NULLIF(p_name, 'small ring') AS n FROM part) x WHERE n NOT LIKE '%red%'")
_nulls("filter_is_null", ["p_partkey"], IsNull("s"), "SELECT p_partkey FROM (SELECT p_partkey, NULLIF(p_size % 7, 0) AS s FROM part) x WHERE s IS NULL")
_nulls("filter_is_not_null", ["p_partkey", "s"], IsNull("s", negated=True), "SELECT p_partkey, s FROM (SELECT p_partkey, NULLIF(p_size % 7, 0) AS s FROM part) x WHERE s IS NOT NULL")
_nulls("filter_not_null_aware", ["p_partkey"], Not(Cmp("s", "=", 1)), "SELECT p_partkey FROM (SELECT p_partkey, NULLIF(p_size % 7, 0) AS s FROM part) x WHERE NOT (s = 1)")
_nulls("filter_not_in", ["p_partkey"], Not(In("s", (1, 2))), "SELECT p_partkey FROM (SELECT p_partkey, NULLIF(p_size % 7, 0) AS s FROM part) x WHERE s NOT IN (1, 2)")

_spj("join_pk_fk", "SELECT c.c_custkey, n.n_name FROM customer c, nation n WHERE c.c_nationkey = n.n_nationkey")
_spj("join_dup_keys", "SELECT s.s_suppkey, c.c_custkey FROM supplier s, customer c WHERE s.s_nationkey = c.c_nationkey")
_spj("join_string_key", "SELECT a.p_partkey AS x, b.p_partkey AS y FROM part a, part b WHERE a.p_name = b.p_name AND a.p_size = 10 AND b.p_size = 11")
_spj("join_chain_4", "SELECT r.r_name, n.n_name, c.c_custkey, o.o_orderkey FROM region r, nation n, customer c, orders o WHERE r.r_regionkey = n.n_regionkey AND n.n_nationkey = c.c_nationkey AND c.c_custkey = o.o_custkey AND r.r_name = 'ASIA' AND o.o_orderpriority = '1-URGENT'")
_spj("join_star_5", "SELECT l.l_orderkey, l.l_linenumber, p.p_name, s.s_name, o.o_orderstatus, c.c_name FROM lineitem l, part p, supplier s, orders o, customer c WHERE l.l_partkey = p.p_partkey AND l.l_suppkey = s.s_suppkey AND l.l_orderkey = o.o_orderkey AND o.o_custkey = c.c_custkey AND p.p_size = 10 AND c.c_mktsegment = 'BUILDING'")
_spj("join_snowflake_8", "SELECT MIN(p.p_name) AS min_part, MIN(s.s_name) AS min_supp, MIN(n1.n_name) AS supp_nation, MIN(n2.n_name) AS cust_nation FROM lineitem l, part p, supplier s, orders o, customer c, nation n1, nation n2, region r WHERE l.l_partkey = p.p_partkey AND l.l_suppkey = s.s_suppkey AND l.l_orderkey = o.o_orderkey AND o.o_custkey = c.c_custkey AND s.s_nationkey = n1.n_nationkey AND c.c_nationkey = n2.n_nationkey AND n2.n_regionkey = r.r_regionkey AND r.r_name = 'EUROPE' AND p.p_type = 'PROMO' AND p.p_name LIKE '%red%'")
_spj("join_class_closure", "SELECT c.c_custkey, s.s_suppkey FROM customer c, supplier s, nation n WHERE c.c_nationkey = n.n_nationkey AND s.s_nationkey = n.n_nationkey AND c.c_nationkey = s.s_nationkey AND n.n_name = 'NATION_3'")
_spj("join_composite_key", "SELECT a.l_orderkey, a.l_linenumber, b.l_quantity FROM lineitem a, lineitem b WHERE a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.l_returnflag = 'R' AND b.l_quantity < 5")
_spj("self_join_alias", "SELECT n1.n_name AS a, n2.n_name AS b FROM nation n1, nation n2 WHERE n1.n_regionkey = n2.n_regionkey")
_spj("singleton_elim", "SELECT r.r_name, n.n_name, s.s_suppkey FROM region r, nation n, supplier s WHERE r.r_regionkey = n.n_regionkey AND n.n_nationkey = s.s_nationkey AND r.r_name = 'ASIA'")
_spj("cross_join", "SELECT r.r_name, n.n_name FROM region r, nation n")
_spj("semi_join_elim", "SELECT o.o_orderkey, o.o_totalprice FROM orders o, customer c WHERE o.o_custkey = c.c_custkey AND c.c_nationkey = 3")
_spj("small_key_pushdown", "SELECT s.s_suppkey, s.s_name FROM supplier s, nation n WHERE s.s_nationkey = n.n_nationkey AND n.n_regionkey = 2")
_spj("empty_join", "SELECT c.c_custkey, n.n_name FROM customer c, nation n WHERE c.c_nationkey = n.n_nationkey AND n.n_name = 'NOPE'")
_spj("min_agg", "SELECT MIN(p.p_name) AS min_name, MIN(l.l_linenumber) AS min_line FROM part p, lineitem l WHERE p.p_partkey = l.l_partkey AND p.p_size = 10")
_spj("count_star", "SELECT COUNT(*) AS n FROM orders o, customer c WHERE o.o_custkey = c.c_custkey AND c.c_mktsegment <> 'BUILDING'")


@_query("join_null_keys", "SELECT a.p_partkey AS a_key, b.s_suppkey AS b_key FROM (SELECT p_partkey, NULLIF(p_size % 9, 0) AS k FROM part) a JOIN (SELECT s_suppkey, NULLIF(s_nationkey % 9, 0) AS k FROM supplier) b ON a.k = b.k")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read_parquet(spark, sf_dir, "part").select("p_partkey", F.nullif(F.col("p_size") % 9, F.lit(0)).alias("k"))
    b = read_parquet(spark, sf_dir, "supplier").select("s_suppkey", F.nullif(F.col("s_nationkey") % 9, F.lit(0)).alias("k"))
    plan = Join(Scan(0, ((0, "int64"), (1, "int32"))), Scan(1, ((0, "int64"), (1, "int32"))), 1, 1, ((0, "int64"), (2, "int64")))
    return execute(plan, [a, b]).toDF("a_key", "b_key")


@_query("join_build_left_right", "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'MACHINERY'")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables.of(spark, sf_dir, "orders", "customer")
    inputs = [t.get("orders").select("o_orderkey", "o_custkey"), t.get("customer", Cmp("c_mktsegment", "=", "MACHINERY")).select("c_custkey", "c_name")]
    plan = Join(Scan(0, ((0, "int64"), (1, "int64"))), Scan(1, ((0, "int64"), (1, "varchar"))), 1, 0, ((0, "int64"), (3, "varchar")), build_left=False)
    return execute(plan, inputs).toDF("o_orderkey", "c_name")


@_query("singleton_cross", "SELECT p.p_partkey, s.s_suppkey FROM part p, supplier s, (SELECT 10 AS a, 3 AS b) k WHERE p.p_size = k.a AND s.s_nationkey = k.b")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = literal(spark, [(10, 3)], ["int32", "int32"]).toDF("a", "b")
    q = Query({"p": read_parquet(spark, sf_dir, "part"), "s": read_parquet(spark, sf_dir, "supplier"), "k": k}, [(("p", "p_size"), ("k", "a")), (("s", "s_nationkey"), ("k", "b"))])
    q.outputs = [(("p", "p_partkey"), "p_partkey"), (("s", "s_suppkey"), "s_suppkey")]
    return run(q)


@_query("semi_filter", "SELECT o.o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_mktsegment = 'BUILDING')")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables.of(spark, sf_dir, "orders", "customer")
    keys = t.get("customer", Cmp("c_mktsegment", "=", "BUILDING")).select(F.col("c_custkey").alias("o_custkey"))
    return t.get("orders").join(keys, "o_custkey", "left_semi").select("o_orderkey")


@_query("dup_compress", "SELECT a.t AS t, b.s AS s FROM (SELECT p_type AS t, p_size AS k FROM part WHERE p_partkey < 200) a JOIN (SELECT s_nationkey AS k, s_nationkey % 2 AS s FROM supplier) b ON a.k = b.k")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = Tables.of(spark, sf_dir, "part").get("part", Cmp("p_partkey", "<", 200)).select(F.col("p_type").alias("t"), F.col("p_size").alias("k"))
    b = read_parquet(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), (F.col("s_nationkey") % 2).alias("s"))
    q = Query({"a": a, "b": b}, [(("a", "k"), ("b", "k"))], outputs=[(("a", "t"), "t"), (("b", "s"), "s")])
    return run(q, Options(compress=True))


@_query("distinct_domain", "SELECT DISTINCT p_brand FROM part WHERE p_brand IS NOT NULL")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables.of(spark, sf_dir, "part").get("part", IsNull("p_brand", negated=True)).select("p_brand").distinct()


@_query("bag_count", "SELECT p_type, p_size, COUNT(*) AS m FROM part GROUP BY p_type, p_size")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_parquet(spark, sf_dir, "part").groupBy("p_type", "p_size").agg(F.count("*").alias("m"))


@_query("sample_64")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_parquet(spark, sf_dir, "part").select("p_partkey", "p_size")
    return spark.createDataFrame(sample(part), part.schema)


def _same(name: str, options: list[Options], queries: list[str]) -> None:
    """Rows that differ between ways to run queries; there must be none."""

    @_query(name, "SELECT CAST(0 AS BIGINT) AS differing")
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        n = 0
        for q in queries:
            first, *others = [run(parse(ORACLE_SQL[q], _tables(spark, sf_dir), keys=KEYS), o) for o in options]
            n += sum(differing(first, other) for other in others)
        return literal(spark, [(n,)], ["int64"]).toDF("differing")


#: The select-project-join queries that the planner runs.
JOINS = ["join_pk_fk", "join_dup_keys", "join_string_key", "join_chain_4", "join_star_5", "join_snowflake_8", "join_class_closure", "join_composite_key", "self_join_alias", "singleton_elim", "cross_join", "semi_join_elim", "small_key_pushdown", "empty_join", "min_agg", "count_star"]
_same("staged_vs_direct", [Options(), Options(staged=True)], JOINS)
_same("order_invariance", [Options(), Options(order=False)], JOINS)
_same("toggle_invariance", [AS_WRITTEN, Options()], JOINS)
_same("compress_invariance", [AS_WRITTEN, Options(compress=True)], JOINS)

_spj("key_range", "SELECT l.l_orderkey, l.l_linenumber, o.o_totalprice FROM lineitem l, orders o WHERE l.l_orderkey = o.o_orderkey AND o.o_orderkey BETWEEN 1000 AND 1400 AND o.o_orderstatus = 'F'")
_spj("join_closed_cycle", "SELECT s.s_suppkey, c.c_custkey, n.n_name FROM supplier s, customer c, nation n, region r WHERE s.s_nationkey = n.n_nationkey AND c.c_nationkey = n.n_nationkey AND s.s_nationkey = c.c_nationkey AND n.n_regionkey = r.r_regionkey AND r.r_name >= 'ASIA' AND s.s_suppkey < 20 AND c.c_custkey <= 300")
_spj("join_many_12", "SELECT MIN(n1.n_name) AS a, MIN(n2.n_name) AS b, MIN(p.p_name) AS p, MIN(r2.r_name) AS r FROM lineitem l, part p, supplier s, orders o, customer c, nation n1, nation n2, region r1, region r2, supplier s2, customer c2, orders o2 WHERE l.l_partkey = p.p_partkey AND l.l_suppkey = s.s_suppkey AND l.l_orderkey = o.o_orderkey AND o.o_custkey = c.c_custkey AND s.s_nationkey = n1.n_nationkey AND c.c_nationkey = n2.n_nationkey AND n1.n_regionkey = r1.r_regionkey AND n2.n_regionkey = r2.r_regionkey AND s2.s_nationkey = n1.n_nationkey AND c2.c_nationkey = n2.n_nationkey AND o2.o_custkey = c2.c_custkey AND p.p_size = 10 AND r1.r_name = 'ASIA' AND s2.s_suppkey < 30 AND o2.o_orderpriority = '1-URGENT' AND c.c_mktsegment = 'BUILDING'")


@_query("sum_agg", "SELECT SUM(o.o_custkey) AS s, COUNT(c.c_name) AS n, MAX(c.c_name) AS m FROM orders o, customer c WHERE o.o_custkey = c.c_custkey AND c.c_nationkey < 5")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(parse(ORACLE_SQL["sum_agg"], _tables(spark, sf_dir), keys=KEYS), Options(compress=True)).withColumn("s", F.col("s").cast("decimal(38,0)"))


@_query("columns_named_like_ours", "SELECT a.m AS m, b._copy AS c, b._k0 AS k FROM (SELECT p_partkey AS m, p_size AS _p0 FROM part WHERE p_partkey < 100) a JOIN (SELECT s_suppkey AS _copy, s_nationkey AS _k0 FROM supplier) b ON a._p0 = b._k0")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payload columns with the names that the planner uses itself, expanded from counts."""
    a = Tables.of(spark, sf_dir, "part").get("part", Cmp("p_partkey", "<", 100)).select(F.col("p_partkey").alias("m"), F.col("p_size").alias("_p0"))
    b = read_parquet(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("_copy"), F.col("s_nationkey").alias("_k0"))
    q = Query({"a": a, "b": b}, [(("a", "_p0"), ("b", "_k0"))], outputs=[(("a", "m"), "m"), (("b", "_copy"), "c"), (("b", "_k0"), "k")])
    return run(q, Options(compress=True))


@_query("raw_columns", "SELECT p.p_name AS min_name, l.l_linenumber AS min_line FROM part p, lineitem l WHERE p.p_partkey = l.l_partkey AND p.p_size = 10")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The argument columns of a query's aggregates, as an engine without aggregates gives them."""
    return run(parse(ORACLE_SQL["min_agg"], _tables(spark, sf_dir), raw_columns=True, keys=KEYS))


@_query("imported_plan", "SELECT n1.n_name AS a, n2.n_name AS b, s.s_name AS s FROM nation n1, nation n2, supplier s WHERE n1.n_regionkey = n2.n_regionkey AND s.s_nationkey = n1.n_nationkey AND n2.n_name <> 'NATION_3' AND s.s_suppkey < 50")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A printed plan with a repeated table, casts in its conditions and a hash on the left."""
    scan = lambda table, alias: {"Node Type": "Seq Scan", "Relation Name": table, "Alias": alias}
    hash_ = lambda node: {"Node Type": "Hash", "Plans": [node]}
    inner = {"Node Type": "Hash Join", "Hash Cond": "((n1.n_regionkey)::bigint = (n2.n_regionkey)::bigint)", "Plans": [scan("nation", "n1"), hash_(scan("nation", "n2"))]}
    root = {"Node Type": "Gather", "Plans": [{"Node Type": "Hash Join", "Hash Cond": "(s.s_nationkey = n1.n_nationkey)", "Plans": [hash_(scan("supplier", "s")), inner]}]}
    plan, inputs = from_explain(json.dumps([{"Plan": root}]), parse(ORACLE_SQL["imported_plan"], _tables(spark, sf_dir)))
    return execute(plan, inputs).toDF("a", "b", "s")


def _as_csv(spark: SparkSession, sf_dir: str, tag: str, **options: str) -> str:
    """Part with awkward names, written as CSV."""
    path = _folder(spark, tag)
    name = F.when(F.col("p_size") % 5 == 0, F.lit(None)).when(F.col("p_size") % 5 == 1, F.concat(F.lit('say "'), "p_name", F.lit('", twice'))).when(F.col("p_size") % 5 == 2, F.concat("p_name", F.lit("\nnext\\line"))).otherwise(F.col("p_name"))
    read_parquet(spark, sf_dir, "part").select("p_partkey", name.alias("p_name"), "p_size").write.option("quoteAll", "false").options(**options).csv(path)
    return path


CSV_SQL = """SELECT p_partkey, p_size, CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN 'say "' || p_name || '", twice' WHEN 2 THEN p_name || chr(10) || 'next\\line' ELSE p_name END AS p_name FROM part WHERE p_size > 3"""
CSV_COLUMNS = schema([("p_partkey", "int64"), ("p_name", "varchar"), ("p_size", "int32")])


@_query("csv_scan", CSV_SQL.replace("\\\\", "\\"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed fields with quotes, separators, newlines and backslashes; empty for null; a filter."""
    return read_csv(spark, _as_csv(spark, sf_dir, "csv", escape="\\", quote='"'), CSV_COLUMNS, where=Cmp("p_size", ">", 3))


@_query("csv_options", CSV_SQL.replace("\\\\", "\\"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header, another separator and doubled quotes."""
    return read_csv(spark, _as_csv(spark, sf_dir, "csv", escape='"', sep="|", header="true"), CSV_COLUMNS, where=Cmp("p_size", ">", 3), header=True, sep="|", escape='"')


@_query("csv_quotes_anywhere", "SELECT p_partkey, p_name || ',' || p_type || ', \"' || chr(13) AS t, nullif(p_size, 10) AS p_size FROM part")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes that open and close inside fields, escaped quotes, a separator at the end of each record."""
    path = _folder(spark, "csv")
    size = F.when(F.col("p_size") != 10, F.col("p_size").cast("string")).otherwise("")
    lines = read_parquet(spark, sf_dir, "part").select(F.concat_ws(",", F.col("p_partkey").cast("string"), F.concat("p_name", F.lit('","'), "p_type", F.lit('", \\""'), F.lit('"\r"')), size, F.lit("")).alias("value"))
    lines.write.text(path)
    return read_csv(spark, path, schema([("p_partkey", "int64"), ("t", "varchar"), ("p_size", "int32")]), trailing_separator=True, quotes="anywhere")


@_query("csv_converted", CSV_SQL.replace("\\\\", "\\"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV to Parquet, and read from there."""
    out = _folder(spark, "tables")
    csv_to_parquet(spark, {"part": (_as_csv(spark, sf_dir, "csv", escape="\\"), CSV_COLUMNS)}, out)
    return Tables.of(spark, out, "part").get("part", Cmp("p_size", ">", 3))


@_query("kept_filter", "SELECT a.p_partkey AS x, b.p_partkey AS y FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_size = b.p_size WHERE a.p_brand = 'Brand#3' AND b.p_brand = 'Brand#3'")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filtered table, kept under its predicate, used twice."""
    t = Tables.of(spark, sf_dir, "part")
    once, again = (t.get("part", Cmp("p_brand", "=", "Brand#3"), keep=True) for _ in range(2))
    a = once.select(F.col("p_partkey").alias("x"), "p_type", "p_size")
    return a.join(again.select(F.col("p_partkey").alias("y"), "p_type", "p_size"), ["p_type", "p_size"]).select("x", "y")


@_query("rows_and_back", "SELECT n_nationkey AS c0, n_name AS c1, nullif(n_regionkey, 2) AS c2 FROM nation")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small table as rows on the driver, and as columns again."""
    n = read_parquet(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int"), "n_name", F.nullif(F.col("n_regionkey").cast("int"), F.lit(2)))
    return literal(spark, [tuple(r) for r in rows(n)], ["int32", "varchar", "int32"])


for _seed in range(100, 108):
    _spj(f"random_{_seed}", random_sql(_seed))
