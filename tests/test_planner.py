"""Join order, statistics, what the planner starts, ways to read CSV, and a workload of many-table queries."""

import functools
import itertools
import json
import random
import re

import duckdb
import movies
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from spindrift import catalog
from spindrift.functions.predicates import And, Between, Cmp, In, IsNull, Like, Not, Or
from spindrift.operators import engine
from spindrift.operators.engine import AS_WRITTEN, Options, explained, run
from spindrift.plans import deal, order, stats
from spindrift.plans.graph import Query
from spindrift.plans.pgplan import PlanError, from_explain
from spindrift.plans.plan import Join, Scan, drawn, execute
from spindrift.plans.sql import parse
from spindrift.sources.tables import Folder, Tables, csv_to_parquet, literal, read_csv, read_parquet, schema

SF = "/root/testdata/sf0.001"
I, S = "int32", "varchar"


def bag(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def all_trees(names, edges):
    """Every tree without a cross product."""
    if len(names) == 1:
        yield names[0]
        return
    for bits in range(1, 1 << (len(names) - 1)):
        left = [n for i, n in enumerate(names) if bits >> i & 1]
        right = [n for n in names if n not in left]
        if any(frozenset((a, b)) in edges for a in left for b in right):
            for a in all_trees(left, edges):
                for b in all_trees(right, edges):
                    yield a, b


def test_order_is_the_cheapest_of_all_trees():
    r = random.Random(3)
    for _ in range(30):
        names = [f"r{i}" for i in range(r.randint(2, 6))]
        edges = {frozenset((names[i], names[r.randrange(i)])) for i in range(1, len(names))} | {frozenset(r.sample(names, 2)) for _ in range(r.randint(0, 3))}
        sizes = {n: (10 ** r.uniform(0, 7), r.uniform(8, 80)) for n in names}

        def part(t, sizes=sizes):
            return order.Part(*sizes[t], 0.0, t) if isinstance(t, str) else order.joined(part(t[0]), part(t[1]))

        (tree,) = order.best_order(sizes, edges)
        assert part(tree).cost == pytest.approx(min(part(t).cost for t in all_trees(names, edges)))


def test_order_of_large_graphs():
    names = [f"r{i:02}" for i in range(18)]
    leaves = lambda t: [t] if isinstance(t, str) else leaves(t[0]) + leaves(t[1])
    for edges in ({frozenset(p) for p in itertools.combinations(names, 2)}, {frozenset(p) for p in zip(names, names[1:])}, {frozenset((names[0], n)) for n in names[1:]}):
        (tree,) = order.best_order({n: (1000.0 * (i + 1), 20.0) for i, n in enumerate(names)}, edges)
        assert sorted(leaves(tree)) == names
    assert len(order.best_order({"a": (5, 8), "b": (3, 8), "c": (1, 8)}, {frozenset("ab")})) == 2


def test_predicates_hold_as_spark_says(spark):
    rows = [(None, None), (1, "ab"), (2, "a%b"), (5, "A\nb"), (7, ""), (9, "a\\b")]
    df = literal(spark, rows, [I, S])
    for p in (Cmp("c0", "<", 5), Cmp("c1", ">=", "a"), Cmp("c0", "!=", 1), Like("c1", "a%b"), Like("c1", "_\n_"), Like("c1", "a_b", negated=True), Like("c1", "a\\b"), Between("c0", 2, 7), In("c1", ("", "ab")), IsNull("c0"), IsNull("c1", True), Not(Cmp("c0", "=", 1)), And((Cmp("c0", ">", 1), Like("c1", "a%"))), Or((Cmp("c0", "=", 9), IsNull("c1")))):
        got = df.select(p.column().alias("h")).collect()
        assert [r["h"] for r in got] == [p.holds({"c0": a, "c1": b}) for a, b in rows], str(p)
    with pytest.raises(TypeError):
        Cmp("c0", "=", "x").holds({"c0": 1})


def test_sample_draws_with_replacement(spark, tmp_path):
    spark.range(1000).repartition(5).write.parquet(str(tmp_path / "t.parquet"))
    t = read_parquet(spark, str(tmp_path), "t")
    assert len(stats.sample(t)) == 64 and len(set(stats.sample(t, 5000))) < 1000 and len(stats.sample(t, 5000)) == 5000
    seen = [x for s in range(30) for (x,) in stats.sample(t, 64, s)]
    assert 420 < sum(seen) / len(seen) < 580 and min(seen) < 50 and max(seen) > 950
    few = t.where("id < 3")
    assert {x for (x,) in stats.sample(few, 60)} == {0, 1, 2} and stats.sample(t.limit(0)) == []


def test_estimates(spark):
    part = read_parquet(spark, SF, "part")
    rows = stats.counts([part])[0]
    assert rows == part.count()
    assert stats.estimate(part, rows, [], []) == rows
    true = part.where("p_size <= 25").count()
    assert stats.estimate(part, rows, [Cmp("p_size", "<=", 25)], []) == pytest.approx(true, rel=0.3)
    assert 0 < stats.estimate(part, rows, [Cmp("p_size", "=", 10**6)], []) < 10
    assert stats.estimate(part, rows, [Cmp("p_size", "=", "10")], []) == rows / 10


def jobs(spark, f):
    """How many Spark jobs f starts."""
    store = spark.sparkContext._jsc.sc().statusStore()
    count = lambda: store.jobsList(None).size()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    before = count()
    f()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    return count() - before


def test_planning_again_starts_no_job(spark):
    stats.forget()
    build = lambda: catalog.QUERIES["join_snowflake_8"](spark, SF)
    tables = Folder(spark, SF, catalog.NAMES)
    for n in catalog.NAMES:
        tables[n]
    assert jobs(spark, build) <= 8
    assert jobs(spark, build) == 0


def test_large_tables_are_not_probed(spark, monkeypatch):
    stats.forget()
    asked = []
    monkeypatch.setattr(engine, "few", lambda df, key, most: asked.append("few"))
    monkeypatch.setattr(engine, "key_range", lambda *_: asked.append("range") or (0, 10**9))
    monkeypatch.setattr(engine, "is_unique", lambda *_: asked.append("unique") or False)
    q = parse("SELECT o.o_orderkey FROM orders o, lineitem l WHERE o.o_orderkey = l.l_orderkey AND l.l_quantity < 3", Folder(spark, SF, catalog.NAMES))
    run(q, Options(probe_rows=100))
    run(q, Options(probe_rows=100, order=False))
    assert asked == []


def test_key_ranges_reach_the_scan(spark):
    q = parse(catalog.ORACLE_SQL["key_range"], Folder(spark, SF, catalog.NAMES), keys=catalog.KEYS)
    plan = run(q)._jdf.queryExecution().executedPlan().toString()
    lineitem = next(x for x in plan.split("FileScan") if "l_linenumber" in x[:60])
    assert "GreaterThanOrEqual(l_orderkey,1003)" in lineitem  # the least key that the other conditions leave


def test_bloom_filters_of_shuffled_joins(spark):
    """Spark puts the Bloom filter of a filtered side's keys on the other side's scan while a shuffled join runs."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "0")
        q = parse("SELECT l.l_linenumber, p.p_name FROM lineitem l, part p WHERE l.l_partkey = p.p_partkey AND p.p_size = 10", Folder(spark, SF, catalog.NAMES))
        df = run(q, AS_WRITTEN)
        assert "might_contain" in df._jdf.queryExecution().optimizedPlan().toString()
        assert df.count() == run(q).count()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_expansion_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(engine, "CHUNK", 7)
    df = spark.createDataFrame([("a", 0), ("b", 1), ("c", 7), ("d", 23)], "x string, m long")
    assert {r["x"]: r["count"] for r in engine.expanded(df, "m").groupBy("x").count().collect()} == {"b": 1, "c": 7, "d": 23}


def test_staged_frames_are_released(spark):
    kept = lambda: spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    before = kept()
    q = parse(catalog.ORACLE_SQL["join_chain_4"], Folder(spark, SF, catalog.NAMES), keys=catalog.KEYS)
    df = run(q, Options(staged=True, singletons=False, small_keys=False))
    assert df.count() > 0 and kept() > before
    del df
    import gc

    gc.collect()
    assert kept() == before


def test_explained(spark):
    q = parse(catalog.ORACLE_SQL["join_chain_4"], Folder(spark, SF, catalog.NAMES), keys=catalog.KEYS)
    text = explained(q)
    assert "join" in text and "customer" not in text and re.search(r"o \(\d+ of 1500 rows\)", text) and "r_regionkey" not in text
    assert drawn(Join(Scan(0, ((0, I),)), Scan(1, ((1, S),)), 0, 0, ((0, I), (1, S))), ["a", "b"]) == "join left 0 = right 0 (build left) [0, 1]\n  scan a [0]\n  scan b [1]"


# Positional plans of five and seven tables; the middle ones have one row.
FIVE = [[(10, "r1"), (20, "r2"), (30, "r3")], [(10, 100)], [(100, "200", 300), (100, "210", 300), (101, "220", 300)], [(300, 400)], [(400, "v1"), (401, "v2")]]
SEVEN = [[(10, 111), (20, 222)], [(10, 100)], [(100, 200), (100, 210)], [(200, 300)], [(300, 400), (300, 410)], [(400, 500)], [(500, 600), (500, 610)]]


@pytest.mark.parametrize(("tables", "keys"), [(FIVE, [0, 3, 6, 8]), (SEVEN, [0, 3, 5, 7, 9, 11])])
def test_chains_through_singletons(spark, tables, keys):
    types = [[S if isinstance(v, str) else I for v in t[0]] for t in tables]
    inputs = [literal(spark, t, k) for t, k in zip(tables, types)]
    node, outs = Scan(0, tuple(enumerate(types[0]))), list(types[0])
    want = [tuple(r) for r in tables[0]]
    for i, key in enumerate(keys, 1):
        outs += types[i]
        node = Join(node, Scan(i, tuple(enumerate(types[i]))), key, 0, tuple(enumerate(outs)), build_left=bool(i % 2))
        want = [(*a, *b) for a in want for b in tables[i] if a[key] == b[0]]
    assert len(want) == 2 and bag(execute(node, inputs).collect()) == bag(want)
    place, at = [], {}
    for i, t in enumerate(types):
        at[i] = len(place)
        place += [(f"t{i}", f"c{k}") for k in range(len(t))]
    q = Query({f"t{i}": df for i, df in enumerate(inputs)}, [(place[key], (f"t{i}", "c0")) for i, key in enumerate(keys, 1)], outputs=[(a, f"o{n}") for n, a in enumerate(place)])
    for o in (Options(), AS_WRITTEN, Options(compress=True), Options(staged=True)):
        assert bag(run(q, o).collect()) == bag(want)


@pytest.mark.parametrize("sizes", [(1, 2, 5), (5, 1, 100), (100, 200, 5), (200, 100, 200), (2, 200, 1), (1000, 5, 100)])
def test_three_tables_of_many_sizes(spark, sizes):
    a, b, c = sizes
    r0 = [(i + 1, 100 * 10 ** (i % 4)) for i in range(a)]
    r1 = [(i + 1, 10 * i) for i in range(b)]
    r2 = [(100 * 10 ** (i % 4), 10 * i + 1) for i in range(c)]
    tables = [literal(spark, r, [I, I]) for r in (r0, r1, r2)]
    q = Query(dict(zip("xyz", tables)), [(("x", "c0"), ("y", "c0")), (("x", "c1"), ("z", "c0"))], outputs=[((t, k), t + k) for t in "xyz" for k in ("c0", "c1")])
    by = {}
    for k, v in r2:
        by.setdefault(k, []).append((k, v))
    want = bag((*x, *y, *z) for x in r0 for y in [t for t in r1[x[0] - 1 : x[0]]] for z in by.get(x[1], []))
    for o in (Options(), Options(compress=True)):
        assert bag(run(q, o).collect()) == want


def test_long_values_and_constants(spark, tmp_path):
    t = literal(spark, [(5, "a"), (6, "x" * 32_000), (None, None)], [I, S])
    t.write.parquet(str(tmp_path / "t.parquet"))
    back = read_parquet(spark, str(tmp_path), "t")
    assert bag(execute(Scan(0, ((1, S), (0, I), (1, S))), [back]).collect()) == bag([("a", 5, "a"), ("x" * 32_000, 6, "x" * 32_000), (None, None, None)])
    one = literal(spark, [(42, "y" * 42_174)], [I, S]).toDF("k", "v")
    many = spark.range(2000).select(F.lit(42).alias("k"))
    got = run(Query({"m": many, "o": one}, [(("m", "k"), ("o", "k"))], outputs=[(("o", "v"), "v")])).groupBy("v").count().first()
    assert got["count"] == 2000 and len(got["v"]) == 42_174


def test_schemas_follow_the_files(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    assert read_parquet(spark, str(tmp_path), "t").columns == ["id"]
    import shutil
    import time

    shutil.rmtree(tmp_path / "t.parquet")
    time.sleep(1.1)
    spark.range(3).selectExpr("id", "id + 1 AS more").write.parquet(str(tmp_path / "t.parquet"))
    assert read_parquet(spark, str(tmp_path), "t").columns == ["id", "more"]


def test_facts_follow_the_files(spark, tmp_path):
    """A table of the same size with other rows, in the same place."""
    import time

    import pyarrow as pa
    import pyarrow.parquet as pq

    write = lambda name, k: pq.write_table(pa.table({"k": pa.array([k], pa.int32()), "v": pa.array([k * 2], pa.int32())}), tmp_path / f"{name}.parquet")
    pq.write_table(pa.table({"k": pa.array([1, 2, 3], pa.int32())}), tmp_path / "t.parquet")
    sql, got = "SELECT t.k AS k, o.v AS v FROM t, o WHERE t.k = o.k", []
    for k in (1, 3):
        write("o", k)
        got.append([tuple(r) for r in run(parse(sql, Folder(spark, str(tmp_path), ["t", "o"]))).collect()])
        time.sleep(1.1)
    assert got == [[(1, 2)], [(3, 6)]]


def test_kept_tables(spark):
    t = Tables.of(spark, SF, "part")
    where = Cmp("p_size", "<", 10)
    once = t.get("part", where, keep=True)
    assert t.get("part", Cmp("p_size", "<", 10)) is once and once.is_cached and not t.get("part").is_cached
    assert once.count() == t.get("part").where("p_size < 10").count()
    t.most = 1
    t.get("part", Cmp("p_size", "<", 11), keep=True)
    assert not once.is_cached
    t.release()


CSV = schema([("a", I), ("b", S), ("c", "int64")])


@pytest.mark.parametrize("quotes", ["whole", "anywhere"])
@pytest.mark.parametrize(
    ("text", "options", "want"),
    [
        ("1,x,2\n3,,\n", {}, [(1, "x", 2), (3, None, None)]),
        ("1,x,2\r\n3,y,4", {}, [(1, "x", 2), (3, "y", 4)]),
        ("1,x,2\r3,y,4\r", {}, [(1, "x", 2), (3, "y", 4)]),
        ("a,b,c\n1,x,2\n", {"header": True}, [(1, "x", 2)]),
        ("1|x,y|2\n", {"sep": "|"}, [(1, "x,y", 2)]),
        ("1,x,2,\n3,,4,\n", {"trailing_separator": True}, [(1, "x", 2), (3, None, 4)]),
        ('1,"p ""q"" r",2\n', {"escape": '"'}, [(1, 'p "q" r', 2)]),
        ('1,"p \\"q\\" \\\\",2\n', {}, [(1, 'p "q" \\', 2)]),
        ('1,"p\nq,r",2\n3,"",4\n', {}, [(1, "p\nq,r", 2), (3, None, 4)]),
        ("1,x,2\n3,y,4\n", {"where": Cmp("a", ">", 1)}, [(3, "y", 4)]),
    ],
)
def test_csv_forms(spark, tmp_path, quotes, text, options, want):
    (tmp_path / "t.csv").write_bytes(text.encode())
    assert bag(read_csv(spark, str(tmp_path / "t.csv"), CSV, quotes=quotes, **options).collect()) == bag(want)


def test_csv_quotes_anywhere(spark, tmp_path):
    (tmp_path / "t.csv").write_text('1,ab"c,d"e,2\n2,x"\\"\n\\\\"y\\z,"3"\n')
    assert bag(read_csv(spark, str(tmp_path / "t.csv"), CSV, quotes="anywhere").collect()) == bag([(1, "abc,de", 2), (2, 'x"\n\\y\\z', 3)])


@pytest.mark.parametrize("quotes", ["whole", "anywhere"])
@pytest.mark.parametrize(("text", "options"), [("1,x\n", {}), ("1,x,2,3\n", {}), ("1x,y,2\n", {}), ("1,x,2\n", {"trailing_separator": True}), ('1,"x,2\n', {})])
def test_csv_errors(spark, tmp_path, quotes, text, options):
    (tmp_path / "t.csv").write_text(text)
    with pytest.raises((PySparkException, Py4JJavaError)):
        read_csv(spark, str(tmp_path / "t.csv"), CSV, quotes=quotes, **options).collect()


def test_csv_becomes_parquet(spark, tmp_path):
    (tmp_path / "t.csv").write_text("1,x,2\n,,\n")
    csv_to_parquet(spark, {"t": (str(tmp_path / "t.csv"), CSV)}, str(tmp_path / "out"))
    assert bag(read_parquet(spark, str(tmp_path / "out"), "t").collect()) == bag([(1, "x", 2), (None, None, None)])


def test_explained_plans_of_self_joins(spark):
    tables = Folder(spark, SF, catalog.NAMES)
    sql = "SELECT n1.n_name AS a, r.r_name AS b, n2.n_name AS c FROM nation n1, nation n2, region r WHERE n1.n_regionkey = r.r_regionkey AND n2.n_regionkey = r.r_regionkey AND n1.n_name < n2.n_name".replace(" AND n1.n_name < n2.n_name", " AND n1.n_name < 'NATION_2'")
    q = parse(sql, tables)
    scan = lambda t, a: {"Node Type": "Seq Scan", "Relation Name": t, "Alias": a}
    hashed = lambda n: {"Node Type": "Hash", "Plans": [n]}
    first = {"Node Type": "Hash Join", "Plans": [scan("nation", "n1"), hashed(scan("nation", "n2"))]}  # an implied equality
    plan = {"Plan": {"Node Type": "Aggregate", "Plans": [{"Node Type": "Hash Join", "Plans": [first, hashed(scan("region", "r"))]}]}}
    made, inputs = from_explain(json.dumps(plan), q)
    assert bag(execute(made, inputs).collect()) == bag(run(q).collect())
    for bad in ({"Plan": first}, {"Plan": {"Node Type": "Hash Join", "Plans": [first, scan("region", "r")]}}, {"Plan": {"Node Type": "Merge Join", "Plans": [first, hashed(scan("region", "r"))]}}, {"Plan": {"Node Type": "Hash Join", "Plans": [first, hashed(scan("region", "zz"))]}}):
        with pytest.raises(PlanError):
            from_explain(json.dumps(bad), q)


@pytest.fixture(scope="module")
def movie_tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("movies"))
    movies.write(folder)
    duck = duckdb.connect()
    for t in movies.TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return Folder(spark, folder, movies.TABLES), duck


def test_every_movie_query_is_planned(movie_tables):
    tables, _ = movie_tables
    for i in range(sum(movies.RELATIONS.values())):
        q = parse(movies.query(i), tables, keys=movies.KEYS)
        classes = [{a for a, _ in c} for c in q.classes()]
        edges = {frozenset(p) for c in classes for p in itertools.combinations(sorted(c), 2)}
        (tree,) = order.best_order({a: (100.0 + n, 30.0) for n, a in enumerate(q.relations)}, edges)
        assert isinstance(tree, tuple)


@pytest.mark.parametrize("number", [0, 4, 13, 22, 24, 30, 41, 47, 55, 62, 70, 77, 84, 92, 100, 105, 109, 111])
def test_movie_query(movie_tables, number):
    tables, duck = movie_tables
    sql = movies.query(number)
    q = parse(sql, tables, keys=movies.KEYS)
    assert bag(run(q).collect()) == bag(duck.sql(sql).fetchall()), sql
    if number % 4 == 0:
        raw = parse(sql, tables, raw_columns=True, keys=movies.KEYS)
        wanted = functools.reduce(lambda s, _: s, [re.sub(r"MIN\(([^)]*)\)", r"\1", sql)])
        assert run(raw, Options(compress=True)).count() == len(duck.sql(f"SELECT * FROM ({wanted})").fetchall())


def test_branches_of_minimums_fold_into_one_scan(spark):
    """Orders filter their customers, and these, whose only other key is then the nation, filter nations."""
    q = parse(catalog.ORACLE_SQL["join_many_12"], Folder(spark, SF, catalog.NAMES), keys=catalog.KEYS)
    joined = {line.split()[0] for line in explained(q).splitlines() if "join" not in line}
    assert not joined & {"o2", "c2", "s2"} and {"l", "o", "c"} <= joined
    q = parse("SELECT c2.c_custkey FROM customer c, customer c2, orders o2 WHERE c.c_nationkey = c2.c_nationkey AND o2.o_custkey = c2.c_custkey", Folder(spark, SF, catalog.NAMES), keys=catalog.KEYS)
    assert run(q).count() == run(q, AS_WRITTEN).count() > 0  # rows that count aren't folded


@pytest.mark.parametrize("most", [deal.BROADCAST, 0])
def test_joins_of_few_keys_are_dealt_by_rows(spark, monkeypatch, most):
    """Through a broadcast side and through copies of a side; the rows are those of a plain join, whatever the deal."""
    for k, v in {"MANY_ROWS": 10, "GAIN": 0, "TASK_ROWS": 7, "BROADCAST": most, "PAIRS": 1}.items():
        monkeypatch.setattr(deal, k, v)
    tables = Folder(spark, SF, catalog.NAMES)
    for name in ("join_dup_keys", "random_101", "join_class_closure", "join_string_key", "join_composite_key"):
        q = parse(catalog.ORACLE_SQL[name], tables, keys=catalog.KEYS)
        got = run(q)
        assert bag(got.collect()) == bag(run(q, Options(deal=False)).collect())
        if name == "random_101":
            assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [deal.BROADCAST, 0])
def test_positional_joins_of_few_keys_are_dealt_by_rows(spark, monkeypatch, most):
    """Null keys meet nothing, duplicates stay, and a second join goes on from there."""
    part, supplier = (read_parquet(spark, SF, t) for t in ("part", "supplier"))
    a = part.select("p_partkey", F.nullif(F.col("p_size") % 3, F.lit(0)).alias("k"))
    b = supplier.select(F.lit(5).alias("x"), F.nullif(F.col("s_nationkey") % 3, F.lit(0)).alias("k"))
    two = Join(Scan(0, ((0, "int64"), (1, I))), Scan(1, ((0, I), (1, I))), 1, 1, ((0, "int64"), (2, I), (3, I)))
    three = Join(two, Scan(1, ((1, I),)), 2, 0, ((0, "int64"), (1, I), (3, I)))
    want = [bag(execute(p, [a, b]).collect()) for p in (two, three)]
    for k, v in {"MANY_ROWS": 10, "GAIN": 0, "TASK_ROWS": 7, "BROADCAST": most, "PAIRS": 1}.items():
        monkeypatch.setattr(deal, k, v)
    got = execute(two, [a, b])
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString() and want[0]
    assert [bag(got.collect()), bag(execute(three, [a, b]).collect())] == want


def test_how_often_keys_meet(spark):
    customer, supplier, lineitem = (read_parquet(spark, "/root/testdata/sf0.01", t) for t in ("customer", "supplier", "lineitem"))
    n, m, k = stats.counts([customer, supplier, lineitem])
    true = customer.join(supplier, F.col("c_nationkey") == F.col("s_nationkey")).count()
    assert deal.selectivity(customer, n, supplier, m, [("c_nationkey", "s_nationkey")]) * n * m == pytest.approx(true, rel=0.3)
    assert deal.selectivity(lineitem, k, lineitem, k, [("l_orderkey", "l_orderkey"), ("l_linenumber", "l_linenumber")]) == 1 / k  # sampled rows don't count as their own partners


def test_joins_as_written_are_dealt_by_what_their_filters_leave(spark):
    """Without it a join of two filtered tables is taken for one of whole tables, and a side is copied to all shares."""
    q = parse(catalog.ORACLE_SQL["join_string_key"], Folder(spark, SF, catalog.NAMES), keys=catalog.KEYS)
    for r in engine._Plan(q, AS_WRITTEN).relations.values():
        assert 0 < r.rows < r.table_rows / 5


def test_light_relations_are_broadcast(spark, monkeypatch, tmp_path):
    """By estimated rows, so that a large table isn't shuffled for a filtered small one; not if a wrong estimate could do harm."""
    monkeypatch.setattr(engine, "LIGHT", 100_000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        for name, semi in (("raw_columns", False), ("join_star_5", False), ("semi_join_elim", True)):
            q = parse(catalog.ORACLE_SQL[name], Folder(spark, "/root/testdata/sf0.01", catalog.NAMES), keys=catalog.KEYS)
            got, plain = run(q), run(q, Options(broadcast=False))
            plan, old = (x._jdf.queryExecution().executedPlan().toString() for x in (got, plain))
            assert "BroadcastHashJoin" in plan and "BroadcastHashJoin" not in old and ("LeftSemi, BuildRight" in plan) == semi
            assert bag(got.collect()) == bag(plain.collect())
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert "BroadcastHashJoin" not in run(q)._jdf.queryExecution().executedPlan().toString()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
        assert "BroadcastHashJoin" in run(q)._jdf.queryExecution().executedPlan().toString()
        with monkeypatch.context() as m:
            m.setattr(engine, "BOUND", 1_000)
            assert "BroadcastHashJoin" not in run(q)._jdf.queryExecution().executedPlan().toString()
        spark.range(400).selectExpr("id AS c_custkey", "'x' AS c_name", "0.5D AS c_acctbal", "repeat('BUILDING', 1000) AS c_mktsegment", "3 AS c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
        q = parse("SELECT l.o_orderkey, c.c_mktsegment FROM customer c, l WHERE c.c_custkey = l.o_custkey", {"customer": spark.read.parquet(f"{tmp_path}/customer.parquet"), "l": read_parquet(spark, "/root/testdata/sf0.01", "orders").select("o_orderkey", "o_custkey")})
        assert "BroadcastHashJoin" not in run(q)._jdf.queryExecution().executedPlan().toString()  # 400 rows of 8 KB
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
