"""Every registered engine query against DuckDB; plan cases; random queries; switches; parser, CSV and plan import."""

import json

import duckdb
import pytest

from spindrift import catalog, check
from spindrift.check import difference, random_sql
from spindrift.functions.predicates import Cmp, Like
from spindrift.operators.engine import AS_WRITTEN, Options, run
from spindrift.plans.graph import Query
from spindrift.plans.pgplan import PlanError, from_explain
from spindrift.plans.plan import Join, Scan, execute
from spindrift.plans.sql import SqlError, parse
from spindrift.sources.tables import literal, printed, read_csv, schema

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for n in catalog.NAMES:
        c.sql(f"CREATE VIEW {n} AS SELECT * FROM '{SF}/{n}.parquet'")
    return c


def bag(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_duckdb(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    cols = sorted(df.columns)
    assert bag(df.select(*cols).collect()) == bag(want.project(", ".join(cols)).fetchall())


def test_sample(spark):
    assert 0 < catalog.QUERIES["sample_64"](spark, SF).count() <= 64


I, S = "int32", "varchar"
FIVE = [(1, "xxx"), (1, "yyy"), (None, "zzz"), (2, "uuu"), (3, "vvv")]


@pytest.mark.parametrize(
    ("rows", "want"),
    [([], []), ([1], [1]), ([1, 2, 3], [1, 2, 3]), ([1, 1, 2, 3], [1, 1, 1, 1, 2, 3]), ([1, 1, None, 2, 3], [1, 1, 1, 1, 2, 3])],
)
def test_positional_self_join(spark, rows, want):
    t = literal(spark, [(r,) for r in rows], [I])
    got = execute(Join(Scan(0, ((0, I),)), Scan(1, ((0, I),)), 0, 0, ((0, I), (1, I))), [t, t])
    assert got.dtypes == [("c0", "int"), ("c1", "int")]
    assert bag(got.collect()) == bag([(w, w) for w in want])


def test_positional_columns_and_three_tables(spark):
    t = literal(spark, FIVE, [I, S])
    two = Join(Scan(0, ((0, I),)), Scan(1, ((1, S), (0, I))), 0, 1, ((0, I), (2, I), (1, S)))
    assert bag(execute(two, [t, t]).collect()) == bag([(1, 1, "xxx")] * 2 + [(1, 1, "yyy")] * 2 + [(2, 2, "uuu"), (3, 3, "vvv")])
    three = Join(Scan(2, ((0, I),)), two, 0, 0, ((0, I), (1, I), (3, S)))
    assert bag(execute(three, [t, t, t]).collect()) == bag([(1, 1, "xxx")] * 4 + [(1, 1, "yyy")] * 4 + [(2, 2, "uuu"), (3, 3, "vvv")])


def test_singleton_makes_a_cross_product(spark):
    r = literal(spark, [(10, "xxx"), (10, "xxx"), (10, "yyy"), (None, "zzz"), (20, "uuu"), (20, "uuu"), (30, "vvv")], [I, S]).toDF("k", "v")
    s = literal(spark, [(10, 20)], [I, I]).toDF("a", "b")
    q = Query({"r": r, "s": s, "t": r}, [(("r", "k"), ("s", "a")), (("s", "b"), ("t", "k"))], outputs=[((x, c), x + c) for x, c in (("r", "k"), ("r", "v"), ("s", "a"), ("s", "b"), ("t", "k"), ("t", "v"))])
    want = bag([(10, "xxx", 10, 20, 20, "uuu")] * 4 + [(10, "yyy", 10, 20, 20, "uuu")] * 2)
    for o in (AS_WRITTEN, Options(), Options(compress=True), Options(staged=True)):
        assert bag(run(q, o).collect()) == want


def test_null_singleton_and_empty_relation_keep_types(spark):
    r = literal(spark, [(1, "x")], [I, S]).toDF("k", "v")
    for rows in ([(None, 5)], []):
        s = literal(spark, rows, [I, I]).toDF("a", "b")
        got = run(Query({"r": r, "s": s}, [(("r", "k"), ("s", "a"))], outputs=[(("r", "v"), "v"), (("s", "b"), "b"), (("s", "a"), "a")]))
        assert got.dtypes == [("v", "string"), ("b", "int"), ("a", "int")] and got.count() == 0


@pytest.mark.parametrize("seed", range(24))
def test_random_query(spark, duck, seed):
    text = random_sql(seed)
    tables = catalog._tables(spark, SF)
    want = bag(duck.sql(text).fetchall())
    for o in (Options(), AS_WRITTEN) if seed % 3 else (Options(compress=True), Options(staged=True)):
        assert bag(run(parse(text, tables, keys=catalog.KEYS), o).collect()) == want, text


def test_raw_columns(spark):
    tables = catalog._tables(spark, SF)
    q = parse("SELECT MIN(n.n_name) AS m FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey", tables, raw_columns=True)
    assert run(q).count() == 25


@pytest.mark.parametrize("text", ["SELECT x FROM nation", "SELECT n_name FROM nation, region WHERE n_regionkey < r_regionkey", "SELECT n_name FROM nation WHERE n_name = 'A' ORDER BY n_name", "SELECT n_name FROM nation n, region r WHERE n.n_name = 'A' OR r.r_name = 'B'", "SELECT n_name FROM nope", "SELECT n_name FROM nation WHERE n_nationkey + 1 = 2"])
def test_what_the_parser_refuses(spark, text):
    with pytest.raises(SqlError):
        parse(text, catalog._tables(spark, SF))


def test_like_takes_backslashes_as_they_are(spark):
    df = literal(spark, [("a\\%b",), ("a\nb",), ("ab",)], [S])
    assert df.where(Like("c0", "a\\%b").column()).count() == 1
    assert df.where(Like("c0", "a%b").column()).count() == 3
    assert df.where(Cmp("c0", "=", "ab").column()).count() == 1


def test_csv(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text('1,"a, \\"b\\"\nc",\n,,2\n')
    df = read_csv(spark, str(p), schema([("a", "int32"), ("b", "varchar"), ("c", "int64")]))
    assert bag(df.collect()) == bag([(1, 'a, "b"\nc', None), (None, None, 2)])
    bad = tmp_path / "bad.csv"
    bad.write_text("x,b,1\n")
    with pytest.raises(Exception, match=r"(?i)malformed|FAILFAST"):
        read_csv(spark, str(bad), schema([("a", "int32"), ("b", "varchar"), ("c", "int64")])).collect()


def test_explained_plan(spark):
    tables = {n: t for n, t in catalog._tables(spark, SF).items() if n in ("nation", "region")}
    q = parse("SELECT n.n_name AS a, r.r_name AS b FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey AND r.r_name = 'ASIA'", tables)
    plan = {"Plan": {"Node Type": "Gather", "Plans": [{"Node Type": "Hash Join", "Hash Cond": "(n.n_regionkey = r.r_regionkey)", "Plans": [{"Node Type": "Seq Scan", "Relation Name": "nation", "Alias": "n"}, {"Node Type": "Hash", "Plans": [{"Node Type": "Seq Scan", "Relation Name": "region", "Alias": "r"}]}]}]}}
    made, inputs = from_explain(json.dumps([plan]), q)
    assert difference(execute(made, inputs), run(q)).isEmpty()
    plan["Plan"]["Plans"][0]["Node Type"] = "Nested Loop"
    with pytest.raises(PlanError):
        from_explain(json.dumps(plan), q)


def test_printed(spark):
    assert printed(literal(spark, [(1, 'a"b'), (None, None)], [I, S])) == '1|"a\\"b"\nNULL|NULL'


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_differing_rows_are_counted_by_digests(spark, monkeypatch):
    """As many as difference() has, and it's asked only for buckets that differ."""
    asked = []
    monkeypatch.setattr(check, "difference", lambda a, b: asked.append(a.count() + b.count()) or difference(a, b))
    nan = float("nan")
    rows = [(None, 1, 0.0), (1, None, nan), (1, None, nan), (1, 1, 2.5), (2, 1, None)] + [(i, i % 7, float(i)) for i in range(500)]
    df = lambda x: spark.createDataFrame(x, "a long, b int, c double").repartition(3)
    assert check.differing(df(rows), df(rows[::-1]).toDF("x", "y", "z")) == 0 and not asked
    for other in (rows[1:], [*rows, rows[1]], [(1, None, 0.0), *rows[1:]], [*rows[1:], *rows[1:]], [(-1, 3, 0.5), (9, None, -1.0), *rows[2:]], []):
        want = difference(df(rows), df(other)).count()
        assert check.differing(df(rows), df(other)) == want > 0
        assert not other or len(other) > 600 or 0 < asked[-1] < 20
    assert check.differing(df(rows), df(rows).selectExpr("cast(a AS int)", "b", "c")) == 0


def test_equal_bags_are_not_shuffled(spark):
    """Each task sends digests of buckets, whatever the number of rows."""
    store, bus = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    jobs = lambda: store.jobsList(None).size()
    bus.waitUntilEmpty(10_000)
    before = jobs()
    assert check.differing(spark.range(300_000), spark.range(299_999, -1, -1, 5)) == 0
    bus.waitUntilEmpty(10_000)
    ids = {store.jobsList(None).apply(i).stageIds().apply(k) for i in range(jobs() - before) for k in range(store.jobsList(None).apply(i).stageIds().size())}
    written = [store.lastStageAttempt(i).shuffleWriteRecords() for i in ids]
    assert 0 < max(written) <= check.BUCKETS * 8


def test_equal_bags_take_one_digest_a_task(spark):
    """No buckets: a table of groups costs most of the time of joins that make billions of rows."""
    store, bus = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    jobs = lambda: store.jobsList(None).size()
    bus.waitUntilEmpty(10_000)
    before = jobs()
    assert check.differing(spark.range(0, 9_000, 1, 3), spark.range(8_999, -1, -1, 5)) == 0
    bus.waitUntilEmpty(10_000)
    ids = {store.jobsList(None).apply(i).stageIds().apply(k) for i in range(jobs() - before) for k in range(store.jobsList(None).apply(i).stageIds().size())}
    assert sorted(store.lastStageAttempt(i).shuffleWriteRecords() for i in ids)[-2:] == [3, 5]


def test_hashes_tell_nulls_apart(spark):
    """In every column, beyond the 60 whose flags fit into a number too, and from zeros."""
    names = [f"c{i}" for i in range(130)]
    rows = [[1 if k != i else v for k in range(130)] for i in range(130) for v in (None, 0)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names))
    hashes = [r[0] for seed in (0, 1) for r in df.select(check._hash(df, seed, names)).collect()]
    assert len(set(hashes)) == 2 * len(rows)
    one = spark.createDataFrame([(None, 1), (1, None), (1, 1), (None, None)], "a int, b int")
    assert len({r[0] for seed in (0, 1) for r in one.select(check._hash(one, seed, ["a", "b"])).collect()}) == 8


def test_staged_mode_keeps_no_last_join(spark):
    """Two relations leave nothing to plan anew: their join isn't counted or kept."""
    kept = lambda: spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    before = kept()
    q = parse(catalog.ORACLE_SQL["join_dup_keys"], catalog._tables(spark, SF), keys=catalog.KEYS)
    df = run(q, Options(staged=True))
    assert kept() == before and bag(df.collect()) == bag(run(q).collect())


def test_rows_with_a_key_are_not_compressed(spark):
    """Their counts would all be 1, and each joined row would be expanded for nothing."""
    plan = lambda name: run(parse(catalog.ORACLE_SQL[name], catalog._tables(spark, SF), keys=catalog.KEYS), Options(compress=True))._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan("join_dup_keys") and "Generate" not in plan("join_dup_keys")
    assert "Aggregate" in plan("join_star_5") and "Generate" in plan("join_star_5")  # of lineitem


def test_order_invariance_counts_rows_that_one_order_loses(spark, monkeypatch):
    """Without a comparison of all rows in the query's own plan."""
    monkeypatch.setattr(catalog, "run", lambda q, o: run(q, o) if o.order else run(q, o).limit(3))
    df = catalog.QUERIES["order_invariance"](spark, SF)
    assert "replicate" not in df._jdf.queryExecution().optimizedPlan().toString().lower()
    want = sum(max(0, run(parse(catalog.ORACLE_SQL[q], catalog._tables(spark, SF), keys=catalog.KEYS)).count() - 3) for q in catalog.JOINS)
    assert [tuple(r) for r in df.collect()] == [(want,)]
