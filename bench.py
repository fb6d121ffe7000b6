"""Times the engine's headline queries: warm runs on one session, planning included, one JSON line.

BENCH_SF_DIR, BENCH_CPUS, BENCH_REPEAT; BENCH_QUERIES: some of them, with commas. BENCH_ARMS=0 leaves out the comparison:
queries of many tables as written, by Spark's cost-based optimizer with analyzed columns, in our order, and with each
rewrite in turn. BENCH_CHECK=1 compares each result with DuckDB's and prints rows that differ to stderr.
"""

from __future__ import annotations

import json
import os
import sys
import time
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from spindrift.catalog import KEYS, NAMES, ORACLE_SQL, QUERIES
from spindrift.check import explained
from spindrift.operators.engine import AS_WRITTEN, Options, run
from spindrift.plans.sql import parse
from spindrift.session import get_spark
from spindrift.sources.tables import Folder

HEADLINE = ["scan_project", "filter_range", "filter_like", "join_pk_fk", "join_dup_keys", "join_chain_4", "join_star_5", "join_snowflake_8", "join_composite_key", "singleton_elim", "semi_join_elim", "small_key_pushdown", "dup_compress", "min_agg", "count_star"]
COMPARED = ["join_chain_4", "join_star_5", "join_snowflake_8", "join_composite_key", "semi_join_elim"]
ORDERED = replace(AS_WRITTEN, order=True)
#: The planner's arms; "cbo" is Spark's.
ARMS = {"as_written": AS_WRITTEN, "order": ORDERED, **{f"order+{k}": replace(ORDERED, **{k: True}) for k in ("singletons", "small_keys", "key_ranges", "semi_joins")}, "default": Options()}


def timed(build: Callable[[], DataFrame], repeat: int) -> float:
    took = []
    for _ in range(repeat + 1):  # the first run compiles, and reads what the planner keeps
        began = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - began)
    return round(sum(took[1:]) / repeat, 4)


def arms(spark: SparkSession, sf_dir: str, repeat: int, names: list[str]) -> dict[str, dict[str, float]]:
    measure = lambda times: {a: {n: timed(lambda n=n, o=o: run(parse(ORACLE_SQL[n], Folder(spark, sf_dir, NAMES), keys=KEYS), o), times) for n in names} for a, o in ARMS.items()}
    measure(1)  # else the first arm pays for what is compiled
    out = measure(repeat)
    for t in NAMES:
        spark.sql(f"CREATE TABLE IF NOT EXISTS {t} USING parquet LOCATION '{sf_dir}/{t}.parquet'")
        spark.sql(f"ANALYZE TABLE {t} COMPUTE STATISTICS FOR ALL COLUMNS")
    for k in ("enabled", "joinReorder.enabled"):
        spark.conf.set(f"spark.sql.cbo.{k}", "true")
    out["cbo"] = {n: timed(lambda n=n: spark.sql(ORACLE_SQL[n]), repeat) for n in names}
    for k in ("enabled", "joinReorder.enabled"):
        spark.conf.set(f"spark.sql.cbo.{k}", "false")
    return out


def check(spark: SparkSession, sf_dir: str, names: list[str]) -> bool:
    import duckdb

    duck, good = duckdb.connect(), True
    for t in NAMES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for n in names:
        got, want = QUERIES[n](spark, sf_dir), duck.sql(ORACLE_SQL[n])
        columns = sorted(got.columns)
        told = spark.createDataFrame(want.project(", ".join(columns)).df().astype(object).where(lambda x: x.notna(), None).values.tolist(), got.select(*columns).schema)
        differ = explained(got.select(*columns), told)
        good &= not differ
        print(f"{n}: {'rows differ (0: ours, 1: DuckDB)' if differ else 'equal'}\n{differ}".rstrip(), file=sys.stderr)
    return good


def main() -> int:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = get_spark("bench", int(os.environ.get("BENCH_CPUS", "8")), **{"spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    times = {n: timed(lambda n=n: QUERIES[n](spark, sf_dir), repeat) for n in names}
    out = {"metric": "total_time", "value": round(sum(times.values()), 4), "unit": "sec", "queries": times, "sf": sf_dir.rpartition("sf")[2]}
    compared = [n for n in COMPARED if n in names]
    if os.environ.get("BENCH_ARMS", "1") != "0" and compared:
        out["arms"] = arms(spark, sf_dir, repeat, compared)
        out["arms_total"] = {a: round(sum(t.values()), 4) for a, t in out["arms"].items()}
    good = check(spark, sf_dir, [n for n in names if n in ORACLE_SQL]) if os.environ.get("BENCH_CHECK", "0") != "0" else True
    print(json.dumps(out))
    spark.stop()
    return not good


if __name__ == "__main__":
    sys.exit(main())
