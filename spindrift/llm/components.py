"""Connected components of links between ids, with nothing collected to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Links that one task contracts at once: 16 bytes each, and about 100 while it works.
LINKS_PER_TASK = 1_000_000


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each id of these links and the smallest one that it reaches by them."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(ids))
    while len(a):
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return ids, ids[root]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    have = [(C.col(b, "u").to_numpy(), C.col(b, "v").to_numpy()) for b in batches]
    if have:
        u, v = stars(*(np.concatenate(x) for x in zip(*have, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def components(links: DataFrame, scratch: C.Scratch) -> DataFrame:
    """links: a, b (long). Returns id, component (the smallest id reachable) for every id that a link names.

    Tasks first contract the links that they hold (LINKS_PER_TASK each) to stars. If there is one such task, this is the
    result. Else large-star and small-star steps alternate (both keep the components and end in stars in a logarithmic
    number of rounds). Minimums are aggregated before the shuffle, and the join back to a hub's links is a plain
    equi-join that adaptive execution may split.
    """
    edges = scratch.table(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"), "links")
    last = None
    while True:
        tasks = -(-edges.count() // LINKS_PER_TASK)
        inner = scratch.table(edges.coalesce(max(1, tasks)).mapInArrow(_contracted, "u long, v long"), "links")
        scratch.drop(edges)
        if tasks <= 1:
            return inner.toDF("id", "component")
        edges = inner.where("u <> v")
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = scratch.table(small, "links")
        scratch.drop(inner)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    roots = edges.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
