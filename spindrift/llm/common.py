"""What the operators share: reading tables, scratch tables, and words of whole Arrow columns in numpy."""

from __future__ import annotations

import ctypes
import math
import os
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

U = np.uint64
#: Bytes 9 to 13 and 32 separate words.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
NEWLINE = np.zeros(256, bool)
NEWLINE[10] = True
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[65:91] += 32
WORD_SPLIT = "[\\x20\\x09-\\x0D]+"
UPPER_AZ, LOWER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


ROWS_PER_BATCH, BYTES_PER_BATCH = 1000, 4 << 20


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    # Workers give memory back to the system instead of keeping it for later stages.
    for k, v in {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": "16777216", "MALLOC_TRIM_THRESHOLD_": "33554432"}.items():
        env.setdefault(k, v)
    # Batches of whole texts: Spark's default of 10,000 rows a batch would hold long ones many times over.
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ROWS_PER_BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_PER_BATCH)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BYTES_PER_BATCH)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only a session on one machine may go without one: it gets a temp folder."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spindrift-checkpoint-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


#: Shuffle files of a query go when it has ended, instead of when the driver happens to collect its garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _written(df: DataFrame, tag: str, by: str | None = None) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    old = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, old)
    files, where = _hadoop(spark, path)
    files.deleteOnExit(where)
    return (df if by else spark.read.schema(df.schema).parquet(path)), path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts its lineage; Hadoop deletes it when the driver ends."""
    return _written(df, tag)[0]


class Scratch:
    """Written tables that only one call of an operator needs: the end of the block deletes them. What the call returns
    must not read them, so it's materialized inside the block. A lost executor loses none of them.

    After sized(), light tables (what an exchange leaves for little work) are written by as many tasks as their size asks
    for, not by one for each shuffle partition: many tiny files cost more than what is in them."""

    def __init__(self, spark: SparkSession):
        self.spark, self._paths, self.tasks = spark, [], 0

    def sized(self, rows: int, each: int = 500_000) -> None:
        """rows: what light tables have at about the most; so many `each` in a task."""
        self.tasks = max(12, -(-rows // each))

    def __enter__(self) -> Scratch:
        return self

    def table(self, df: DataFrame, tag: str) -> DataFrame:
        out, path = _written(df, tag)
        self._paths.append((out, path))
        return out

    def light(self, df: DataFrame, tag: str) -> DataFrame:
        return self.table(df.coalesce(self.tasks) if self.tasks else df, tag)

    def kept(self, df: DataFrame, tag: str) -> DataFrame:
        """A light result that stays when the block ends."""
        return materialize(df.coalesce(self.tasks) if self.tasks else df, tag)

    def split(self, df: DataFrame, tag: str, by: str, *values: str) -> list[DataFrame]:
        """df as a table for each value of the string column `by`, without that column."""
        _, path = _written(df, tag, by)
        shape = T.StructType([f for f in df.schema if f.name != by])
        empty = self.spark.createDataFrame([], shape)
        files, _ = _hadoop(self.spark, path)
        out = []
        for v in values:
            own = f"{path}/{by}={v}"
            there = files.exists(_hadoop(self.spark, own)[1])
            out.append(self.spark.read.schema(shape).parquet(own) if there else empty)
            self._paths.append((out[-1], own))
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes some of them early."""
        for t in tables:
            for have, path in self._paths:
                if have is t:
                    files, where = _hadoop(self.spark, path)
                    files.delete(where, True)
        self._paths = [x for x in self._paths if not any(x[0] is t for t in tables)]

    def __exit__(self, *_) -> None:
        self.drop(*(t for t, _ in self._paths))


#: Bytes up to which a table is broadcast, by its values' own sizes; beyond it the join shuffles.
BROADCAST_BYTES = 16 << 20


def _size_of(kind: T.DataType, value: Column) -> Column:
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        each = 16 * (len(kind.elementType.fields) if isinstance(kind.elementType, T.StructType) else 1)
        if isinstance(kind.elementType, (T.StringType, T.BinaryType)):
            return F.aggregate(value, F.lit(16), lambda a, x: a + F.octet_length(x) + 16)
        return F.greatest(F.size(value), F.lit(0)) * each + 16
    return F.lit(8)


def bytes_of(df: DataFrame) -> int:
    """What the rows of a written table take in memory, about."""
    row = F.lit(16).cast("long")
    for f in df.schema:
        row = row + _size_of(f.dataType, F.col(f"`{f.name}`"))
    return df.agg(F.sum(row)).first()[0] or 0


def small(df: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """df, a written table (or one made from the written table `of`), with a broadcast hint if its measured bytes are few."""
    return F.broadcast(df) if bytes_of(df if of is None else of) <= BROADCAST_BYTES else df


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """Column names like these that none of `taken` equals, whatever the case."""
    have = {t.lower() for t in taken}
    out = []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out


def trim() -> None:
    """Gives freed memory of a Python worker back to the system."""
    global _LIBC
    if _LIBC is None:
        try:
            _LIBC = ctypes.CDLL("libc.so.6")
        except OSError:  # another C library
            _LIBC = False
    if _LIBC:
        _LIBC.malloc_trim(0)


_LIBC = None


def remainder(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: the folds of the contracts."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")), F.lit(n))


def sized_partitions(total_bytes: int, each: int, least: int = 12) -> int:
    """So many partitions that each holds about `each` bytes."""
    return max(least, math.ceil(total_bytes / each))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BASE = 0x9E3779B97F4A7C15
CHUNK = 1 << 19
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64, for i < n."""
    if not _POWERS or len(_POWERS["up"]) < n:
        n = max(n, CHUNK + 4096)
        up = np.full(n, BASE, U)
        up[0] = 1
        down = np.full(n, pow(BASE, -1, 1 << 64), U)
        down[0] = 1
        _POWERS.update(up=np.multiply.accumulate(up), down=np.multiply.accumulate(down))
    return _POWERS["up"], _POWERS["down"]


def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; the spans are in order and don't overlap."""
    out = np.empty(len(start), U)
    i = 0
    while i < len(start):
        a = int(start[i])
        j = max(i + 1, int(np.searchsorted(start, a + CHUNK)))
        b = int(end[j - 1])
        up, down = powers(b - a + 1)
        sums = np.zeros(b - a + 1, U)
        np.cumsum((buf[a:b].astype(U) + U(1)) * up[: b - a], out=sums[1:])
        s = start[i:j] - a
        out[i:j] = (sums[end[i:j] - a] - sums[s]) * down[s]
        i = j
    return mix(out ^ ((end - start).astype(U) * U(0xD6E8FEB86659FD93)))


@dataclass
class Words:
    """The tokens of a column of texts. doc: each one's row; per_doc: tokens of each row; start, end: bytes in buf."""

    doc: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    per_doc: np.ndarray
    buf: np.ndarray
    at: np.ndarray  # where each row begins in buf, and buf's end; a row ends one byte before the next


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows, a newline after each, and where each begins; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    lines = pc.binary_join_element_wise(texts, pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    if isinstance(lines, pa.ChunkedArray):
        lines = lines.combine_chunks()
    at = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + len(lines) + 1]
    data = lines.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[at[0] : at[-1]], at - at[0]


def words(texts: pa.Array, space: np.ndarray = SPACE, fold: np.ndarray = LOWER, hashed: bool = True) -> Words:
    """Maximal runs of bytes that aren't in `space` (which has the newline), hashed after `fold`."""
    buf, at = joined(texts)
    gap = space[buf]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if len(buf) and not gap[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[::2], edge[1::2]
    first = np.searchsorted(start, at)
    per_doc = np.diff(first)
    h = span_hash(fold[buf], start, end) if hashed else np.zeros(0, U)
    return Words(np.repeat(np.arange(len(per_doc), dtype=np.int32), per_doc), h, start, end, per_doc, buf, at)


#: Bytes of text that a step in numpy takes at once.
STEP = 1 << 20


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", step: int = STEP) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each piece has one row, or few bytes of text."""
    for b in batches:
        if not b.num_rows:
            continue
        col = b.column(b.schema.get_field_index(column))
        size = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
        i = 0
        while i < len(size):
            j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + step, side="right")))
            yield b.slice(i, j - i)
            i = j
    trim()


def col(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def blobs(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())
