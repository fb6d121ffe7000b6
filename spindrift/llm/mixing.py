"""Mixing sources to target weights by entropy balancing.

A document's rate is the least change (in relative entropy) from 1 that meets token constraints: each source's words
come to its target, and each class of sizes (powers of two) keeps its share of the words, so that the mix doesn't turn
long documents into short ones where sources differ in length. rate = exp(multiplier of the source + multiplier of the
class), `most` at the most. Targets of sources hold exactly; those of classes give way where both can't hold (SLACK).

The convex dual is solved by Newton's method. Words are first summed to cells of (source, class). Sources are rows of a
table, however many there are: each iteration solves their multipliers from the classes' and sums the gradient and the
Hessian of the rest, CLASSES numbers and their products, in Spark; only these reach the driver.

Rates become copies by thresholds: documents fall into BINS bins by a hash of doc_id, and of a cell those below its
threshold get the ceiling of the rate, the others the floor. Thresholds are chosen per cell from the words in each bin,
largest sizes first, and what one cell takes too much or too little is shared among the source's smaller ones. So a source
ends within about a document of its smallest class of its target, if the smaller classes can make up for the larger ones. A document's
copies follow from its source, size and hash alone: its text isn't moved to decide them.

Defined results: null or blank texts have size 0 and their copies count nothing; a null source is a source of its own,
last in order; a source without words has target 0 and isn't taken; repeated rows are rows of their own with the same
copies each. An empty table gives an empty result. Columns of docs that have a result's name stay; the result's name gets one more underscore.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

QUERY, SQL = "op2_source_mixing", None
WEIGHTS = (1.0, 2.0, 3.0)
MAX_REPEAT = 3.0
#: Classes of sizes: 0 and 1 words, 2 and 3, 4 to 7 ...; the last has all that are larger.
CLASSES = 24
BINS = 4096
#: How far a class may stay from its share of the words (as a part of it), for a multiplier of 1. Classes of a few long
#: documents can't keep theirs without taking over their source.
SLACK = 0.5
NAMES = ("_size", "_source_size", "_target", "_rate", "_copies")


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.size(F.array_remove(F.split(F.col(text), C.WORD_SPLIT), "")).cast("long"), F.lit(0).cast("long"))


def _key(source: str = "source") -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))


def _class(size: Column) -> Column:
    return F.least(F.floor(F.log2(F.greatest(size, F.lit(1)))), F.lit(CLASSES - 1)).cast("int")


def _bin() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(BINS)).cast("int")


def source_targets(sources: DataFrame, weights: tuple[float, ...], most: float, s: C.Scratch) -> DataFrame:
    """sources (key, tokens by class) with size and target. In order of their keys they weigh `weights` in turn and share
    all words by weight; what exceeds `most` times a source's size is shared among the others by weight, until none does."""
    ranked = s.light(sources.orderBy(F.col("key") == "n", "key").withColumn("place", F.monotonically_increasing_id()), "mix-ranked")
    first, offsets = 0, []
    for part, n in sorted(tuple(r) for r in ranked.groupBy(F.shiftright("place", 33)).count().collect()):  # a row for each partition
        offsets += [F.lit(part), F.lit(first)]
        first += n
    place = F.element_at(F.create_map(*offsets), F.shiftright("place", 33)) + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) if offsets else F.lit(0)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    size = F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x)
    table = s.light(ranked.select("key", "tokens", size.alias("size"), weight.alias("weight")), "mix-sources")
    total = float(table.agg(F.sum("size")).first()[0] or 0)
    closed, rest, by, level = -1, total, None, 0.0
    over = lambda: F.col("weight") * level > most * F.col("size")
    while total:
        n, full, open_ = table.agg(F.count(F.when(over(), 1)), F.sum(F.when(over(), most * F.col("size"))), F.sum(F.when(~over(), F.col("weight")))).first()
        if n == closed or not open_:
            break
        closed, rest, by = n, total - (full or 0.0), open_
        level = rest / by
    return s.light(table.withColumn("target", F.when(over(), most * F.col("size")).otherwise(F.lit(rest) * F.col("weight") / F.lit(by or 1.0))), "mix-targets")


def solve(tokens: np.ndarray, target: np.ndarray, mu: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """For sources (rows) and classes: the rates that meet the sources' targets given the classes' multipliers, and which
    of them are below `most`. 0 < target < most * size."""
    tilt = np.exp(mu)[None, :]
    free = np.broadcast_to(np.ones_like(tilt, bool), tokens.shape).copy()
    while True:
        up = (target - most * (tokens * ~free).sum(1)) / np.maximum((tokens * tilt * free).sum(1), 1e-300)
        rate = np.where(free, np.maximum(up, 0)[:, None] * tilt, most)
        over = free & (rate >= most) & (tokens > 0)
        if not over.any():
            return np.minimum(rate, most), free
        free &= ~over


def _live(target: np.ndarray, size: np.ndarray, most: float) -> np.ndarray:
    return (target > 0) & (target < most * size * (1 - 1e-12))


def _columns(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    tokens = C.col(b, "tokens").flatten().to_numpy().reshape(b.num_rows, CLASSES).astype(float)
    return tokens, C.col(b, "size").to_numpy().astype(float), C.col(b, "target").to_numpy()


def balance(sources: DataFrame, most: float = MAX_REPEAT, slack: float = SLACK, goals: list[float] | None = None, rounds: int = 100, tolerance: float = 1e-9) -> np.ndarray:
    """The classes' multipliers. sources: tokens (by class), size, target. goals: tokens by class; else all classes keep their shares."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, bent, have, wanted = np.zeros(CLASSES), np.zeros((CLASSES, CLASSES)), np.zeros(CLASSES), 0.0
        for b in batches:
            tokens, size, target = _columns(b)
            live = _live(target, size, most)
            tokens, target = tokens[live], target[live]
            rate, free = solve(tokens, target, mu, most)
            taken = tokens * rate
            mobile = taken * free
            got += taken.sum(0)
            bent += np.diag(mobile.sum(0)) - (mobile / np.maximum(mobile.sum(1), 1e-300)[:, None]).T @ mobile
            have += tokens.sum(0)
            wanted += target.sum()
        yield pa.RecordBatch.from_arrays([pa.array([x.tolist()], pa.list_(pa.float64())) for x in (got, bent.ravel(), have, np.array([wanted]))], ["got", "bent", "have", "wanted"])

    mu, step = np.zeros(CLASSES), np.zeros(CLASSES)
    best = np.inf
    for _ in range(rounds):
        parts = sources.select("tokens", "size", "target").mapInArrow(sums, "got array<double>, bent array<double>, have array<double>, wanted array<double>").collect()  # a row for each task
        got, bent, have, wanted = (sum((np.array(r[k]) for r in parts), np.zeros(n)) for k, n in (("got", CLASSES), ("bent", CLASSES**2), ("have", CLASSES), ("wanted", 1)))
        if not wanted[0]:
            return np.zeros(CLASSES)
        goal = np.array(goals, float) if goals else wanted[0] * have / have.sum()
        gap = np.where(goal > 0, got - goal + slack * goal * mu, 0.0)
        size = float(np.abs(gap).max())
        if size <= tolerance * wanted[0]:
            break
        if size > best:  # too far: half of the last step back
            step /= 2
            mu = mu + step
            if np.abs(step).max() < 1e-12:
                break
            continue
        best = size
        h = bent.reshape(CLASSES, CLASSES) + np.diag(np.where(goal > 0, slack * goal, 1.0)) + np.eye(CLASSES) * 1e-12 * wanted[0]
        step = np.clip(np.linalg.solve(h, gap), -2, 2)
        mu = mu - step
    return mu


def rounded(t: pa.Table, most: float) -> pa.Table:
    """Of one source, from class, bin, tokens and each class's rate: the copies of all documents of a class, and the bin
    below which its documents get one more. What is over or missing is shared among the smaller classes by their words;
    a class takes what leaves them no more than they can make up for."""
    k, bin_, tokens, rates = (t[c].to_numpy() for c in ("class", "bin", "tokens", "rate"))
    classes = sorted(set(k.tolist()), reverse=True)
    words = np.stack([np.bincount(bin_[k == c], tokens[k == c], BINS) for c in classes])
    rate = np.array([rates[k == c][0] for c in classes])
    rate = np.where(np.abs(rate - np.round(rate)) < 1e-9, np.round(rate), rate)
    base = np.minimum(rate, most).astype(np.int64)
    all_ = words.sum(1)
    room = np.where((base < most) & (rate > 0), all_, 0.0)  # what one more copy of each would take
    below, carry = np.zeros(len(classes), np.int64), 0.0
    for i in range(len(classes)):
        due = all_[i] * (rate[i] - base[i])
        rest = room[i:].sum()
        if room[i]:
            sums = np.concatenate([[0], np.cumsum(words[i])])
            left = carry + due - sums  # carried on, for each choice
            least, greatest = -(all_ * (rate - base))[i + 1 :].sum(), (room - all_ * (rate - base))[i + 1 :].sum()
            lost = np.maximum(0, np.maximum(least - left, left - greatest))
            below[i] = np.lexsort((np.abs(due + carry * room[i] / rest - sums), lost))[0]
            carry = left[below[i]]
        else:
            carry += due
    return pa.table({"key": [t["key"][0].as_py()] * len(classes), "class": pa.array(classes, pa.int32()), "base": pa.array(base.astype(np.int32)), "below": pa.array(below.astype(np.int32)), "rate": pa.array(rate)})


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MAX_REPEAT) -> DataFrame:
    """key, class, base, below, rate, size and target (the source's) of each cell that docs has."""
    with C.Scratch(docs.sparkSession) as s:
        sized = docs.select(_key().alias("key"), "doc_id", word_count().alias("size")).select("key", "size", _class(F.col("size")).alias("class"), _bin().alias("bin"))
        bins = s.table(sized.groupBy("key", "class", "bin").agg(F.sum("size").alias("tokens")), "mix-bins")
        s.sized(bins.count())
        by_class = [F.coalesce(F.sum(F.when(F.col("class") == k, F.col("tokens"))), F.lit(0).cast("long")) for k in range(CLASSES)]
        sources = source_targets(bins.groupBy("key").agg(F.array(*by_class).alias("tokens")), weights, most, s)
        mu = balance(sources, most)

        def rates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                tokens, size, target = _columns(b)
                live = _live(target, size, most)
                rate = np.where(target > 0, most, 0.0)[:, None] * np.ones((1, CLASSES))
                rate[live] = solve(tokens[live], target[live], mu, most)[0]
                yield pa.RecordBatch.from_arrays([C.col(b, "key"), pa.array(rate.tolist(), pa.list_(pa.float64()))], ["key", "rates"])

        solved = s.light(sources.mapInArrow(rates, "key string, rates array<double>"), "mix-rates")
        rated = bins.join(C.small(solved), "key").select("key", "class", "bin", "tokens", F.element_at("rates", F.col("class") + 1).alias("rate"))
        cells = rated.groupBy("key").applyInArrow(lambda t: rounded(t, most), "key string, class int, base int, below int, rate double")
        return s.kept(cells.join(C.small(sources.select("key", "size", "target")), "key"), "mix-plan")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MAX_REPEAT) -> DataFrame:
    """docs with NAMES: size, the source's size and target, the solved rate, copies. Sources by code point, null last, weigh `weights` in turn."""
    names = docs.columns
    size, *told = C.fresh(names, *NAMES)
    key, class_, bin_, *inner = C.fresh([*names, size, *told], "_key", "_class", "_bin", "_k", "_c", "_base", "_below")
    cells = plan(docs, weights, most)
    cells = cells.select(F.col("key").alias(inner[0]), F.col("class").alias(inner[1]), F.col("base").alias(inner[2]), F.col("below").alias(inner[3]), F.col("size").alias(told[0]), F.col("target").alias(told[1]), F.col("rate").alias(told[2]))
    sized = docs.withColumn(size, word_count()).withColumns({key: _key(), class_: _class(F.col(size)), bin_: _bin()})
    both = sized.join(C.small(cells), (F.col(key) == F.col(inner[0])) & (F.col(class_) == F.col(inner[1])))
    copies = F.col(inner[2]) + (F.col(bin_) < F.col(inner[3])).cast("int")
    return both.select(*(F.col(f"`{c}`") for c in names), size, *told[:3], copies.alias(told[3]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"), F.col("_copies").alias("copies"), F.col("_rate").alias("rate"))


def mixed(docs: DataFrame) -> DataFrame:
    """Each document as many times as the mix takes it, with `copy` (or a name like it that docs doesn't have) from 1."""
    *_, copies = C.fresh(docs.columns, *NAMES)
    (copy,) = C.fresh([*docs.columns, *NAMES], "copy")
    return mix(docs).where(F.col(copies) > 0).select(*(F.col(f"`{c}`") for c in docs.columns), F.explode(F.sequence(F.lit(1), F.col(copies))).alias(copy))
