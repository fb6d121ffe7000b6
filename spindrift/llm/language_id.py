"""Language identification: multinomial naive Bayes over hashed character bigrams and trigrams.

The classifier is fitted on at most DOCS_PER_LANGUAGE labelled rows of each language (a documented bound; the
rows with the smallest hashes of doc_id). Training tasks count n-grams into vectors of 2**BITS cells, which are
summed by language in slices, so nothing but languages x 2**BITS numbers reaches the driver. The log-probability
matrix is broadcast in blocks of LANGUAGES_AT_ONCE languages (2**16 x 256 x 4 bytes: 64 MB; 1 MB for 4 languages), and
every whole text is scored in numpy by gathering rows of it; with more languages, each block is a pass that goes on
with the best language so far and the sum of the odds, so any number of languages gives exact results.

A text's n-grams and its score depend on the text alone, not on the rows beside it.

Defined results: a null text, an empty one or one without a letter (Unicode category L) is `und` with score 0; if no
labelled row can be learned from, every text is `und`. Ties go to the language that sorts first. Repeated rows are
scored each. A null doc_id is scored too and is never learned from. Columns other than doc_id, text and lang aren't
read; in predict(), a kept column named as a result stays, and the result's name gets one more underscore.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

QUERY, SQL = "op3_language_id", None
BITS = 16
DOCS_PER_LANGUAGE = 4000
LANGUAGES_AT_ONCE = 256
SLICES = 16
#: Evidence counts as from this many n-grams at most, so that the score of a mixed text stays below 1.
EVIDENCE = 200
SMOOTH = 0.5
BLANK = np.uint32(32)


def has_letter(text: str | None) -> bool:
    """Whether a character is of Unicode's category L (str.isalpha)."""
    return any(map(str.isalpha, text or ""))


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the bigrams and trigrams of each text between blanks; and where each text's begin, with the end."""
    padded = [f" {(t or '').lower()} " for t in texts]
    at = np.concatenate([[0], np.cumsum([len(p) for p in padded])]).astype(np.int64)
    c = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(c):
        return np.zeros(0, np.uint32), at
    after, then = np.append(c[1:], BLANK), np.append(c[2:], [BLANK, BLANK]).astype(np.uint32)
    after[at[1:] - 1] = then[at[1:] - 1] = then[at[1:] - 2] = BLANK  # what follows a text's end is blank, not the next text
    two = c * np.uint32(0x9E3779B1) + after * np.uint32(0x85EBCA77)
    three = two + then * np.uint32(0xC2B2AE3D)
    shift = np.uint32(32 - BITS)
    both = np.empty((len(two), 2), np.uint32)
    both[:, 0] = (two ^ (two >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> shift
    both[:, 1] = (three ^ (three >> np.uint32(15))) * np.uint32(0x297A2D39) >> shift
    return both.reshape(-1), at


def fit(docs: DataFrame, label: str = "lang", train: str | None = None, docs_per_language: int = DOCS_PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """The languages and the matrix of log-probabilities, a row for each cell. `train`: SQL for the rows to learn from."""
    known = docs.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    if train:
        known = known.where(train)
    known = known.select("doc_id", "text", F.col(label).alias("lang"))
    sizes = known.groupBy("lang").count().collect()  # a row for each language
    if not sizes:
        return [], np.zeros((1 << BITS, 0), np.float32)
    names = sorted(r["lang"] for r in sizes)
    order = {n: i for i, n in enumerate(names)}
    rates = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, docs_per_language / r["count"])) for r in sizes], "lang string, rate double")
    known = known.join(F.broadcast(rates), "lang")
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("rate") * (1 << 20)).select("text", "lang")
    width = (1 << BITS) // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for b in C.pieces(batches):
            cells, at = grams(C.col(b, "text").to_pylist())
            langs = np.array([order[x] for x in C.col(b, "lang").to_pylist()])
            of = np.repeat(langs, np.diff(at))
            for k in np.unique(langs):
                sums[k] = sums.get(k, 0) + np.bincount(cells.reshape(-1, 2)[of == k].ravel(), minlength=1 << BITS)
        keys = [(k, s) for k in sums for s in range(SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.int32()), pa.array([s for _, s in keys], pa.int32()), C.blobs([sums[k][s * width : (s + 1) * width].astype(np.int64).tobytes() for k, s in keys])], ["k", "s", "v"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v, np.int64) for v in t["v"].to_pylist())
        return pa.table({"k": t["k"][:1], "s": t["s"][:1], "v": C.blobs([total.tobytes()])})

    found = chosen.mapInArrow(count, "k int, s int, v binary").groupBy("k", "s").applyInArrow(add, "k int, s int, v binary")
    logs = np.zeros((1 << BITS, len(names)), np.float32)
    counts = np.zeros((1 << BITS, len(names)))
    for r in found.toLocalIterator():
        counts[r["s"] * width : (r["s"] + 1) * width, r["k"]] = np.frombuffer(r["v"], np.int64)
    logs[:] = np.log((counts + SMOOTH) / (counts.sum(0) + SMOOTH * (1 << BITS)))
    return names, logs


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str]) -> DataFrame:
    """The columns `keep` of every row, then lang_pred and score."""
    names, matrix = model
    pred, score, top, odds, texts = C.fresh(keep, "lang_pred", "score", "top", "odds", "whole")
    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    df = docs.select(*(F.col(f"`{c}`") for c in keep), F.col("text").alias(texts))
    starts = list(range(0, len(names), LANGUAGES_AT_ONCE)) or [0]
    for i in starts:
        own = names[i : i + LANGUAGES_AT_ONCE]
        shared = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(matrix[:, i : i + LANGUAGES_AT_ONCE].T))
        first, last = i == starts[0], i == starts[-1]

        def go_on(batches: Iterator[pa.RecordBatch], own=own, shared=shared, first=first, last=last) -> Iterator[pa.RecordBatch]:
            weights = shared.value
            for b in C.pieces(batches, texts):
                whole = C.col(b, texts)
                said, high, rest = (["und"] * b.num_rows, np.full(b.num_rows, -np.inf), np.zeros(b.num_rows)) if first else (C.col(b, pred).to_pylist(), C.col(b, top).to_numpy(), C.col(b, odds).to_numpy())
                if own:
                    said, high, rest = _better(whole.to_pylist(), own, weights, said, high, rest)
                if last:
                    told = np.array([has_letter(t) for t in whole.to_pylist()], bool) & (rest > 0)
                    said = [p if g else "und" for p, g in zip(said, told, strict=True)]
                    new = [pa.array(said, pa.string()), pa.array(np.where(told, 1 / np.maximum(rest, 1.0), 0.0))]
                    yield pa.RecordBatch.from_arrays([*(C.col(b, c) for c in keep), *new], [*keep, pred, score])
                else:
                    yield pa.RecordBatch.from_arrays([*(C.col(b, c) for c in keep), whole, pa.array(said, pa.string()), pa.array(high), pa.array(rest)], [*keep, texts, pred, top, odds])

        df = df.mapInArrow(go_on, kept + (f", `{pred}` string, `{score}` double" if last else f", `{texts}` string, `{pred}` string, `{top}` double, `{odds}` double"))
    return df


def _better(texts: list[str | None], names: list[str], weights: np.ndarray, said: list[str], high: np.ndarray, rest: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The best language, its log-likelihood and the sum of all odds against it, gone on with these languages."""
    cells, at = grams(texts)
    sums = np.stack([np.add.reduceat(w[cells], 2 * at[:-1], dtype=np.float64) for w in weights], 1)
    many = (2 * np.diff(at))[:, None]
    logs = sums / many * np.minimum(many, EVIDENCE)
    best = logs.argmax(1)
    own = logs[np.arange(len(best)), best]
    now = np.maximum(high, own)
    rest = rest * np.exp(high - now) + np.exp(logs - now[:, None]).sum(1)
    return [h if was >= new else names[k] for h, was, new, k in zip(said, high, own, best, strict=True)], now, rest


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(C.remainder("doc_id", 4) == 2, F.lit(False)))
    return predict(docs, fit(docs, train="not held_out"), ["doc_id", "held_out"])


def keep_known(docs: DataFrame, least: float = 0.5, languages: list[str] | None = None) -> DataFrame:
    """Rows whose language is told (not `und`) with a score of `least` or more, and is one of `languages` if given."""
    names = docs.columns
    scored = predict(docs, fit(docs), names)
    pred, score = scored.columns[len(names) :]
    good = (F.col(f"`{pred}`") != "und") & (F.col(f"`{score}`") >= least)
    return scored.where(good & F.col(f"`{pred}`").isin(languages) if languages else good).select(*(F.col(f"`{c}`") for c in names))
