"""Toxicity by multiple-instance learning: a document is toxic if any of its sentences is (noisy-or).

A sentence's probability is a logistic function of hashed words; the document's is 1 - prod(1 - p). Only document
labels are known; the gradient of the document likelihood shares itself among the sentences. The classifier is
fitted on about TRAIN_PER_CLASS rows or TRAIN_BYTES of text of each label, whichever is less (documented bounds, smallest
hashes of doc_id), weighted back to the true shares; their hashed features are gathered in one task (bounded by both),
which returns 2**BITS weights (1 MB, broadcast). Every whole text is scored, and every sentence at THRESHOLD or more is returned.

Defined results: a null or empty text has no sentence and gets the score of the bias alone; ties and repeated rows
are scored each; labels with a null doc_id or null toxic are ignored; with labels of one class or none, the score is
the share of label 1 (0 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

QUERY, SQL = "op6_toxicity", None
BITS = 18
TRAIN_PER_CLASS, TRAIN_BYTES = 10_000, 32 << 20
ROUNDS, RATE, RIDGE = 80, 0.2, 1e-5
#: A word takes part if its share of label 1 differs from the mean by so many standard errors; else its weight is 0.
#: A sentence without such a word has probability 0, and the bias stands for the whole document (the leak of noisy-or).
TELLING = 4.5
#: Ids of about so many chosen rows are broadcast.
MAX_BROADCAST = 1_000_000
MASK = (1 << BITS) - 1
THRESHOLD = 0.3
#: Letters, digits and bytes beyond ASCII make words; . ! ? and newlines end sentences.
GAP = np.ones(256, bool)
GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
ENDS = np.zeros(256, bool)
ENDS[[ord("."), ord("!"), ord("?"), 10]] = True


def features(texts: pa.Array) -> tuple[C.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words; each one's cell; the first word of each sentence; the document of each sentence."""
    w = C.words(texts, GAP, C.LOWER)
    cells = (w.hash >> C.U(64 - BITS)).astype(np.int64)
    stops = np.flatnonzero(ENDS[w.buf])
    sentence = np.searchsorted(stops, w.start)
    new = np.ones(len(w.start), bool)
    new[1:] = sentence[1:] != sentence[:-1]
    first = np.flatnonzero(new)
    return w, cells, first, w.doc[first]


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, first) if len(first) else np.zeros(0)


def learn(cells: list[np.ndarray], per_sentence: list[np.ndarray], labels: np.ndarray, share: float) -> np.ndarray:
    """Weights and, last, the bias, by full-batch Adagrad on the noisy-or likelihood. share: of label 1 in all labelled rows."""
    x = np.concatenate([*cells, np.zeros(0, np.int64)]).astype(np.int64)
    lens = np.concatenate([*per_sentence, np.zeros(0, np.int64)]).astype(np.int64)
    n_sentences = np.array([len(p) for p in per_sentence])
    doc = np.repeat(np.arange(len(labels)), n_sentences)
    y = labels.astype(float)
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    pairs = np.unique((np.repeat(doc, lens) << BITS) | x) if len(x) else np.zeros(0, np.int64)
    of = y[pairs >> BITS] == 1
    pos = np.bincount(pairs[of] & MASK, minlength=1 << BITS).astype(float)
    neg = np.bincount(pairs[~of] & MASK, minlength=1 << BITS).astype(float)
    mean = max(y.mean(), 1e-9)
    told = (pos - (pos + neg) * mean) / np.sqrt(np.maximum((pos + neg) * mean * (1 - mean), 1e-9))
    used = (np.abs(told) >= TELLING) & (pos + neg >= 4)
    w = np.where(used, np.clip(np.log((pos + 0.5) / (y.sum() + 1)) - np.log((neg + 0.5) / (len(y) - y.sum() + 1)), -3, 3), 0.0)
    bias = -5.0
    g2, b2 = np.full(1 << BITS, 1e-8), 1e-8
    live = used[x]
    x, sentence = x[live], np.repeat(np.arange(len(lens)), lens)[live]
    told_of = np.bincount(sentence, minlength=len(lens)) > 0
    for _ in range(ROUNDS):
        z = np.bincount(sentence, w[x], len(lens)) + bias
        p = told_of / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.exp(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), len(y)) + np.log1p(-1 / (1 + np.exp(-bias))))
        any_ = np.clip(1 - none, 1e-9, 1)
        d = weight * np.where(y == 1, none / any_, -1.0)
        dz = d[doc] * p
        g = (np.bincount(x, dz[sentence], 1 << BITS) / len(y) - RIDGE * w) * used
        gb = (dz.sum() + (d * (1 / (1 + np.exp(-bias)))).sum()) / len(y)
        g2 += g * g
        b2 += gb * gb
        w += RATE * g / np.sqrt(g2)
        bias += 0.1 * gb / np.sqrt(b2)
    return np.append(w, bias)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS, most_bytes: int = TRAIN_BYTES) -> np.ndarray:
    """labels: doc_id and toxic, the rows to learn from."""
    labels = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    labels = labels.where("toxic in (0, 1)")
    sizes = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    total = sum(sizes.values())
    share = sizes.get(1, 0) / total if total else 0.0
    flat = np.append(np.zeros(1 << BITS), np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    if share in (0.0, 1.0):
        return flat
    there = docs.select("doc_id", F.octet_length("text").cast("long").alias("bytes")).join(labels, "doc_id").groupBy("toxic").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    rates = {r["toxic"]: min(1.0, per_class / max(r["n"], 1), most_bytes / max(r["bytes"] or 1, 1)) for r in there.collect()}
    rate = F.when(F.col("toxic") == 1, rates.get(1, 1.0)).otherwise(rates.get(0, 1.0))
    ids = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < rate * (1 << 20))
    few = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id") if total * max(rates.values(), default=0.0) <= MAX_BROADCAST else docs.select("doc_id", "text").join(ids, "doc_id")

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.pieces(batches):
            w, cells, first, doc = features(C.col(b, "text"))
            lens = np.diff(np.append(first, len(cells)))
            words_at = np.concatenate([[0], np.cumsum(w.per_doc)])
            sent_at = np.searchsorted(doc, np.arange(b.num_rows + 1))
            yield pa.RecordBatch.from_arrays([
                C.col(b, "doc_id"), C.col(b, "toxic"),
                C.blobs([cells[words_at[i] : words_at[i + 1]].astype(np.int32).tobytes() for i in range(b.num_rows)]),
                C.blobs([lens[sent_at[i] : sent_at[i + 1]].astype(np.int32).tobytes() for i in range(b.num_rows)]),
            ], ["doc_id", "toxic", "cells", "lens"])

    def train(t: pa.Table) -> pa.Table:
        t = t.sort_by("doc_id")
        load = lambda name: [np.frombuffer(v, np.int32) for v in t[name].to_pylist()]
        model = learn(load("cells"), load("lens"), t["toxic"].to_numpy(), share)
        return pa.table({"model": C.blobs([model.tobytes()])})

    packed = few.mapInArrow(prepare, "doc_id long, toxic int, cells binary, lens binary")
    rows = packed.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(train, "model binary").collect()
    return np.frombuffer(rows[0]["model"]) if rows else flat


def score(docs: DataFrame, model: np.ndarray, keep: list[str]) -> DataFrame:
    """The columns `keep`, score, the byte span and probability of the likeliest sentence, and those of all at THRESHOLD or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "score double, worst_start long, worst_end long, worst_score double, toxic_sentences array<struct<start: long, end: long, score: double>>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w_all = shared.value
        weights, bias = w_all[:-1], w_all[-1]
        base = 1 / (1 + np.exp(-bias))
        for b in C.pieces(batches):
            w, cells, first, doc = features(C.col(b, "text"))
            lens = np.diff(np.append(first, len(cells)))
            z = _sums(weights[cells], first) + bias
            p = (_sums((weights[cells] != 0).astype(np.int64), first) > 0) / (1 + np.exp(-np.clip(z, -30, 30)))
            logs = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), b.num_rows)
            total = 1 - np.exp(logs) * (1 - base)
            start, end, worst = np.full(b.num_rows, -1), np.full(b.num_rows, -1), np.full(b.num_rows, base)
            if len(p):
                order = np.lexsort((np.arange(len(p)), -p, doc))
                top = order[np.append(True, np.diff(doc[order]) > 0)]
                at = w.at[doc[top]]
                start[doc[top]], end[doc[top]], worst[doc[top]] = w.start[first[top]] - at, w.end[first[top] + lens[top] - 1] - at, p[top]
            found = np.flatnonzero(p >= THRESHOLD)
            at = w.at[doc[found]]
            spans = pa.StructArray.from_arrays([pa.array(w.start[first[found]] - at), pa.array(w.end[first[found] + lens[found] - 1] - at), pa.array(p[found])], ["start", "end", "score"])
            listed = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[found], np.arange(b.num_rows + 1)).astype(np.int32)), spans)
            yield pa.RecordBatch.from_arrays([*(C.col(b, c) for c in keep), pa.array(total), pa.array(start), pa.array(end), pa.array(worst), listed], [*keep, "score", "worst_start", "worst_end", "worst_score", "toxic_sentences"])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", F.coalesce(C.remainder("doc_id", 4) == 2, F.lit(False)))
    labels = C.table(spark, sf_dir, "labels").select("doc_id", "toxic").where(C.remainder("doc_id", 4) != 2)
    return score(docs, fit(docs, labels), ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
