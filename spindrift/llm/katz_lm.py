"""A bigram language model with Katz backoff, counted and evaluated over the whole corpus.

Counts are discounted by Good-Turing (r <= CUTOFF); what that frees goes to unseen words through backoff weights that
make each history's distribution sum to 1 exactly, over the V training tokens and one unknown. Evaluation recurses per
token: bigram, else weight times unigram, else the unknown's share.

Tasks read the texts once, where they lie, into parts of about PART_TOKENS tokens: a row each, with the part's distinct
words (sorted 64-bit hashes) and its tokens as places among them, written as a table; later steps read this instead of
texts. A part sends its words with its own counts, by hash range, as packed sorted runs, and gets back the corpus's
counts and an id for each word that training texts have; then its distinct bigrams of such words, by range of the
history's id, and gets back their counts and what the backoff weights of its histories are made of. The number of ranges
follows the number of tokens alone. Each exchange's result is a written table, partitioned by range, with the model's
rows beside the answers; so a lost executor never starts the count again, and save() keeps the model: score() with it
evaluates other texts by the same exchanges, its rows joined in as one more part.

A range is merged in one task; nothing but count-of-count statistics (a few numbers) reaches the driver.

Defined results: null and empty texts are one end token; no training documents: unigrams are all unknown, score is 0;
repeated rows are counted and scored each; a null doc_id counts as training; other columns aren't read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .packing import cuts, pack, pack_floats, pack_sorted, unpack, unpack_floats, unpack_sorted

QUERY, SQL = "op9_katz_lm", None
U = C.U
#: Tokens that a part has, unless one text has more, and that a range has at about the most.
PART_TOKENS, RANGE_TOKENS = 2_000_000, 2_000_000
CUTOFF = 5
END = U(0x5BD1E9955BD1E995)
#: Ids of what begins a text and of all words that no training text has; others follow.
START, UNKNOWN, FIRST = 0, 1, 2
MODEL = -1  # the part that a model's rows count as


def discounts(n: np.ndarray) -> np.ndarray:
    """d[r] for r = 0 .. CUTOFF from the numbers n[1 .. CUTOFF + 1] of types seen r times; absolute discounts where
    Good-Turing's are out of range."""
    d = np.ones(CUTOFF + 1)
    flat = (n[CUTOFF + 1] * (CUTOFF + 1)) / n[1] if n[1] else 1.0
    for r in range(1, CUTOFF + 1):
        star = (r + 1) * n[r + 1] / n[r] if n[r] else 0.0
        d[r] = (star / r - flat) / (1 - flat) if flat != 1 else 0.0
        if not 0.05 < d[r] < 1:
            d[r] = (r - 0.5) / r
    return d


class Unigrams:
    """Discounted unigram probabilities by count. stats: tokens, types, then types seen 0 .. CUTOFF + 1 times."""

    def __init__(self, stats: np.ndarray):
        self.n, self.v = float(stats[0]), float(stats[1])
        self.d = discounts(stats[2:])
        lost = sum(stats[2 + r] * r * (1 - self.d[r]) for r in range(1, CUTOFF + 1))
        self.norm = self.n if lost > 0 else self.n + 1
        self.unknown = (lost if lost > 0 else 1.0) / self.norm if self.n else 1.0

    def p(self, count: np.ndarray) -> np.ndarray:
        c = count.astype(float)
        return np.where(c > 0, discounted(c, self.d) / max(self.norm, 1), self.unknown)


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return c * np.where(c <= CUTOFF, d[np.minimum(c, CUTOFF).astype(np.int64)], 1.0)


def count_stats(c: np.ndarray) -> np.ndarray:
    return np.concatenate([[c.sum(), (c > 0).sum()], np.bincount(np.minimum(c, CUTOFF + 2).astype(np.int64), minlength=CUTOFF + 3)[: CUTOFF + 2]])


def read(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, train) as parts: pid, doc_id (a list), train, sizes (tokens of each document, its end among
    them), words (sorted hashes), counts (of training tokens) and tokens (places among the words)."""
    names = ["pid", "doc_id", "train", "sizes", "words", "counts", "tokens"]

    def part(pid: int, have: list[tuple[list, np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ids, train, sizes, h = ([x for ids, *_ in have for x in ids], *(np.concatenate([x[k] for x in have]) for k in (1, 2, 3)))
        words, tokens = np.unique(h, return_inverse=True)
        counts = np.bincount(tokens[np.repeat(train, sizes)], minlength=len(words))
        often = np.argsort(-np.bincount(tokens, minlength=len(words)), kind="stable")  # frequent words get small numbers, which pack better
        rank = np.empty(len(words), np.int64)
        rank[often] = np.arange(len(words))
        blobs = [train, sizes, None, counts, rank[tokens], rank]
        packed = [pack(b) if b is not None else pack_sorted(words) for b in blobs]
        return pa.RecordBatch.from_arrays([pa.array([pid]), pa.array([ids], pa.list_(pa.int64())), *(C.blobs([b]) for b in packed), pa.array([len(h)])], [*names, "ranks", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, have, n = TaskContext.get().partitionId() << 32, [], 0
        for b in C.pieces(batches):
            w = C.words(C.col(b, "text"))
            at = np.cumsum(w.per_doc + 1)
            h = np.full(int(at[-1]), END, U)
            inner = np.ones(len(h), bool)
            inner[at - 1] = False
            h[inner] = w.hash
            have.append((C.col(b, "doc_id").to_pylist(), np.array(C.col(b, "train").to_pylist(), bool), w.per_doc + 1, h))
            n += len(h)
            if n >= PART_TOKENS:
                yield part(pid, have)
                pid, have, n = pid + 1, [], 0
                C.trim()
        if have:
            yield part(pid, have)

    return docs.select("doc_id", "text", "train").mapInArrow(run, "pid long, doc_id array<long>, train binary, sizes binary, words binary, counts binary, tokens binary, ranks binary, n long")


class _Part:
    """A part with the corpus's ids and counts of its words. told: rows of the unigram table for it."""

    def __init__(self, row: dict, told: list[dict], width: int):
        self.ids = row["doc_id"]
        self.train_docs, self.sizes = unpack(row["train"]) > 0, unpack(row["sizes"]).astype(np.int64)
        told = sorted(told, key=lambda r: r["bucket"])
        rank = np.concatenate([*(unpack(r["a"]).astype(np.int64) for r in told), np.zeros(0, np.int64)])
        base = np.repeat([r["bucket"] * width for r in told], [len(unpack(r["a"])) for r in told]).astype(np.int64)
        count = np.concatenate([*(unpack(r["b"]).astype(np.int64) for r in told), np.zeros(0, np.int64)])
        id_ = np.where(rank > 0, base + rank - 1 + FIRST, UNKNOWN)
        # Distinct ids in order: the words that are unknown become one.
        self.id, place = np.unique(id_, return_inverse=True)
        self.count = np.zeros(len(self.id), np.int64)
        self.count[place] = count
        of_rank = np.empty(len(place), np.int64)
        of_rank[unpack(row["ranks"]).astype(np.int64)] = place
        self.word = of_rank[unpack(row["tokens"]).astype(np.int64)]
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.train = self.train_docs[self.doc]

    def bigrams(self) -> None:
        """history, follower: of the distinct bigrams, in order, the history's and the follower's places among ids (-1: the
        start); seen: their training counts; place: each token's bigram."""
        key = np.empty(len(self.word), np.int64)
        key[1:] = self.word[:-1] + 1
        key[np.cumsum(self.sizes) - self.sizes] = 0
        key = (key << 32) | self.word
        order = np.argsort(key)
        key = key[order]
        new = np.append(True, key[1:] != key[:-1])[: len(key)]
        at = np.flatnonzero(new)
        self.place = np.empty(len(order), np.int32)
        self.place[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
        self.seen = np.add.reduceat(self.train[order], at, dtype=np.int64) if len(at) else np.zeros(0, np.int64)
        self.history, self.follower = (key[at] >> 32) - 1, key[at] & 0xFFFFFFFF
        # Only histories and followers that training texts have can be in the table.
        self.history_id = np.where(self.history < 0, START, self.id[self.history] if len(self.id) else START)
        self.listed = self.history_id != UNKNOWN
        self.asked = self.listed & (self.id[self.follower] != UNKNOWN)

    def histories(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the listed histories in order; how many asked bigrams each has; each listed bigram's history among them."""
        ids, back = np.unique(self.history_id[self.listed], return_inverse=True)
        return ids, np.bincount(back[self.asked[self.listed]], minlength=len(ids)), back


def _added(table: DataFrame) -> tuple[np.ndarray, int]:
    """The sums of the ranges' statistics, and the most known entries that a range has."""
    sums = [F.coalesce(F.sum(F.col("stats")[i]), F.lit(0)) for i in range(CUTOFF + 4)]
    row = table.where("stats is not null").agg(F.array(*sums), F.coalesce(F.max(F.col("stats")[1]), F.lit(0))).first()
    return np.array(row[0]), max(1, int(row[1]))


def _stats(total: np.ndarray) -> list[int]:
    return count_stats(total).astype(np.int64).tolist()


@dataclass
class Model:
    """words: bucket, pid, a (sorted hashes), b (counts); pairs: the same of bigrams; and the number of ranges."""

    words: DataFrame
    pairs: DataFrame
    ranges: int

    def save(self, folder: str) -> None:
        """Tables partitioned by range."""
        for name, df in (("words", self.words), ("pairs", self.pairs)):
            df.withColumn("range", F.col("bucket")).write.partitionBy("range").mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")
        spark = self.words.sparkSession
        spark.createDataFrame([(json.dumps({"ranges": self.ranges}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder.rstrip('/')}/about")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> Model:
        read_ = lambda n: spark.read.parquet(f"{folder.rstrip('/')}/{n}").drop("range")
        return Model(read_("words"), read_("pairs"), json.loads(spark.read.text(f"{folder.rstrip('/')}/about").first()[0])["ranges"])


WORDS = "bucket int, pid long, a binary, b binary"
PAIRS = "bucket int, pid long, h binary, n binary, w binary, c binary, u binary"


def _sent_words(parts: DataFrame, ranges: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                words, counts = unpack_sorted(r["words"]), unpack(r["counts"])
                at = cuts(words, ranges)
                full = np.flatnonzero(np.diff(at))
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([r["pid"]] * len(full), pa.int64()), C.blobs([pack_sorted(words[at[k] : at[k + 1]]) for k in full]), C.blobs([pack(counts[at[k] : at[k + 1]]) for k in full])], ["bucket", "pid", "a", "b"])

    return parts.select("pid", "words", "counts").mapInArrow(run, WORDS)


def _merged_words(t: pa.Table) -> pa.Table:
    """For each part its words' ranks among the known ones (from 1; 0: unknown) and counts; and the known words, as the model's row."""
    C.trim()
    hs, cs = [unpack_sorted(x) for x in t["a"].to_pylist()], [unpack(x).astype(np.int64) for x in t["b"].to_pylist()]
    every = np.concatenate(hs)
    order = np.argsort(every)
    s = every[order]
    at = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    words, total = s[at], np.add.reduceat(np.concatenate(cs)[order], at)
    known = total > 0
    rank = np.cumsum(known) * known
    places = [np.searchsorted(words, h) for h, p in zip(hs, t["pid"].to_pylist(), strict=True) if p != MODEL]
    pids = [p for p in t["pid"].to_pylist() if p != MODEL]
    bucket = t["bucket"][0].as_py()
    return pa.table({
        "bucket": pa.array([bucket] * (len(pids) + 1), pa.int32()),
        "pid": pa.array([*pids, MODEL], pa.int64()),
        "a": C.blobs([*(pack(rank[x]) for x in places), pack_sorted(words[known])]),
        "b": C.blobs([*(pack(total[x]) for x in places), pack(total[known])]),
        "stats": pa.array([None] * len(pids) + [_stats(total)], pa.list_(pa.int64())),
    })


def _merged_pairs(t: pa.Table, uni: Unigrams) -> pa.Table:
    """For each part its bigrams' counts, and of each of its histories the count, how many followers were seen 1 .. CUTOFF
    times and all followers' share as unigrams; and the known bigrams, as the model's row."""
    C.trim()
    rows = t.to_pylist()
    hs, ns = [unpack_sorted(r["h"]).astype(np.int64) for r in rows], [unpack(r["n"]).astype(np.int64) for r in rows]
    w, c, u = (np.concatenate([unpack(r[k]) for r in rows]).astype(np.int64) for k in ("w", "c", "u"))
    histories = np.unique(np.concatenate(hs))
    spots = [np.searchsorted(histories, h) for h in hs]
    h = np.concatenate([np.repeat(x, n) for x, n in zip(spots, ns, strict=True)])
    order = np.lexsort((w, h))
    new = np.append(True, (h[order][1:] != h[order][:-1]) | (w[order][1:] != w[order][:-1]))[: len(h)]
    at = np.flatnonzero(new)
    total = np.add.reduceat(c[order], at) if len(at) else np.zeros(0, np.int64)
    row, words, unis = h[order][at], w[order][at], u[order][at]
    known = total > 0
    each = lambda mask: np.bincount(row[mask], minlength=len(histories))
    count = np.bincount(row, total, len(histories)).astype(np.int64)
    few = np.stack([each(total == r) for r in range(1, CUTOFF + 1)])
    low = np.bincount(row[known], uni.p(unis[known]), len(histories))
    mine = np.empty(len(h), np.int64)
    mine[order] = np.cumsum(new) - 1
    per = np.split(total[mine], np.cumsum([n.sum() for n in ns])[:-1])
    out = {k: [] for k in ("bucket", "pid", "h", "n", "w", "c", "u", "few", "low", "stats")}
    for r, x, p in zip(rows, spots, per, strict=True):
        if r["pid"] != MODEL:
            for k, v in zip(out, (r["bucket"], r["pid"], pack(count[x]), None, None, pack(p), None, pack(few[:, x].ravel()), pack_floats(low[x]), None), strict=True):
                out[k].append(v)
    there, many = np.unique(row[known], return_counts=True)
    for k, v in zip(out, (rows[0]["bucket"], MODEL, pack_sorted(histories[there]), pack(many), pack(words[known]), pack(total[known]), pack(unis[known]), None, None, _stats(total)), strict=True):
        out[k].append(v)
    kinds = [pa.int32(), pa.int64(), *(pa.binary(),) * 7, pa.list_(pa.int64())]
    return pa.table({k: pa.array(v, kind) for (k, v), kind in zip(out.items(), kinds, strict=True)})


def score(docs: DataFrame, model: Model | None = None, keep: str | None = None, range_tokens: int = RANGE_TOKENS) -> DataFrame:
    """docs: doc_id, text, train. Returns doc_id, train, n_tokens, n_known, train_tokens, base_score, score. With a model
    no text is learned from. keep: a folder for the model."""
    if model:
        docs = docs.withColumn("train", F.lit(False))
    with C.Scratch(docs.sparkSession) as s:
        parts = s.table(read(docs), "katz-parts")
        ranges = model.ranges if model else C.sized_partitions(parts.agg(F.sum("n")).first()[0] or 0, range_tokens)
        sent = _sent_words(parts, ranges)
        sent = sent.unionByName(model.words) if model else sent
        words = s.table(sent.groupBy("bucket").applyInArrow(_merged_words, WORDS + ", stats array<long>"), "katz-words")
        totals, width = _added(words)
        uni = Unigrams(totals)
        span = ranges * width + FIRST  # ids are less
        none = F.lit(None).cast("binary")
        about_words = words.where(F.col("pid") != MODEL).select("pid", "bucket", "a", "b", *(none.alias(k) for k in ("h", "c", "few", "low")))

        def pairs_out(t: pa.Table, told: pa.Table) -> pa.Table:
            C.trim()
            out = {k: [] for k in ("bucket", "pid", "h", "n", "w", "c", "u")}
            for r in t.to_pylist():
                p = _Part(r, told.to_pylist(), width)
                p.bigrams()
                ids, many, _ = p.histories()
                bucket = ids * ranges // span
                edge = np.searchsorted(bucket, np.arange(ranges + 1))
                ends = np.concatenate([[0], np.cumsum(many)])
                w, c = p.follower[p.asked], p.seen[p.asked]
                for b in np.flatnonzero(np.diff(edge)):
                    i, j = edge[b], edge[b + 1]
                    x = slice(ends[i], ends[j])
                    for k, v in zip(out, (b, r["pid"], pack_sorted(ids[i:j]), pack(many[i:j]), pack(p.id[w[x]]), pack(c[x]), pack(p.count[w[x]])), strict=True):
                        out[k].append(v)
            return pa.table({"bucket": pa.array(out["bucket"], pa.int32()), "pid": pa.array(out["pid"], pa.int64()), **{k: C.blobs(out[k]) for k in ("h", "n", "w", "c", "u")}})

        sent = parts.groupBy("pid").cogroup(about_words.groupBy("pid")).applyInArrow(pairs_out, PAIRS)
        sent = sent.unionByName(model.pairs) if model else sent
        pairs = s.table(sent.groupBy("bucket").applyInArrow(lambda t: _merged_pairs(t, uni), PAIRS + ", few binary, low binary, stats array<long>"), "katz-pairs")
        d = discounts(_added(pairs)[0][2:])
        about_pairs = pairs.where(F.col("pid") != MODEL).select("pid", "bucket", none.alias("a"), none.alias("b"), "h", "c", "few", "low")

        def evaluate(t: pa.Table, told: pa.Table) -> pa.Table:
            C.trim()
            rows = told.to_pylist()
            r = t.to_pylist()[0]
            p = _Part(r, [x for x in rows if x["h"] is None], width)
            p.bigrams()
            ids, _, back = p.histories()
            rows = sorted((x for x in rows if x["h"] is not None), key=lambda x: x["bucket"])
            whole = lambda k, f: np.concatenate([*(f(x[k]) for x in rows), np.zeros(0, np.float64)])
            count, low = whole("h", unpack).astype(float), whole("low", unpack_floats)
            few = np.concatenate([np.zeros((CUTOFF, 0)), *(unpack(x["few"]).reshape(CUTOFF, -1).astype(float) for x in rows)], 1)
            held = count - (few * (np.arange(1, CUTOFF + 1) * (1 - d[1:]))[:, None]).sum(0)
            norm, alpha = weights(count, held, low)
            c = np.zeros(len(p.follower))
            c[p.asked] = whole("c", unpack)
            n, a = np.ones(len(c)), np.ones(len(c))  # an unknown history has weight 1
            n[p.listed], a[p.listed] = norm[back], alpha[back]
            logs = np.log10(np.where(c > 0, discounted(c, d) / n, a * uni.p(p.count[p.follower])))[p.place]
            c1 = p.count[p.word]
            total = lambda x: np.bincount(p.doc, x, len(p.ids))
            done = [pa.array(p.ids, pa.int64()), pa.array(p.train_docs), total(None).astype(np.int64), total(c1 > 0).astype(np.int64), np.full(len(p.ids), int(uni.n)), total(np.log10((c1 + 1) / (uni.n + uni.v + 1))), total(logs)]
            return pa.table(dict(zip(["doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"], done, strict=True)))

        told = about_words.unionByName(about_pairs)
        done = parts.groupBy("pid").cogroup(told.groupBy("pid")).applyInArrow(evaluate, "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
        if keep:
            Model(words.where(F.col("pid") == MODEL).drop("stats"), pairs.where(F.col("pid") == MODEL).drop("few", "low", "stats"), ranges).save(keep)
        return C.materialize(done, "katz-scores")


def weights(count: np.ndarray, held: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For histories with these counts, discounted counts and unigram shares of what was seen: what seen discounted
    counts are divided by, and the backoff weight. Both parts sum to 1."""
    norm = np.where(count > 0, count, 1.0)
    left = 1 - held / norm
    short = (count > 0) & (left < 1e-9)
    norm = np.where(short, held + 1, norm)
    left = 1 - held / norm
    rest = 1 - low
    whole = (count > 0) & (rest < 1e-12)
    norm = np.where(whole, np.maximum(held, 1e-300), norm)
    return norm, np.where(count > 0, np.where(whole, 0.0, left / np.maximum(rest, 1e-12)), 1.0)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("train", F.coalesce(C.remainder("doc_id", 7) != 2, F.lit(True)))
    return score(docs).select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
