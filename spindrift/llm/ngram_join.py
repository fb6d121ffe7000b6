"""N-gram Jaccard self-join by several global token orders, down to connected components.

A document's set holds its distinct n-word shingles (64-bit hashes; ASCII case is folded). Under any global order of
the tokens, two sets whose Jaccard similarity is t or more share one of the first |x| - ceil(t |x|) + 1 tokens of
each, so candidates must share a prefix token under each of ORDERS different orders:

* order 0 puts tokens with a small document frequency first. Frequencies are counted over all documents: parts of about
  PART_BYTES of text send their distinct tokens as packed sorted runs, by range of the hash, and get each token's
  frequency back. A token of one document can't make a candidate, so only the others leave the parts.
* the others are orders of independent hashes. Their prefixes intersect the candidates of order 0 before sets are read.

Equal sets are one class, linked through its smallest doc_id. Candidates aren't all pairs of a token's documents:
first each document meets the token's smallest one, links are joined into components, and then only pairs in
different components are left. If these are still many, documents with rare hashes act as centres, level by level,
until each pair has been met or lies in one component. No pair is dropped. Verification counts the intersection
of the two whole sets (tokens of 48 bits).

Defined results: a null, empty or blank text has an empty set and links with nothing; with fewer words than n the
whole sequence is the one shingle; a null doc_id gets a null component; repeated rows are returned as often (a doc_id
names one document: rows that repeat it are taken to repeat its text). Only doc_id and text are read, so other columns
can't clash. Written tables of a call are deleted when it returns, but for the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .components import components
from .packing import cuts, pack, pack_sorted, unpack, unpack_sorted

QUERY = "op7_ngram_jaccard_join"
ORDERS = 3
#: Bytes of text whose tokens one task holds at once, unless one document is longer.
PART_BYTES = 8 << 20
#: Bytes of text for each task that writes a light table.
LIGHT_BYTES = 32 << 20
#: Pairs in different components that are met at once, for each entry of the token lists; else centres go first.
PAIRS_PER_ENTRY = 2
U = C.U


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's shingles, one text after the other; and where each text's begin."""
    w = C.words(texts)
    h = w.hash
    at = np.concatenate([[0], np.cumsum(w.per_doc)])
    acc = h[: max(0, len(h) - n + 1)] if n > 1 else h
    for k in range(1, n):
        acc = C.mix(acc * U(0x9FB21C651E98DF25) + h[k : k + len(acc)])
    out, sizes = [], np.zeros(len(w.per_doc), np.int64)
    for i, m in enumerate(w.per_doc):
        a = at[i]
        if m >= n:
            s = np.sort(acc[a : a + m - n + 1])
            s = s[np.append(True, s[1:] != s[:-1])]
        elif m:
            x = h[a : a + 1]
            for k in range(1, m):
                x = C.mix(x * U(0x9FB21C651E98DF25) + h[a + k])
            s = x ^ U(int(m) * 0x94D049BB)
        else:
            continue
        out.append(s)
        sizes[i] = len(s)
    return (np.concatenate(out) if out else np.zeros(0, U)), np.concatenate([[0], np.cumsum(sizes)])


def _order(h: np.ndarray, k: int) -> np.ndarray:
    return C.mix(h ^ U(0xA0761D6478BD642F * (2 * k + 1) & (2**64 - 1)))


def describe(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n, the set's signature and the bytes of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.pieces(batches):
            sets, at = shingle_sets(C.col(b, "text"), n)
            sums = [np.concatenate([np.zeros(1, U), np.cumsum(_order(sets, k))]) for k in (7, 8)]
            size = pc.fill_null(pc.binary_length(C.col(b, "text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([C.col(b, "doc_id"), pa.array(np.diff(at)), *(pa.array((s[at[1:]] - s[at[:-1]]).view(np.int64)) for s in sums), size], ["doc_id", "n", "s1", "s2", "bytes"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, s1 long, s2 long, bytes long")


class _Part:
    """The sets of a part's documents, one after the other, and the part's distinct tokens (48 bits, ascending)."""

    def __init__(self, t: pa.Table, n: int):
        sets, sizes = [np.zeros(0, U)], [np.zeros(0, np.int64)]
        for b in C.pieces(iter(t.select(["text"]).combine_chunks().to_batches())):
            own, at = shingle_sets(C.col(b, "text"), n)
            sets.append(own >> U(16))
            sizes.append(np.diff(at))
        self.sets, self.size = np.concatenate(sets), np.concatenate(sizes)
        self.at = np.concatenate([[0], np.cumsum(self.size)])

    def tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct tokens and in how many documents of the part each is."""
        s = np.sort(self.sets)
        first = np.flatnonzero(np.append(True, s[1:] != s[:-1])[: len(s)])
        return s[first], np.diff(np.append(first, len(s)))


def _ranges(tokens: np.ndarray, n: int) -> np.ndarray:
    return cuts(tokens << U(16), n)


def _level(df: np.ndarray) -> np.ndarray:
    """0 for a token of one document, else more for a higher frequency, up to 255."""
    return np.where(df < 2, 0, np.minimum(255, 8 * np.log2(np.maximum(df, 1)))).astype(np.uint8)


def prefixes(docs: DataFrame, n: int, percent: int, parts: int) -> DataFrame:
    """Of each document whose prefix under order 0 has tokens that are in other documents too: doc_id, n, how many
    tokens of the prefix come before these, p0 (these, in order), p1, p2 ... (32-bit hashes) and the packed set."""
    texts = docs.select("doc_id", "text").withColumn("pid", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int"))

    def tokens_out(t: pa.Table) -> pa.Table:
        C.trim()
        tokens, df = _Part(t, n).tokens()
        at = _ranges(tokens, parts)
        full = np.flatnonzero(np.diff(at))
        return pa.table({"pid": pa.array([t["pid"][0].as_py()] * len(full), pa.int32()), "bucket": pa.array(full, pa.int32()), "g": C.blobs([pack_sorted(tokens[at[b] : at[b + 1]]) for b in full]), "c": C.blobs([pack(df[at[b] : at[b + 1]]) for b in full])})

    def levels_back(t: pa.Table) -> pa.Table:
        C.trim()
        gs = [unpack_sorted(x) for x in t["g"].to_pylist()]
        every = np.concatenate(gs)
        turn = np.argsort(every)
        every = every[turn]
        new = np.append(True, every[1:] != every[:-1])
        df = np.add.reduceat(np.concatenate([unpack(x) for x in t["c"].to_pylist()]).astype(np.int64)[turn], np.flatnonzero(new))
        level = np.empty(len(every), np.uint8)
        level[turn] = _level(df)[np.cumsum(new) - 1]
        return pa.table({"pid": t["pid"], "bucket": t["bucket"], "level": C.blobs([pack(x) for x in np.split(level, np.cumsum([len(g) for g in gs])[:-1])])})

    def prefixes_out(t: pa.Table, told: pa.Table) -> pa.Table:
        C.trim()
        p = _Part(t, n)
        tokens, _ = p.tokens()
        back = sorted(zip(told["bucket"].to_pylist(), told["level"].to_pylist(), strict=True))
        level = np.concatenate([*(unpack(x) for _, x in back), np.zeros(0, U)])
        ids = t["doc_id"].to_pylist()
        long = np.where(p.size > 0, p.size + (-percent * p.size // 100) + 1, 0)
        out = {k: [] for k in ("doc_id", "n", "skip", *(f"p{k}" for k in range(ORDERS)), "set")}
        for i in np.flatnonzero(p.size):
            own, m = p.sets[p.at[i] : p.at[i + 1]], long[i]
            smallest = lambda key: np.sort(np.partition(key, m - 1)[:m] if m < len(key) else key)  # noqa: B023, E731
            first = smallest((_order(own, 0) >> U(8)) | (level[np.searchsorted(tokens, own)] << U(56)))
            shared = first[first >> U(56) > 0]
            if len(shared):
                rest = [(smallest(_order(own, k)) >> U(32)).astype(np.uint32).view(np.int32) for k in range(1, ORDERS)]
                for k, v in zip(out, (ids[i], len(own), len(first) - len(shared), shared.view(np.int64), *rest, pack_sorted(own)), strict=True):
                    out[k].append(v)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), *(pa.list_(pa.int32()) for _ in range(1, ORDERS)), pa.binary()]
        return pa.table({k: pa.array(v, kind) for (k, v), kind in zip(out.items(), kinds, strict=True)})

    sent = texts.groupBy("pid").applyInArrow(tokens_out, "pid int, bucket int, g binary, c binary")
    told = sent.groupBy("bucket").applyInArrow(levels_back, "pid int, bucket int, level binary")
    return texts.groupBy("pid").cogroup(told.groupBy("pid")).applyInArrow(prefixes_out, "doc_id long, n long, skip int, p0 array<long>, " + ", ".join(f"p{k} array<int>" for k in range(1, ORDERS)) + ", set binary")


def _long_enough(percent: int) -> str:
    """Of a pair at a shared token: sizes are near enough, and if it is the first shared one, what follows makes the
    overlap. A pair that links meets this at its first shared token."""
    need = f"ceil({percent} * (an + bn) / {100 + percent})"
    return f"100 * least(an, bn) >= {percent} * greatest(an, bn) and least(an - apos, bn - bpos) >= {need}"


def _links(pairs: DataFrame, sigs: DataFrame, percent: int, s: C.Scratch) -> DataFrame:
    """Of the pairs (a, b) those that link, written: their prefixes meet under all orders, and their whole sets are similar
    enough. The documents of few pairs are cut out of sigs and broadcast; else prefixes are joined first, and sets only
    to pairs that are left."""
    pairs = s.light(pairs, "ngram-pairs")
    orders = [f"p{k}" for k in range(1, ORDERS)]
    side = lambda of, s, *names: of.select(F.col("doc_id").alias(s), *(F.col(c).alias(s + c) for c in names))
    meet = F.lit(True)
    for k in orders:
        meet = meet & F.arrays_overlap("a" + k, "b" + k)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(C.col(b, "aset"), C.col(b, "bset"), strict=True)):
                both = np.concatenate([unpack_sorted(x.as_py()), unpack_sorted(y.as_py())])
                both.sort(kind="stable")
                inter = int((both[1:] == both[:-1]).sum())
                keep[i] = inter > 0 and 100 * inter >= percent * (len(both) - inter)
            yield pa.RecordBatch.from_arrays([C.col(b, "a"), C.col(b, "b")], ["a", "b"]).filter(pa.array(keep))
        C.trim()

    few = None
    if C.bytes_of(pairs) <= C.BROADCAST_BYTES:
        ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b"))
        some = s.light(sigs.select("doc_id", *orders, "set").join(F.broadcast(ids), "doc_id", "left_semi"), "ngram-some")
        few = F.broadcast(some) if C.bytes_of(some) <= C.BROADCAST_BYTES else None
    if few is not None:
        near = pairs.join(side(few, "a", *orders, "set"), "a").join(side(few, "b", *orders, "set"), "b").where(meet).select("a", "b", "aset", "bset")
    else:
        near = pairs.join(side(sigs, "a", *orders), "a").join(side(sigs, "b", *orders), "b").where(meet).select("a", "b")
        near = near.join(side(sigs, "a", "set"), "a").join(side(sigs, "b", "set"), "b")
    return s.light(near.mapInArrow(verify, "a long, b long"), "ngram-links")


def _pairs(left: DataFrame, right: DataFrame, percent: int, more: str = "true") -> DataFrame:
    a = left.select("token", *(F.col(c).alias("a" + c) for c in left.columns if c != "token"))
    b = right.select("token", *(F.col(c).alias("b" + c) for c in right.columns if c != "token"))
    return a.join(b, "token").where("adoc <> bdoc").where(more).where(_long_enough(percent)).select(F.least("adoc", "bdoc").alias("a"), F.greatest("adoc", "bdoc").alias("b")).distinct()


def link_components(sigs: DataFrame, percent: int, s: C.Scratch) -> DataFrame:
    """id, component of the documents with links. sigs: what prefixes() returns, written."""
    entries = s.light(sigs.select(F.col("doc_id").alias("doc"), "n", "skip", F.posexplode("p0").alias("pos", "token")).select("token", "doc", "n", (F.col("pos") + F.col("skip")).alias("pos")), "ngram-lists")
    total = entries.count()
    first = entries.groupBy("token").agg(F.min(F.struct("doc", "n", "pos")).alias("m"), F.max("doc").alias("last")).where("m.doc < last").select("token", "m.*")
    links = _links(_pairs(first, entries, percent), sigs, percent, s)
    found = components(links, s)
    s.drop(links)
    level = None
    while True:
        now = entries.join(C.small(found.select(F.col("id").alias("doc"), "component")), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
        now = now.withColumn("level", F.length(F.regexp_extract(F.bin(F.xxhash64("doc")), "(0*)$", 1)).cast("int"))
        tally = now.groupBy("token", "component").agg(F.count("*").cast("double").alias("c"))
        tally = tally.groupBy("token").agg(((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).alias("open"), F.count("*").alias("k"))
        tally = s.light(tally.where("k > 1").select("token", "open"), "ngram-open")
        open_ = tally.agg(F.sum("open")).first()[0]
        if not open_:
            return found
        left = s.light(now.join(C.small(tally.select("token")), "token", "left_semi"), "ngram-left")
        s.drop(tally)
        while True:  # centres of a level stand for 2**-level of all documents; the next are 16 times as many
            fit = max(0, math.ceil(math.log2(open_ / (PAIRS_PER_ENTRY * total))))
            level = fit if level is None else min(fit, level - 4)
            last = level <= 0
            if last:
                pairs = _pairs(left, left, percent, "acomponent <> bcomponent and adoc < bdoc")
            else:
                pairs = _pairs(left.where(F.col("level") >= level), left, percent, "acomponent <> bcomponent")
            new = _links(pairs, sigs, percent, s)
            any_ = not new.isEmpty()
            if any_:
                found = components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(new), s)
            if last:
                return found
            if any_:
                break
        s.drop(left)


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of each row."""
    with C.Scratch(docs.sparkSession) as s:
        described = s.table(describe(docs, n), "ngram-sets")
        rows, ids, total = described.where("doc_id is not null").agg(F.count("*"), F.countDistinct("doc_id"), F.sum("bytes")).first()
        s.sized(total or 0, LIGHT_BYTES)
        classes = described.where("n > 0 and doc_id is not null").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep < last").drop("last")
        classes = C.small(s.light(classes, "ngram-classes"))
        member = described.join(classes, ["s1", "s2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep"))
        member = s.light(member, "ngram-members")
        away = s.light(member.where("(rep < doc_id or n_shingles = 0) and doc_id is not null").select("doc_id").distinct(), "ngram-away")
        alone = docs.select("doc_id", "text").where("doc_id is not null").join(C.small(away), "doc_id", "left_anti")
        if ids < rows:
            alone = alone.dropDuplicates(["doc_id"])
        sigs = s.table(prefixes(alone, n, percent, C.sized_partitions(total or 0, PART_BYTES)), "ngram-prefixes")
        found = C.small(link_components(sigs, percent, s))
        done = member.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
        return s.kept(done, "ngram-components")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(C.table(spark, sf_dir, "documents"), 3, 90)


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs without those whose component has a smaller doc_id. Of rows with one id all stay or go."""
    found = jaccard_components(docs, n, percent)
    gone = C.small(C.materialize(found.where("component_id < doc_id").select("doc_id").distinct(), "ngram-gone"))
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


#: The same by an equi-join of all shingles and a closure of the links.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS s FROM w
), named AS (
  SELECT doc_id, len(s) AS n, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY s) END AS rep, s FROM sets
), tokens AS (
  SELECT doc_id, n, unnest(s) AS t FROM named WHERE doc_id = rep
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id < b.doc_id
  WHERE 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT a AS id, a AS other FROM both_ways UNION SELECT r.id, e.b FROM reach r JOIN both_ways e ON r.other = e.a
), comp AS (SELECT id, min(other) AS c FROM reach GROUP BY id)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, coalesce(c, rep) AS component_id FROM named LEFT JOIN comp ON rep = id
"""
