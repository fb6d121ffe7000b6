"""Exact substring deduplication by a distributed merge sort of suffixes that knows common prefixes.

A byte goes if a WIDTH-byte string that covers it also starts in a document with a smaller doc_id. Sorting every
suffix would move WIDTH bytes for each byte of text, so the sort is sparse and its strings are cut to what decides:

1. Anchors: in each WIDTH-byte string, the places of the smallest hash of its GRAM-byte strings. The choice depends
   on those bytes alone, so equal strings have equal anchors; about one place in 13 is one.
2. X1 sends the anchors' gram hashes as packed sorted runs (48 bits, coded by differences). Only anchors whose hash is
   in two documents or more go on (a false match costs time, never a wrong byte). This is the distinguishing-prefix
   filter of distributed string sorting.
3. X2 sends, for these, front-coded runs of suffixes sorted in each part: the suffix's WIDTH bytes from the anchor, then
   the bytes before it in reverse; each string as the length of the prefix it shares with the one before, and the rest;
   and of the documents that have a string in a part the least one. The part's others lose the string in any case.
   A loser tree merges the runs; it keeps, for each loser, the prefix it shares with the winner, decides by these
   lengths alone where they differ, and else compares from there on. The order's common prefixes give the classes of
   equal strings at each offset around the anchor, and the smallest doc_id of each class tells what goes. However many
   documents have a passage, a part sends each of its strings once.
4. The answers, two numbers a string, go back to the parts, where whole texts are cut and hashed.

Exact copies of a whole document are found first (SHA-256) and go whole; the first of them stands for all. The number of
parts follows the bytes of texts, that of ranges the bytes and the anchors left. What each exchange gives is a written
table, so that a lost executor starts one step again at most; shuffle files go with their step.

Defined results: null and empty texts have 0 bytes; texts under WIDTH bytes lose nothing; rows that repeat a doc_id
with its text get the same result each and don't remove each other; a null doc_id's row loses nothing and removes
nothing. Other columns aren't read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .packing import buckets, pack, pack_sorted, unpack, unpack_sorted

QUERY = "op1_suffix_dedup"
U = C.U
WIDTH, GRAM = 50, 24
BACK = WIDTH - GRAM
LONG = WIDTH + BACK
PART_BYTES = 8 << 20
#: Bytes of text whose hashes are held at once.
PIECE = 1 << 20
NONE = 0xFF  # never a byte of UTF-8: stands where a document has ended


#: Parts whose grams one range holds, and anchors whose suffixes one range merges, about.
RANGE_PARTS, PER_RANGE = 2, 30_000


def _sliding(a: np.ndarray, n: int, f) -> np.ndarray:
    """f over each n neighbours, by doubling."""
    size, out = 1, a
    while size * 2 <= n:
        out = f(out[:-size], out[size:])
        size *= 2
    return f(out[: len(a) - n + 1], out[n - size : n - size + len(a) - n + 1]) if size < n else out


def anchors(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in buf of the anchors of rows that begin at `at` (each ends a byte before the next), and gram hashes."""
    n = len(buf)
    if n < WIDTH:
        return np.zeros(0, np.int64), np.zeros(0, U)
    up, down = C.powers(n + 1)
    sums = np.zeros(n + 1, U)
    np.cumsum((buf.astype(U) + U(1)) * up[:n], out=sums[1:])
    h = C.mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    v = (h >> U(32)).astype(np.uint32) | np.uint32(1)
    least = _sliding(v, BACK + 1, np.minimum)
    for a, z in zip(at[:-1], at[1:], strict=True):  # strings that would run over their row's end
        least[max(a, z - WIDTH) : z] = 0
    least = np.concatenate([np.zeros(BACK, np.uint32), least, np.zeros(BACK, np.uint32)])
    p = np.flatnonzero(v <= _sliding(least, BACK + 1, np.maximum)[: len(v)])
    return p, h[p]


def contexts(buf: np.ndarray, at: np.ndarray, p: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Of each anchor the WIDTH bytes from it on and the BACK bytes before it, backwards; NONE beyond its row."""
    pad = np.concatenate([np.zeros(BACK, np.uint8), buf, np.zeros(WIDTH, np.uint8)])
    where = np.concatenate([np.arange(WIDTH), -1 - np.arange(BACK)])
    out = pad[p[:, None] + (where + BACK)]
    right, left = at[row + 1] - 1 - p, p - at[row]
    out[:, :WIDTH][np.arange(WIDTH) >= right[:, None]] = NONE
    out[:, WIDTH:][np.arange(BACK) >= left[:, None]] = NONE
    return out


def sort_rows(m: np.ndarray) -> np.ndarray:
    return np.argsort(np.ascontiguousarray(m).view(f"S{m.shape[1]}").ravel(), kind="stable")


def common_prefix(m: np.ndarray) -> np.ndarray:
    """Of each row, how many bytes it shares with the one before (0 for the first)."""
    out = np.zeros(len(m), np.int64)
    if len(m) > 1:
        differ = m[1:] != m[:-1]
        out[1:] = np.where(differ.any(1), differ.argmax(1), m.shape[1])
    return out


def front_decode(lcp_blob: bytes, rest_blob: bytes, width: int = LONG) -> tuple[np.ndarray, np.ndarray]:
    lcp, rest = unpack(lcp_blob).astype(np.int64), unpack(rest_blob).astype(np.uint8)
    m = np.zeros((len(lcp), width), np.uint8)
    own = np.arange(width) >= lcp[:, None]
    m[own] = rest
    source = np.maximum.accumulate(np.where(own, np.arange(len(lcp))[:, None], 0), axis=0)
    return np.take_along_axis(m, source, 0), lcp


def merge_runs(runs: list[list[bytes]], prefixes: list[list[int]]) -> tuple[list[int], list[int]]:
    """The run each string of the merged order comes from, and the prefix it shares with the one before.

    prefixes: within each run, what each string shares with the one before it. A node of the tree holds the run that lost
    there and the prefix it shares with the string that beat it; no byte before that is looked at again.
    """
    leaves = 1
    while leaves < max(2, len(runs)):
        leaves *= 2
    place = [0] * leaves
    now: list[bytes | None] = [r[0] if r else None for r in runs] + [None] * (leaves - len(runs))
    loser, shared = [0] * leaves, [0] * leaves

    def compare(a: bytes, b: bytes, h: int) -> tuple[bool, int]:
        """Whether a is not greater than b, and what they share; they share h bytes for certain."""
        x, y = a[h : h + 8], b[h : h + 8]
        while x == y:
            if not x:
                return True, len(a)
            h += 8
            x, y = a[h : h + 8], b[h : h + 8]
        differ = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
        return x < y, h + len(x) - (differ.bit_length() + 7) // 8

    def build(node: int) -> tuple[int, int]:
        """The winner below a node, and what it shares with the empty string."""
        if node >= leaves:
            return node - leaves, 0
        (a, _), (b, _) = build(2 * node), build(2 * node + 1)
        if now[a] is None or now[b] is None:
            win, lose = (b, a) if now[a] is None else (a, b)
            loser[node], shared[node] = lose, -1
            return win, 0
        first, h = compare(now[a], now[b], 0)
        win, lose = (a, b) if first else (b, a)
        loser[node], shared[node] = lose, h
        return win, 0

    win, h = build(1)
    total = sum(map(len, runs))
    out_run, out_lcp = [0] * total, [0] * total
    for k in range(total):
        out_run[k], out_lcp[k] = win, h
        i = place[win] + 1
        place[win] = i
        if i < len(runs[win]):
            now[win], h = runs[win][i], prefixes[win][i]
        else:
            now[win], h = None, -1
        node = (win + leaves) >> 1
        while node:
            s = shared[node]
            if s > h:
                shared[node], h = h, s
                loser[node], win = win, loser[node]
            elif s == h and h >= 0:
                other = loser[node]
                first, both = compare(now[win], now[other], h)
                shared[node] = both
                if not first:
                    loser[node], win = win, other
            node >>= 1
    return out_run, out_lcp


def within(a: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Whether each of a is among ascending values."""
    i = np.searchsorted(among, a)
    return (i < len(among)) & (among[np.minimum(i, len(among) - 1)] == a) if len(among) else np.zeros(len(a), bool)


class _Rows:
    """The rows of a part."""

    def __init__(self, t: pa.Table):
        t = t.combine_chunks()
        self.ids = t["doc_id"].to_pylist()
        self.buf, self.at = C.joined(t["text"]) if self.ids else (np.zeros(0, np.uint8), np.zeros(1, np.int64))

    def numbered(self) -> tuple[np.ndarray, np.ndarray]:
        """The part's distinct doc_ids in order, and each row's number among them (-1 for a null one)."""
        named = np.array([i is not None for i in self.ids], bool)
        ids, number = np.unique(np.array([i for i in self.ids if i is not None], np.int64), return_inverse=True)
        of = np.full(len(self.ids), -1, np.int64)
        of[named] = number
        return ids, of


class _Part(_Rows):
    """With the anchors of rows that can share strings with others."""

    def __init__(self, t: pa.Table, copies: pa.Table):
        super().__init__(t)
        copy = set(copies["doc_id"].to_pylist())
        good = np.array([i is not None and i not in copy for i in self.ids], bool) & (np.diff(self.at) > WIDTH)
        ps, hs = [], []
        i = 0
        while i < len(self.ids):  # pieces bound the memory of the arrays of hashes
            j = min(len(self.ids), max(i + 1, int(np.searchsorted(self.at, self.at[i] + PIECE))))
            lo, hi = self.at[i], self.at[j]
            p, h = anchors(self.buf[lo:hi], self.at[i : j + 1] - lo)
            ps.append(p + lo)
            hs.append(h)
            i = j
        p, h = np.concatenate([*ps, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*hs, np.zeros(0, U)])
        row = np.searchsorted(self.at, p, side="right") - 1
        keep = good[row] if len(row) else np.zeros(0, bool)
        self.p, self.row, h = p[keep], row[keep], h[keep] >> U(16)
        self.gram, self.which = np.unique(h, return_inverse=True)

    def in_two(self) -> np.ndarray:
        """Whether a gram is in two documents of this part."""
        ids = np.array([-1 if i is None else i for i in self.ids], np.int64)[self.row]
        low, high = np.full(len(self.gram), np.iinfo(np.int64).max), np.full(len(self.gram), np.iinfo(np.int64).min)
        np.minimum.at(low, self.which, ids)
        np.maximum.at(high, self.which, ids)
        return low < high


def _ranges(gram: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(buckets(gram << U(16), n), np.arange(n + 1))


def covered(runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """From sorted runs (strings, prefixes, the least doc_id that has each): for each run and string the least and the
    greatest offset at which that document's string goes, or (LONG, -1) if it stays at all."""
    order, lcp = merge_runs([[bytes(x) for x in m.view(f"V{LONG}").ravel()] for m, *_ in runs], [p.tolist() for _, p, _ in runs])
    run = np.array(order)
    del order
    lcp = np.array(lcp)
    by_run = np.argsort(run, kind="stable")
    source = np.empty(len(run), np.int64)
    source[by_run] = np.arange(len(run))  # run after run, each in its own order
    m = np.concatenate([m for m, *_ in runs])[source]
    doc = np.concatenate([d for *_, d in runs])[source]
    lowest, highest = np.full(len(doc), LONG), np.full(len(doc), -1)
    gram = np.cumsum(lcp < GRAM)
    some = np.flatnonzero(np.bincount(gram)[gram] > 1)
    if len(some):
        near, far = _room(m[some])
        back = m[some, WIDTH:]
        turn = sort_rows(back)
        shared = common_prefix(back[turn])
        for d in range(BACK + 1):
            right_id = np.cumsum(lcp < WIDTH - d)[some]
            left_id = np.empty(len(some), np.int64)
            left_id[turn] = np.cumsum(shared < d)
            _, class_of = np.unique(right_id * (len(some) + 1) + left_id, return_inverse=True)
            use = np.flatnonzero((near <= d) & (d <= far))
            least = np.full(len(some), np.iinfo(np.int64).max)
            np.minimum.at(least, class_of[use], doc[some[use]])
            hit = some[use[least[class_of[use]] < doc[some[use]]]]
            lowest[hit], highest[hit] = np.minimum(lowest[hit], d), np.maximum(highest[hit], d)
    # All strings at an anchor overlap in its gram, so offsets lowest .. highest cover one span.
    low, high = np.empty(len(doc), np.int64), np.empty(len(doc), np.int64)
    low[source], high[source] = lowest, highest
    ends = np.cumsum([len(d) for *_, d in runs])[:-1]
    return list(zip(np.split(low, ends), np.split(high, ends), strict=True))


def _room(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of contexts, the least and the greatest offset at which a string of WIDTH bytes lies in its document."""
    right, left = (m[:, :WIDTH] != NONE).sum(1), (m[:, WIDTH:] != NONE).sum(1)
    return np.maximum(0, WIDTH - right), np.minimum(BACK, left)


def suffix_dedup(docs: DataFrame, parts: int | None = None, per_range: int = PER_RANGE, texts_too: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept (the remaining bytes) with texts_too. parts: by default, of PART_BYTES each."""
    if parts is None:
        parts = C.sized_partitions(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0, PART_BYTES)
    pid = F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text"))), F.lit(parts)).cast("int").alias("pid")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("*", pid)
    ranges = max(4, -(-parts // RANGE_PARTS))
    with C.Scratch(docs.sparkSession) as s:
        known = s.table(docs.where("doc_id is not null and text is not null").select("doc_id", "text").select("doc_id", F.sha2("text", 256).alias("sha"), pid), "suffix-hashes")
        firsts = known.groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
        copies = s.table(known.join(firsts, "sha").where("first < doc_id").select("doc_id", "pid").distinct(), "suffix-copies")
        s.drop(known)

        def grams_out(t: pa.Table, c: pa.Table) -> pa.Table:
            C.trim()
            if not t.num_rows:
                return pa.table({"pid": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()), "g": C.blobs([]), "two": C.blobs([])})
            p = _Part(t, c)
            at, two = _ranges(p.gram, ranges), p.in_two()
            full = np.flatnonzero(np.diff(at))
            return pa.table({"pid": pa.array([t["pid"][0].as_py()] * len(full), pa.int32()), "bucket": pa.array(full, pa.int32()), "g": C.blobs([pack_sorted(p.gram[at[b] : at[b + 1]]) for b in full]), "two": C.blobs([pack(two[at[b] : at[b + 1]]) for b in full])})

        def grams_back(t: pa.Table) -> pa.Table:
            C.trim()
            gs, two = [unpack_sorted(x) for x in t["g"].to_pylist()], [unpack(x) > 0 for x in t["two"].to_pylist()]
            every = np.sort(np.concatenate(gs))
            again = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], *(g[x] for g, x in zip(gs, two, strict=True))]))
            marks = [within(g, again) for g in gs]
            return pa.table({"pid": t["pid"], "bucket": t["bucket"], "again": C.blobs([np.packbits(x).tobytes() for x in marks]), "n": pa.array([int(x.sum()) for x in marks], pa.int64())})

        sent = texts.groupBy("pid").cogroup(copies.groupBy("pid")).applyInArrow(grams_out, "pid int, bucket int, g binary, two binary")
        again = s.table(sent.groupBy("bucket").applyInArrow(grams_back, "pid int, bucket int, again binary, n long"), "suffix-again")
        fine = max(4, -(-(again.agg(F.sum("n")).first()[0] or 0) // per_range))
        only_copies = copies.select("pid", F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("binary").alias("again"), "doc_id")
        told = again.select("pid", "bucket", "again", F.lit(None).cast("long").alias("doc_id")).unionByName(only_copies)
        names = ["what", "pid", "bucket", "a", "b", "c", "d", "e", "f"]

        def suffixes_out(t: pa.Table, told: pa.Table) -> pa.Table:
            C.trim()
            out = {k: [] for k in names}
            if t.num_rows:
                p = _Part(t, told.filter(pc.is_valid(told["doc_id"])))
                at, edges = _ranges(p.gram, ranges), _ranges(p.gram, fine)
                again = np.zeros(len(p.gram), bool)
                for r in told.to_pylist():
                    if r["bucket"] is not None:
                        a, z = at[r["bucket"]], at[r["bucket"] + 1]
                        again[a:z] = np.unpackbits(np.frombuffer(r["again"], np.uint8))[: z - a]
                use = np.flatnonzero(again[p.which])
                use = use[np.argsort(p.which[use], kind="stable")]
                edge = np.searchsorted(p.which[use], edges)
                ids, of = p.numbered()
                for b in np.flatnonzero(np.diff(edge)):
                    some = use[edge[b] : edge[b + 1]]
                    m = contexts(p.buf, p.at, p.p[some], p.row[some])
                    turn = sort_rows(m)
                    m, some = m[turn], some[turn]
                    lcp = common_prefix(m)
                    new = lcp < LONG
                    start = np.flatnonzero(new)
                    row, place = of[p.row[some]], p.p[some] - p.at[p.row[some]]
                    least = np.minimum.reduceat(row, start)
                    context = np.cumsum(new) - 1
                    m, lcp = m[new], lcp[new]
                    near, far = _room(m)
                    # All but the least document of a string lose it wherever it fits; the merge tells about the least one.
                    first = row == least[context]
                    sure = ~first & (near <= far)[context]
                    begin, end = place - far[context], place + WIDTH - near[context]
                    pid_ = t["pid"][0].as_py()
                    own = (pack(np.bincount(context[first], minlength=len(m))), pack(least), pack(place[first]), pack(row[sure]), pack(begin[sure]), pack((end - begin)[sure]))
                    sent = (pack(lcp), pack(m[np.arange(LONG) >= lcp[:, None]]), pack(ids[least].view(U)), None, None, None)
                    for what, blobs in (("own", own), ("sent", sent)):
                        for k, v in zip(names, (what, pid_, b, *blobs), strict=True):
                            out[k].append(v)
            kinds = [pa.string(), pa.int32(), pa.int32(), *(pa.binary(),) * 6]
            return pa.table({k: pa.array(v, kind) for (k, v), kind in zip(out.items(), kinds, strict=True)})

        made = texts.groupBy("pid").cogroup(told.groupBy("pid")).applyInArrow(suffixes_out, "what string, pid int, bucket int, " + ", ".join(f"{c} binary" for c in "abcdef"))
        own, sent = s.split(made, "suffix-runs", "what", "own", "sent")

        def merged(t: pa.Table) -> pa.Table:
            C.trim()
            rows = t.to_pylist()
            got = covered([(*front_decode(r["a"], r["b"]), unpack(r["c"]).view(np.int64)) for r in rows])
            return pa.table({"pid": t["pid"], "bucket": t["bucket"], "a": C.blobs([pack(low) for low, _ in got]), "b": C.blobs([pack(high + 1) for _, high in got])})

        answers = s.table(sent.select("pid", "bucket", "a", "b", "c").groupBy("bucket").applyInArrow(merged, "pid int, bucket int, a binary, b binary"), "suffix-answers")
        s.drop(sent, again)
        none = [F.lit(None).cast("binary").alias(c) for c in "cdef"]
        told2 = own.withColumn("doc_id", F.lit(None).cast("long")).unionByName(answers.select("pid", "bucket", "a", "b", *none, F.lit(None).cast("long").alias("doc_id"))).unionByName(copies.select("pid", F.lit(None).cast("int").alias("bucket"), *(F.lit(None).cast("binary").alias(c) for c in "abcdef"), "doc_id"))

        def cut(t: pa.Table, told: pa.Table) -> pa.Table:
            C.trim()
            p = _Rows(t)
            gone = np.zeros(len(p.buf) + 1, np.int32)
            ids, _ = p.numbered()
            every = np.array([-1 if i is None else i for i in p.ids], np.int64)
            named = np.flatnonzero([i is not None for i in p.ids])
            many = named[np.argsort(every[named], kind="stable")]
            key = every[many]

            def lose(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
                a, z = np.searchsorted(key, ids[row]), np.searchsorted(key, ids[row], side="right")
                for k in range(int((z - a).max(initial=0))):  # rows that repeat a doc_id
                    has = a + k < z
                    at = p.at[many[(a + k)[has]]]
                    np.add.at(gone, at + start[has], 1)
                    np.add.at(gone, at + end[has], -1)

            rows = told.to_pylist()
            offsets = {r["bucket"]: (unpack(r["a"]).astype(np.int64), unpack(r["b"]).astype(np.int64) - 1) for r in rows if r["bucket"] is not None and r["c"] is None}
            for r in rows:
                if r["c"] is None:
                    continue
                n, least, place, row, begin, size = (unpack(r[k]).astype(np.int64) for k in "abcdef")
                lose(row, begin, begin + size)
                low, high = (np.repeat(x, n) for x in offsets[r["bucket"]])
                hit = high >= 0
                lose(np.repeat(least, n)[hit], (place - high)[hit], (place + WIDTH - low)[hit])
            copies_ = set(told["doc_id"].to_pylist()) - {None}
            out = np.cumsum(gone[:-1]) > 0
            size = np.diff(p.at) - 1
            res = {k: [] for k in ("n_removed", "n_spans", "kept_sha256", "kept")}
            for i, d in enumerate(p.ids):
                mask, text = out[p.at[i] : p.at[i] + size[i]], p.buf[p.at[i] : p.at[i] + size[i]]
                if d in copies_ and size[i] >= WIDTH:
                    mask = np.ones(len(mask), bool)
                kept = text[~mask].tobytes()
                res["n_removed"].append(int(mask.sum()))
                res["n_spans"].append(int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum()))
                res["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                res["kept"].append(kept)
            return pa.table({"doc_id": pa.array(p.ids, pa.int64()), "n_bytes": pa.array(size[: len(p.ids)].astype(np.int64)), "n_removed": pa.array(res["n_removed"], pa.int64()), "n_spans": pa.array(res["n_spans"], pa.int64()), "kept_sha256": pa.array(res["kept_sha256"], pa.string()), "kept": C.blobs(res["kept"])})

        done = texts.groupBy("pid").cogroup(told2.groupBy("pid")).applyInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
        return C.materialize(done.drop(*([] if texts_too else ["kept"])), "suffix-kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(C.table(spark, sf_dir, "documents").select("doc_id", "text"), texts_too=False)


#: The same by grouping every 50-byte string.
SQL = r"""
WITH bytes AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), grams AS (
  SELECT doc_id, p, array_slice(b, p, p + 49) AS g FROM (SELECT doc_id, b, unnest(range(1, n - 48)) AS p FROM bytes)
), firsts AS (
  SELECT g, min(doc_id) AS d FROM grams GROUP BY g HAVING min(doc_id) < max(doc_id)
), hits AS (
  SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM grams JOIN firsts USING (g) WHERE d < doc_id
), marked AS (
  SELECT doc_id, p, sum(CASE WHEN before IS NULL OR p - before > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM hits
), runs AS (
  SELECT doc_id, min(p) AS a, max(p) + 49 AS z FROM marked GROUP BY doc_id, run
), gaps AS (
  SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1 AS k, a - 1 AS e FROM runs
  UNION ALL SELECT doc_id, max(z) + 1, NULL FROM runs GROUP BY doc_id
), kept AS (
  SELECT doc_id, sha256(unhex(string_agg(hex(array_slice(b, k, coalesce(e, n))), '' ORDER BY k))) AS h FROM gaps JOIN bytes USING (doc_id) GROUP BY doc_id
), sums AS (
  SELECT doc_id, sum(z - a + 1) AS removed, count(*) AS spans FROM runs GROUP BY doc_id
)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  coalesce(h, sha256(b)) AS kept_sha256 FROM bytes LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
