"""Line deduplication over content-defined chunks of lines, extended to every repeated run of lines.

A rolling hash over the hashes of WINDOW consecutive lines ends a chunk after each line where it is divisible by
DIVISOR, so an insertion moves boundaries only near it. First, chunks of two lines or more that an earlier place has
too (smaller doc_id, then place in the document) are found. Then every two neighbouring lines that aren't both in one
such chunk are looked up in the same way: those that an earlier place has extend the chunks' matches to both sides,
and find the repeated runs that no chunk shows. So exactly the lines go that belong to a run of two lines or more that
stands at an earlier place, not overlapping it, whatever its neighbours are. Hashes only select; runs are told apart
by their bytes. Empty lines count neither in hashes nor in bytes, and go with the line before them.

Defined results: null and empty texts stay as they are; a null doc_id's row stays unchanged and counts for nothing;
rows repeated with one doc_id count as one document (each keeps or loses the same lines); a single repeated line is
never removed. A text may become empty; its row stays. Other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

QUERY, SQL = "op10_line_dedup", None
WINDOW, DIVISOR = 2, 3
U = C.U
#: The first line of each run (of all lines of the texts), its number of lines and its hash.
Runs = tuple[np.ndarray, np.ndarray, np.ndarray]


def chunks(texts: pa.Array) -> tuple[C.Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines; the first line of each chunk; its lines; its number in its document; its hash."""
    w = C.words(texts, C.NEWLINE, C.SAME)
    h, n = w.hash, len(w.hash)
    new_doc = np.ones(n, bool)
    new_doc[1:] = w.doc[1:] != w.doc[:-1]
    roll = h.copy()
    for k in range(1, WINDOW):
        back = np.zeros(n, U)
        back[k:] = np.where(w.doc[k:] == w.doc[:-k], h[:-k], U(0))
        roll = C.mix(roll * U(0xD1342543DE82EF95) + back)
    ends = roll % U(DIVISOR) == 0
    new = new_doc.copy()
    new[1:] |= ends[:-1]
    first = np.flatnonzero(new)
    lines = np.diff(np.append(first, n))
    place = (np.arange(n) - np.repeat(first, lines)).astype(U)
    hashes = np.add.reduceat(C.mix(h ^ C.mix(place + U(1))), first) if n else np.zeros(0, U)
    starts = np.flatnonzero(new_doc[first])
    per = np.diff(np.append(starts, len(first)))
    return w, first, lines, np.arange(len(first)) - np.repeat(starts, per), hashes


def _in_docs(w: C.Words, rows: int) -> np.ndarray:
    """The first line of each document, and the number of lines."""
    return np.searchsorted(w.doc, np.arange(rows + 1))


def _marks(runs: pa.Array, line_at: np.ndarray) -> np.ndarray:
    """For each line the number, from 1, of the last of the runs that has it, or 0. runs: for each document, of pos and n."""
    marks, k = np.zeros(line_at[-1], np.int64), 0
    for i, rs in enumerate(runs.to_pylist()):
        for r in rs or ():
            k += 1
            marks[line_at[i] + r["pos"] : min(line_at[i] + r["pos"] + r["n"], line_at[i + 1])] = k
    return marks


def whole_chunks(b: pa.RecordBatch) -> tuple[C.Words, Runs]:
    w, first, lines, _, h = chunks(C.col(b, "text"))
    many = lines > 1
    return w, (first[many], lines[many], h[many])


def pairs_of_lines(b: pa.RecordBatch) -> tuple[C.Words, Runs]:
    """Without those in one of the chunks `_gone`: an earlier place has them, so they are never the first either."""
    w = C.words(C.col(b, "text"), C.NEWLINE, C.SAME)
    marks = _marks(C.col(b, "_gone"), _in_docs(w, b.num_rows))
    at = np.flatnonzero((w.doc[1:] == w.doc[:-1]) & ((marks[1:] != marks[:-1]) | (marks[1:] == 0)))
    return w, (at, np.full(len(at), 2), C.mix(C.mix(w.hash[at] + U(1)) * U(0xD1342543DE82EF95) + w.hash[at + 1]))


def _repeats(docs: DataFrame, runs: Callable[[pa.RecordBatch], tuple[C.Words, Runs]], tag: str, s: C.Scratch) -> DataFrame:
    """doc_id, pos (first line in the document), n (lines) of the runs that an earlier place has, for docs' doc_id and text."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.pieces(batches):
            w, (at, n, h) = runs(b)
            pos = at - _in_docs(w, b.num_rows)[w.doc[at]]
            yield pa.RecordBatch.from_arrays([C.col(b, "doc_id").take(pa.array(w.doc[at])), pa.array(pos.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(h.view(np.int64))], ["doc_id", "pos", "n", "h"])

    seen = s.table(docs.mapInArrow(find, "doc_id long, pos int, n int, h long"), tag)
    often = seen.groupBy("h").agg(*(f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("doc_id", "pos"))).where("min_doc_id < max_doc_id or min_pos < max_pos").select("h")
    s.sized(seen.count())
    again = s.light(seen.join(often, "h", "left_semi").select("doc_id", "pos", "n").distinct(), tag + "-again")
    s.drop(seen)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.pieces(batches):
            w = C.words(C.col(b, "text"), C.NEWLINE, C.SAME, hashed=False)
            line_at = _in_docs(w, b.num_rows)
            doc, pos, num, data = [], [], [], []
            for i, (d, rs) in enumerate(zip(C.col(b, "doc_id").to_pylist(), C.col(b, "rs").to_pylist(), strict=True)):
                for r in rs:
                    k = line_at[i] + r["pos"]
                    if k + r["n"] > line_at[i + 1]:
                        continue
                    doc.append(d), pos.append(r["pos"]), num.append(r["n"])
                    data.append(re.sub(rb"\n+", b"\n", w.buf[w.start[k] : w.end[k + r["n"] - 1]].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(pos, pa.int32()), pa.array(num, pa.int32()), C.blobs(data)], ["doc_id", "pos", "n", "data"])

    lists = again.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "n")).alias("rs"))
    bytes_ = s.table(docs.select("doc_id", "text").join(C.small(lists, again), "doc_id").mapInArrow(cut, "doc_id long, pos int, n int, data binary"), tag + "-bytes")
    first = bytes_.groupBy("data").agg(F.min(F.struct("doc_id", "pos")).alias("keep"))
    later = (F.col("doc_id") > F.col("keep.doc_id")) | (F.col("pos") >= F.col("keep.pos") + F.col("n"))
    gone = s.light(bytes_.join(first, "data").where(later).select("doc_id", "pos", "n").distinct(), tag + "-gone")
    s.drop(again, bytes_)
    return gone


def _listed(docs: DataFrame, gone: DataFrame, name: str = "_gone") -> DataFrame:
    """docs with the list of each one's runs in `gone`, a written table, in the column `name`."""
    (own,) = C.fresh([*docs.columns, name], "gone_id")
    lists = gone.groupBy(F.col("doc_id").alias(own)).agg(F.collect_list(F.struct("pos", "n")).alias(name))
    return docs.join(C.small(lists, gone), F.col("doc_id") == F.col(own), "left").drop(own)


def repeated_runs(docs: DataFrame) -> DataFrame:
    """doc_id, pos, n of runs of lines to remove, for docs' doc_id and text."""
    docs = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    with C.Scratch(docs.sparkSession) as s:
        gone = _repeats(docs, whole_chunks, "line-chunks", s)
        return s.kept(gone.union(_repeats(_listed(docs, gone), pairs_of_lines, "line-pairs", s)), "line-runs")


def line_dedup(docs: DataFrame) -> DataFrame:
    """docs with repeated runs of lines cut from text, and _lines, _removed (lines), _chunks (removed whole); where docs has
    such a column itself, the new one's name ends in one more underscore."""
    names = docs.columns
    runs_of, *added = C.fresh(names, "_gone", "_lines", "_removed", "_chunks")

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.pieces(batches):
            texts = C.col(b, "text")
            w, first, lines, _, _ = chunks(texts)
            line_at = _in_docs(w, b.num_rows)
            gone = _marks(C.col(b, runs_of), line_at) > 0
            out = texts.to_pylist()
            at = np.append(0, np.cumsum(gone))
            removed = at[line_at[1:]] - at[line_at[:-1]]
            whole = (np.add.reduceat(gone.astype(np.int64), first) if len(first) else np.zeros(0)) == lines
            cut = np.bincount(w.doc[first[whole]], minlength=b.num_rows)
            for i in np.flatnonzero(removed):
                ks = np.arange(line_at[i], line_at[i + 1])
                ends = np.append(w.start[ks[1:]], w.at[i + 1] - 1)
                parts = [w.buf[w.at[i] : w.start[ks[0]]], *(w.buf[w.start[k] : e] for k, e in zip(ks, ends, strict=True) if not gone[k])]
                out[i] = b"".join(p.tobytes() for p in parts).decode("utf-8", "surrogatepass")
            done = [pa.array(out, pa.string()) if c == "text" else C.col(b, c) for c in names]
            yield pa.RecordBatch.from_arrays([*done, pa.array(w.per_doc.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(cut.astype(np.int64))], [*names, *added])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"`{c}` long" for c in added)])
    return _listed(docs, repeated_runs(docs), runs_of).mapInArrow(drop, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"), F.col("_chunks").alias("n_chunks_removed"), F.sha2("text", 256).alias("kept_sha256"))
