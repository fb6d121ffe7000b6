"""The operators against brute force, round trips and held-out labels; and odd inputs: nulls, empty, long, repeated, none, extra columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import common as C
from spindrift.llm import decontamination, flac_media, katz_lm, language_id, license_scan, line_dedup, mixing, ngram_join, registry, suffix_dedup, toxicity
from spindrift.llm.components import components
from spindrift.llm.packing import pack, pack_sorted, unpack, unpack_sorted

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, n long, pid int"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD))


def odd_texts():
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(300)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    shared, base = prose(60), prose(120)
    texts = [None, "", "   \n\t", "One", "Two words", "éè \U0001f600 x", prose(6000), "no-blank" * 4000]
    texts += [prose(40) + " " + shared + "\n" + prose(30) for _ in range(6)] + [base] * 4
    texts += [base.replace(" ", "  ", 1), base + " tail", shared, shared + "\n" + shared, "0\x001" * 40, "0\x001" * 40]
    for _ in range(12):
        w = base.split()
        w[r.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    C.ship(spark)
    rows = [(i * 3 % 101, t, "en", ["a", "b", None][i % 3], 1, "x", 2, 3) for i, t in enumerate(odd_texts())]
    return spark.createDataFrame(rows + rows[9:10] + [(None, "null id", None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    C.ship(spark)
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_packing_and_hashes():
    a = np.sort(np.random.default_rng(1).integers(0, 1 << 62, 1000)).astype(np.uint64)
    assert (unpack(pack(a)) == a).all() and (unpack_sorted(pack_sorted(a)) == a).all() and len(unpack(pack(a[:0]))) == 0


def test_suffix_dedup(docs, none):
    found = docs.where("doc_id is not null").select("doc_id", "text").distinct().collect()
    seen, want = set(), {}
    for i, t in sorted((r["doc_id"], (r["text"] or "").encode()) for r in found):
        own, gone = [t[k : k + 50] for k in range(len(t) - 49)], bytearray(len(t))
        for k, x in enumerate(own):
            if x in seen:
                gone[k : k + 50] = b"\1" * 50
        seen.update(own)
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        want[i] = (len(t), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    for how in ({"parts": 3, "per_range": 50}, {"parts": 1}, {"texts_too": False}):
        rows = suffix_dedup.suffix_dedup(docs, **how).collect()
        assert len(rows) == docs.count()
        assert all(tuple(r)[1:5] == want[r["doc_id"]] for r in rows if r["doc_id"] is not None)
        assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in rows if "kept" in r)
    assert suffix_dedup.suffix_dedup(none, 2).count() == 0


def test_loser_tree_orders_and_shares():
    r = random.Random(2)
    runs = [sorted(bytes(r.choice(b"ab") for _ in range(12)) for _ in range(r.randint(0, 40))) for _ in range(7)]
    lcp = lambda a, b: next((i for i in range(12) if a[i] != b[i]), 12)
    order, shared = suffix_dedup.merge_runs(runs, [[0] + [lcp(x, y) for x, y in zip(s, s[1:])] for s in runs])
    at, out = [0] * len(runs), []
    for k in order:
        out.append(runs[k][at[k]])
        at[k] += 1
    assert out == sorted(x for s in runs for x in s)
    assert shared[1:] == [lcp(x, y) for x, y in zip(out, out[1:])]


@pytest.mark.parametrize(("n", "percent", "broadcast"), [(3, 90, 1 << 24), (5, 80, 0)])
def test_jaccard_components(docs, none, monkeypatch, n, percent, broadcast):
    monkeypatch.setattr(C, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(ngram_join, "PAIRS_PER_ENTRY", 2 if broadcast else 0.01)  # more levels of centres
    sets, up = {}, {}
    for r in docs.where("doc_id is not null").collect():
        w = words(r["text"])
        sets[r["doc_id"]] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
        up[r["doc_id"]] = r["doc_id"]

    def top(x):
        return x if up[x] == x else top(up[x])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    rows = ngram_join.jaccard_components(docs, n, percent).collect()
    assert len(rows) == docs.count()
    assert all((r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), top(r["doc_id"])) for r in rows if r["doc_id"] is not None)
    assert ngram_join.jaccard_components(none, n, percent).count() == 0
    assert ngram_join.keep_one(docs, n, percent).columns == docs.columns


@pytest.mark.parametrize("at_once", [1_000_000, 7])
def test_components_of_a_chain(spark, monkeypatch, at_once):
    monkeypatch.setattr("spindrift.llm.components.LINKS_PER_TASK", at_once)
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 3)], "a long, b long")
    assert {r["id"]: r["component"] for r in components(links, C.Scratch(spark)).collect()} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_katz(docs, none):
    rows = docs.select("doc_id", "text").withColumn("train", F.coalesce(F.col("doc_id") % 4 != 1, F.lit(True)))
    data = [(r["doc_id"], words(r["text"]) + ["\0end"], r["train"]) for r in rows.collect()]
    c1, c2, ch, after = collections.Counter(), collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for _, ws, train in data:
        if train:
            for h, w in zip(["\0start", *ws], ws):
                c1[w] += 1
                c2[h, w] += 1
                ch[h] += 1
                after[h].add(w)
    n, sizes = sum(c1.values()), lambda c: np.array([0, *(sum(v == r for v in c.values()) for r in range(1, 7))])
    d1, d2 = katz_lm.discounts(sizes(c1)), katz_lm.discounts(sizes(c2))
    cut = lambda c, d: c * (d[c] if c <= 5 else 1)
    unknown = 1 - sum(cut(c, d1) for c in c1.values()) / n
    p1 = lambda w: cut(c1[w], d1) / n if c1[w] else unknown

    def p(h, w):
        if not ch[h]:
            return p1(w)
        held = sum(cut(c2[h, x], d2) for x in after[h])
        norm = ch[h] if 1 - held / ch[h] >= 1e-9 else held + 1
        return cut(c2[h, w], d2) / norm if c2[h, w] else (1 - held / norm) / (1 - sum(p1(x) for x in after[h])) * p1(w)

    for h in ["\0start", *list(ch)[1:4]]:
        assert sum(p(h, w) for w in c1) + p(h, "\0unknown") == pytest.approx(1)
    folder = f"{C.scratch_dir(docs.sparkSession)}/test-katz"
    results = [katz_lm.score(rows, range_tokens=300, keep=folder), katz_lm.score(rows.repartition(3))]
    results.append(katz_lm.score(rows, katz_lm.Model.load(docs.sparkSession, folder)))  # the stored model, none of the texts learned from
    cache = {}
    for result in results:
        got = collections.defaultdict(list)
        for r in result.collect():
            got[r["doc_id"]].append(r)
        for i, ws, train in data:
            want = sum(math.log10(cache.setdefault((h, w), p(h, w))) for h, w in zip(["\0start", *ws], ws))
            base = sum(math.log10((c1[w] + 1) / (n + len(c1) + 1)) for w in ws)
            r = got[i].pop()
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(c1[w] > 0 for w in ws), n)
            assert r["score"] == pytest.approx(want) and r["base_score"] == pytest.approx(base)
        assert not any(got.values())
    assert katz_lm.score(none.select("doc_id", "text").withColumn("train", F.lit(True))).count() == 0


def test_katz_scores_other_texts(spark, docs):
    folder = f"{C.scratch_dir(spark)}/test-katz-other"
    made = spark.createDataFrame([(1, "a b a b c", True), (2, "a b d", True), (3, "zz a b", False)], "doc_id long, text string, train boolean")
    both = by_id(katz_lm.score(made, keep=folder))
    other = by_id(katz_lm.score(made.where("doc_id = 3").withColumn("train", F.lit(True)), katz_lm.Model.load(spark, folder)))
    assert other[3]["score"] == pytest.approx(both[3]["score"]) and other[3]["train_tokens"] == both[3]["train_tokens"] == 10
    untrained = katz_lm.score(made.withColumn("train", F.lit(False))).collect()
    assert all(r["score"] == 0 and r["n_known"] == 0 for r in untrained)


def test_flac_round_trip_and_corruption():
    r = np.random.default_rng(3)
    loads = [b" " * 192, bytes(range(192)), r.integers(0, 256, 192 * 70, dtype=np.uint8).tobytes(), (b"\xff\xf8\x14\x02\x00" * 200)[:960], flac_media.payload("abé ".encode() * 400)]
    media = flac_media.encode(loads)
    for load, pcm in zip(loads, flac_media.decode(media), strict=True):
        assert (pcm.samples + 128).astype(np.uint8).tobytes() == load
        assert (pcm.first == np.arange(0, len(load), 192)).all() and len(pcm.seek) == -(-len(load) // 192 // 64)
    for i in range(120, len(media[4]), 97):
        with pytest.raises(ValueError):
            bad = bytearray(media[4])
            bad[i] ^= 0x10
            flac_media.decode([bytes(bad)])


class Writer:
    """Bits of a hand-made stream."""

    def __init__(self):
        self.bits = []

    def put(self, value, width):
        self.bits += [(value >> (width - 1 - i)) & 1 for i in range(width)]
        return self

    def bytes(self):
        self.bits += [0] * (-len(self.bits) % 8)
        return bytes(int("".join(map(str, self.bits[i : i + 8])), 2) for i in range(0, len(self.bits), 8))


def crc(data, poly, width):
    r = 0
    for byte in data:
        r ^= byte << (width - 8)
        for _ in range(8):
            r = ((r << 1) ^ poly if r >> (width - 1) else r << 1) & ((1 << width) - 1)
    return r


def made_frame(number, x, bps, kind, order=0, method=0, partitions=0, escape=(), coefs=(), shift=0, k=3):
    """A frame by the format's rules, one sample after the other. kind: constant, verbatim, fixed or lpc."""
    n = len(x)
    head = bytes([0xFF, 0xF8, 0x70, 0, number]) + (n - 1).to_bytes(2, "big")
    head += bytes([crc(head, 0x07, 8)])
    w = Writer().put({"constant": 0, "verbatim": 1, "fixed": 8 + order, "lpc": 31 + order}[kind] << 1, 8)
    if kind == "constant":
        w.put(x[0], bps)
    elif kind == "verbatim":
        for v in x:
            w.put(v, bps)
    else:
        for v in x[:order]:
            w.put(v, bps)
        if kind == "lpc":
            w.put(7, 4).put(shift, 5)
            for c in coefs:
                w.put(c, 8)
        else:
            coefs, shift = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][order], 0
        res = [x[i] - (sum(c * x[i - 1 - j] for j, c in enumerate(coefs)) >> shift) for i in range(order, n)]
        w.put(method, 2).put(partitions, 4)
        size, width = n >> partitions, 4 + method
        for p in range(1 << partitions):
            own = res[max(0, p * size - order) : (p + 1) * size - order]
            if p in escape:
                raw = max([0, *(v.bit_length() + 1 if v >= 0 else (~v).bit_length() + 1 for v in own)])
                w.put((1 << width) - 1, width).put(raw, 5)
                for v in own:
                    w.put(v, raw)
            else:
                w.put(k, width)
                for v in own:
                    z = 2 * v if v >= 0 else -2 * v - 1
                    w.put(0, z >> k).put(1, 1).put(z & ((1 << k) - 1), k)
    out = head + w.bytes()
    return out + crc(out, 0x8005, 16).to_bytes(2, "big")


def made_stream(frames, bps, total):
    info = (16).to_bytes(2, "big") + (65535).to_bytes(2, "big") + bytes(6) + ((8000 << 44) | ((bps - 1) << 36) | total).to_bytes(8, "big") + bytes(16)
    return b"fLaC" + bytes([0x80, 0, 0, 34]) + info + b"".join(frames)


@pytest.mark.parametrize("bps", [8, 12, 16, 24])
def test_flac_decodes_every_kind_of_subframe(bps):
    r = random.Random(bps)
    top = 1 << (bps - 1)
    walk = [0]
    while len(walk) < 64:
        walk.append(max(-top, min(top - 1, walk[-1] + r.randint(-9, 9))))
    noise = [r.randrange(-top, top) for _ in range(64)]
    wide = max(3, bps - 4)
    frames = [
        ([r.randrange(-top, top)] * 64, {"kind": "constant"}),
        (noise, {"kind": "verbatim"}),
        *((walk, {"kind": "fixed", "order": o, "partitions": 2}) for o in range(5)),
        (noise, {"kind": "fixed", "order": 1, "method": 1, "k": wide, "partitions": 1}),
        (noise, {"kind": "fixed", "order": 2, "partitions": 2, "escape": (0, 2), "k": min(wide, 14)}),
        (walk, {"kind": "fixed", "order": 0, "partitions": 3, "escape": (1,), "k": 2, "method": 1}),
        ([7] * 64, {"kind": "fixed", "order": 1, "partitions": 1, "escape": (1,)}),
        (walk, {"kind": "lpc", "order": 3, "coefs": (40, -12, 5), "shift": 5, "partitions": 1}),
        (walk, {"kind": "lpc", "order": 8, "coefs": (30, -9, 5, 3, 1, 0, -2, 1), "shift": 5, "k": 4}),
    ]
    made = [made_frame(i, x, bps, **how) for i, (x, how) in enumerate(frames)]
    samples = [v for x, _ in frames for v in x]
    stream = made_stream(made, bps, len(samples))
    (pcm,) = flac_media.decode([stream])
    assert pcm.samples.tolist() == samples and pcm.bits == bps
    assert pcm.offset.tolist() == [sum(map(len, made[:i])) for i in range(len(made))]
    assert all(flac_media.samples_at(stream, a, n).tolist() == samples[a : a + n] for a, n in ((0, 5), (60, 70), (len(samples) - 3, 3), (200, 0)))
    with pytest.raises(ValueError):
        flac_media.samples_at(stream, len(samples), 1)


def test_flac_seeks(monkeypatch):
    load = flac_media.payload("".join(chr(97 + i * i % 26) for i in range(192 * 200)).encode())
    (media,) = flac_media.encode([load])
    want = np.frombuffer(load, np.uint8).astype(int) - 128
    read = []
    real = flac_media._subframes
    monkeypatch.setattr(flac_media, "_subframes", lambda buf, *a: read.append(len(buf)) or real(buf, *a))
    for a, n in ((0, 16), (192 * 64, 1), (192 * 130 + 7, 500), (len(want) - 16, 16)):
        read.clear()
        assert (flac_media.samples_at(media, a, n) == want[a : a + n]).all() and len(read) <= n // 192 + 2
    at = media.index(b"fLaC") + 4 + 38 + 4 + 18 + 8  # the second seek point's offset
    with pytest.raises(ValueError, match="seek"):
        flac_media.decode([media[: at + 7] + bytes([media[at + 7] ^ 1]) + media[at + 8 :]])


def test_flac_blocks_as_a_table(spark, docs):
    C.ship(spark)
    media = C.materialize(flac_media.stored(docs.where("doc_id is not null").select("doc_id", "text").distinct()), "test-media")
    blocks = C.materialize(flac_media.pcm_blocks(media), "test-blocks")
    texts = {r["doc_id"]: flac_media.payload((r["text"] or "").encode()) for r in docs.where("doc_id is not null").collect()}
    streams = by_id(media)
    for r in blocks.collect():
        a, n = r["first_sample"], r["n_samples"]
        assert bytes(b ^ 0x80 for b in r["pcm"]) == texts[r["doc_id"]][a : a + n] and a % (192 * 64) == 0
        *_, begin = flac_media._opened(streams[r["doc_id"]]["media"])
        assert streams[r["doc_id"]]["media"][begin + r["byte_offset"] :][:2] == b"\xff\xf8"
    assert {r["doc_id"]: r["n"] for r in blocks.groupBy("doc_id").agg(F.sum("n_samples").alias("n")).collect()} == {k: len(t) for k, t in texts.items()}


def test_flac_of_texts(docs, none):
    for r in flac_media.describe(docs).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        load = flac_media.payload((r["text"] or "").encode())
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len((r["text"] or "").encode()), len(load), hashlib.sha256(load).hexdigest(), zlib.crc32(load[-16:]))
    assert flac_media.describe(none).count() == 0


def test_language_id(spark, docs, none):
    real = C.table(spark, SF, "documents")
    got = language_id.query(spark, SF).where("held_out").join(real.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got) > 0
    odd = by_id(language_id.predict(docs, language_id.fit(real), ["doc_id"]))
    assert all(odd[i]["lang_pred"] == "und" and odd[i]["score"] == 0 for i in (0, 3, 6))
    assert language_id.predict(none, language_id.fit(none), ["doc_id"]).count() == 0
    assert {r["lang_pred"] for r in language_id.predict(docs, language_id.fit(none), ["doc_id"]).collect()} == {"und"}
    assert language_id.keep_known(real).count() == real.count()


def bayes(train, texts):
    """Naive Bayes by the same cells, one n-gram after the other."""
    cut = lambda x: x & 0xFFFFFFFF
    names = sorted({la for _, la in train})

    def cells(t):
        t = f" {t.lower()} "
        for i in range(len(t)):
            a, b, c = (ord(t[j]) if j < len(t) else 32 for j in (i, i + 1, i + 2))
            two = cut(a * 0x9E3779B1 + b * 0x85EBCA77)
            three = cut(two + c * 0xC2B2AE3D)
            yield cut((two ^ (two >> 15)) * 0x2C1B3C6D) >> 16
            yield cut((three ^ (three >> 15)) * 0x297A2D39) >> 16

    counts = {la: collections.Counter(c for t, x in train if x == la for c in cells(t)) for la in names}
    out = []
    for t in texts:
        if not t or not any(ch.isalpha() for ch in t):
            out.append(("und", 0.0))
            continue
        own = list(cells(t))
        logs = [sum(math.log((counts[la][c] + 0.5) / (sum(counts[la].values()) + 0.5 * 65536)) for c in own) / len(own) * min(len(own), 200) for la in names]
        out.append((names[logs.index(max(logs))], 1 / sum(math.exp(x - max(logs)) for x in logs)))
    return out


@pytest.mark.parametrize("at_once", [256, 2])
def test_language_id_equals_brute_force(spark, monkeypatch, at_once):
    monkeypatch.setattr(language_id, "LANGUAGES_AT_ONCE", at_once)
    train = [("the cat sat on the mat and the dog", "en"), ("der hund und die katze im haus", "de"), ("le chat est sur la table", "fr"), ("el perro y la casa de la calle", "es"), ("the house of the dog", "en"), ("il cane nella casa", "it")]
    texts = ["the dog", "die katze", "la casa", "x", "", None, "12 ½ ² Ⅷ ①", "chat chat", "ǅ", "the cat. " * 50, "la\U0001f600 mesa"]
    model = language_id.fit(spark.createDataFrame([(i, *x) for i, x in enumerate(train)], "doc_id long, text string, lang string"))
    rows = spark.createDataFrame([(i, t, "y") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    got = by_id(language_id.predict(rows, model, ["doc_id", "score"]))
    for i, (name, share) in enumerate(bayes(train, texts)):
        assert got[i]["lang_pred"] == name and got[i]["score_"] == pytest.approx(share, rel=1e-4) and got[i]["score"] == "y"


def test_language_id_does_not_see_neighbours(spark):
    r = random.Random(9)
    made = C.table(spark, SF, "documents").select("doc_id", F.substring_index("text", " ", 1).alias("text"), "lang")
    model = language_id.fit(C.table(spark, SF, "documents"))
    seen = [sorted(map(tuple, language_id.predict(made.repartition(n).orderBy(F.rand(n)), model, ["doc_id"]).collect())) for n in (1, 3, r.randint(4, 9))]
    assert seen[0] == seen[1] == seen[2]


def test_kept_columns_may_have_the_results_names(spark):
    made = C.table(spark, SF, "documents").withColumns({c: F.lit(i) for i, c in enumerate(["score", "lang_pred", "_lines", "_gone", "_gone_id", "copy", "_size", "_key", "pos", "n", "token", "a", "b", "rs", "h"])})
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, made, SF)
        assert got.columns[: len(made.columns)] == made.columns and (stage is corpus_pipeline.to_weights or got.columns == made.columns), name
        row = got.first()
        assert all(row[c] == i for i, c in enumerate(["score", "lang_pred", "_lines", "_gone", "_gone_id", "copy", "_size", "_key"])), name


def test_toxicity(spark, docs, none):
    rows = [(i, "A plain line. " * (i % 7 + 1) + ("You scum! " if i % 5 == 0 else "") + f"Word{i % 11} ends.") for i in range(400)]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(made, labels)
    got = by_id(toxicity.score(made, model, ["doc_id"]))
    assert all((got[i]["score"] >= 0.3) == (i % 5 == 0) for i in range(300, 400))
    text = rows[305][1]
    assert text[got[305]["worst_start"] : got[305]["worst_end"]] == "You scum"
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(docs, model, ["doc_id"]).collect())
    assert toxicity.score(none, toxicity.fit(none, labels.limit(0)), ["doc_id"]).count() == 0


def test_toxicity_returns_every_sentence(spark, none):
    import pyarrow as pa

    model = np.append(np.zeros(1 << toxicity.BITS), -5.0)
    model[toxicity.features(pa.array(["scum"]))[1]] = 10.0
    texts = ["You scum. Fine day. Scum again!\nNothing", "é plain", "", None, "é. Old scum"]
    got = by_id(toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, ["doc_id"]))
    spans = {i: [(texts[i].encode()[s["start"] : s["end"]].decode(), s["score"] > 0.9) for s in r["toxic_sentences"]] for i, r in got.items()}
    assert spans == {0: [("You scum", True), ("Scum again", True)], 1: [], 2: [], 3: [], 4: [("Old scum", True)]}


def shared_out(sizes, weights, total, most=3.0):
    """Targets by filling up, source after source."""
    target, open_, rest = {}, dict(zip(sizes, weights)), float(total)
    while open_:
        by = sum(open_.values())
        over = [k for k in open_ if rest * open_[k] / by > most * sizes[k]]
        if not over:
            return target | {k: rest * w / by for k, w in open_.items()}
        for k in over:
            target[k] = most * sizes[k]
            rest -= target[k]
            del open_[k]
    return target


def test_mixing(spark, docs, none):
    r = random.Random(4)
    rows = [(i, "w " * int(r.paretovariate(1) * 5), r.choice(["a", "b", "c", None] + ["d"] * 4)) for i in range(3000)] + [(5000, " ", "e"), (5001, None, "e")]
    made = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(made).collect()
    again = mixing.mix(made.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    names = ["a", "b", "c", "d", "e", None]
    target = shared_out({s: sizes[s] for s in names}, [1, 2, 3, 1, 2, 3], sum(sizes.values()))
    taken = collections.Counter()
    for x in got:
        taken[x["source"]] += x["_size"] * x["_copies"]
        assert x["_size"] == len((x["text"] or "").split()) and x["_source_size"] == sizes[x["source"]] and x["_target"] == pytest.approx(target[x["source"]])
        assert math.floor(x["_rate"] + 1e-9) <= x["_copies"] <= math.floor(x["_rate"] + 1e-9) + 1 <= 4 and x["_copies"] <= 3
    assert all(abs(taken[s] - target[s]) <= 12 for s in names)
    rates = {(x["source"], x["_size"].bit_length()): x["_rate"] for x in got}
    assert len({v for (s, _), v in rates.items() if s == "d"}) > 1  # documents of a source have rates of their own
    assert sum(x["_size"] * x["_rate"] for x in got if x["source"] == "a") == pytest.approx(target["a"])
    assert mixing.mix(none).count() == 0 and mixing.mix(docs).count() == docs.count()


def test_mixing_has_many_sources_and_clashing_names(spark):
    rows = [(i, "w " * (i % 37), f"s{i % 700:04}", 1, 2, 3, "x") for i in range(4000)]
    made = spark.createDataFrame(rows, "doc_id long, text string, source string, _size int, _key int, copy int, _copies string")
    got = mixing.mix(made)
    sizes = collections.Counter()
    for _, t, s, *_ in rows:
        sizes[s] += len(t.split())
    names = sorted(sizes)
    target = shared_out({s: sizes[s] for s in names}, [1 + i % 3 for i in range(700)], sum(sizes.values()))
    assert got.columns[:7] == made.columns
    for x in got.collect():
        assert x["_target"] == pytest.approx(target[x["source"]]) and (x["_size"], x["_copies"], x["copy"]) == (1, "x", 3)
    assert mixing.mixed(made).columns == [*made.columns, "copy_"]


def test_copies_follow_the_multipliers(spark, monkeypatch):
    made = spark.createDataFrame([(i, "w " * (1 + i % 60), "ab"[i % 7 < 2]) for i in range(2000)], "doc_id long, text string, source string")
    copies = lambda: [r["_copies"] for r in mixing.mix(made).orderBy("doc_id").collect()]
    before = copies()
    monkeypatch.setattr(mixing, "balance", lambda *_: np.linspace(0, 2, mixing.CLASSES))
    assert copies() != before


def test_balance_solves_the_dual(spark):
    """Against plain iterative scaling of both margins, with classes that can hold exactly."""
    tokens = np.zeros((2, mixing.CLASSES), np.int64)
    tokens[:, :3] = [[10, 30, 40], [20, 40, 10]]
    target, goal = [90.0, 60.0], [60.0, 50.0, 40.0]
    table = spark.createDataFrame([(t.tolist(), int(t.sum()), g) for t, g in zip(tokens, target)], "tokens array<long>, size long, target double")
    mu = mixing.balance(table, 9.0, 1e-9, goal + [0.0] * (mixing.CLASSES - 3))
    rate, _ = mixing.solve(tokens.astype(float), np.array(target), mu, 9.0)
    x = tokens[:, :3].astype(float)
    for _ in range(2000):
        x *= (np.array(target) / x.sum(1))[:, None]
        x *= np.array(goal) / x.sum(0)
    assert np.allclose((tokens * rate)[:, :3], x, rtol=1e-5)


def test_solve_keeps_rates_under_the_most():
    tokens = np.zeros((2, mixing.CLASSES))
    tokens[:, :2] = [[10, 90], [50, 50]]
    rate, free = mixing.solve(tokens, np.array([250.0, 60.0]), np.array([2.0, 0.0] + [0.0] * 22), 3.0)
    assert np.allclose((tokens * rate).sum(1), [250, 60]) and rate.max() == 3.0 and not free[0, 0] and free[1].all()


def test_rounding_carries_to_smaller_documents():
    import pyarrow as pa

    t = pa.table({"key": ["a"] * 31, "class": pa.array([9] + [3] * 30, pa.int32()), "bin": pa.array(range(31), pa.int32()), "tokens": [1000] + [20] * 30, "rate": [0.3] * 31})
    got = mixing.rounded(t, 3.0).to_pylist()
    assert [(r["class"], r["base"], r["below"]) for r in got] == [(9, 0, 0), (3, 0, 25)]  # 0.3 of 1600 words, in documents of 20


def test_line_dedup(spark, docs, none):
    passage = "\n".join(f"shared line {i} of the passage" for i in range(30))
    rows = [(i, f"own {i}\nfirst {i * 7}\n{passage}\nlast {i}") for i in range(6)] + [(9, "alone\nin\nthe\nworld")]
    got = by_id(line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got[0]["_removed"] == 0 and got[9]["text"] == rows[6][1]
    for i in range(1, 6):
        assert got[i]["_removed"] >= 15 and got[i]["text"].startswith(f"own {i}") and got[i]["text"].endswith(f"last {i}")
        assert set(got[i]["text"].split("\n")) <= set(rows[i][1].split("\n"))
    odd = line_dedup.line_dedup(docs)
    assert odd.count() == docs.count() and odd.columns[: len(docs.columns)] == docs.columns
    assert line_dedup.line_dedup(none).count() == 0


def test_line_dedup_finds_every_repeated_run(spark):
    r = random.Random(8)
    passages = [[f"passage {k} line {i}" for i in range(n)] for k, n in enumerate([2, 2, 3, 5, 8, 20, 50])]
    texts = []
    for d in range(40):
        lines = [f"own {d} {i}" for i in range(r.randint(1, 6))]
        for p in r.sample(passages, 2):
            at = r.randint(0, len(lines))
            lines[at:at] = p
        texts.append(lines)
    texts += [["same"] * 3, ["same"] * 5, [r.choice("xyz") for _ in range(60)]]
    first, want = {}, {}
    for d, lines in enumerate(texts):
        for i, pair in enumerate(zip(lines, lines[1:])):
            first.setdefault(pair, (d, i))
    for d, lines in enumerate(texts):
        gone = {k for i, pair in enumerate(zip(lines, lines[1:])) for k in (i, i + 1) if first[pair][0] < d or first[pair][1] <= i - 2}
        want[d] = ["\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone)]
    got = by_id(line_dedup.line_dedup(spark.createDataFrame([(d, "\n".join(x)) for d, x in enumerate(texts)], "doc_id long, text string")))
    assert {d: [x["text"].rstrip("\n"), x["_removed"]] for d, x in got.items()} == want


def test_line_dedup_ignores_blank_lines(spark):
    lines = [f"shared line {i}" for i in range(12)]
    rows = [(0, "\n\n".join(lines)), *((i, f"own {i}\n" + "\n".join(lines)) for i in (1, 2)), (3, "own 3\n" + "\n\n".join(lines))]
    got = by_id(line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: (x["text"], x["_removed"]) for i, x in got.items()} == {0: (rows[0][1], 0), **{i: (f"own {i}\n", 12) for i in (1, 2, 3)}}


def test_decontamination(spark, docs, none):
    item = "A train leaves at 10 with 45 kg of coal and meets Anna after 3 hours near the old bridge by the river where it stops"
    again = item.replace("10", "77").replace("45", "12").replace("Anna", "Peter")
    mixed = "a train leaves at 5 with 6 kg of coal and meets Mia after 7 hours near the old bridge by the river where it stops"
    bench = spark.createDataFrame([(1, item), (2, None), (3, "short one"), (None, item)], "item_id long, text string")
    rows = [(1, f"Some words before. {item} and after."), (2, f"It said: {again}."), (3, "Nothing to see here, just a train and a bridge by the river."), (4, "short one"), (5, None), (6, ""), (None, item), (7, mixed)]
    got = decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 1), (2, 1), (4, 3), (7, 1)}
    assert next(r for r in got if r["doc_id"] == 2)["n_verbatim"] < next(r for r in got if r["doc_id"] == 1)["n_verbatim"]
    assert decontamination.contaminated(docs, bench).count() == 0 and decontamination.contaminated(none, bench).count() == 0
    assert decontamination.keep_clean(docs, bench).count() == docs.count()
    real, b = C.table(spark, SF, "documents"), C.table(spark, SF, "benchmark")
    held = {r["doc_id"] for r in real.collect() if any(x["text"] in r["text"] for x in b.collect())}
    assert held <= {r["doc_id"] for r in decontamination.contaminated(real, b).collect()}


def test_decontamination_of_each_occurrence(spark):
    shop = "A shop sells {} pens for {} dollars and {} pads for {} dollars to each of {} pupils. How many dollars do {} pupils pay?"
    fruit = "Tom has {} apples and Ann has {} apples and then Tom has {} apples and Ann has {} apples in the basket near the door"
    bench = spark.createDataFrame([(1, shop.format(12, 30, 5, 20, 4, 7)), (2, fruit.format(3, 5, 7, 9))], "item_id long, text string")
    rows = [(1, shop.format(11, 31, 6, 21, 3, 8) + " " + shop.format(14, 35, 9, 25, 2, 6)), (2, fruit.format(13, 15, 17, 19)), (3, shop.format(11, 31, 6, 21, 3, 8))]
    got = decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 1), (2, 2), (3, 1)}


def test_decontamination_of_slots_and_short_items(spark):
    sums = "Compute 3 + 4 * 5 - 6 / 2 + 7 * 8 - 9 + 10 * 11 - 12"
    bench = spark.createDataFrame([(1, sums), (2, "What is the capital of France?")], "item_id long, text string")
    rows = [(1, f"Now to work.\n{sums}. Well done."), (2, "They asked: what is the capital of France? Nobody knew."), (3, "Compute 4 + 3 * 6 - 5 / 3 + 8 * 7 - 10 + 9 * 12 - 11"), (4, "Paris is the largest town of France and its capital")]
    got = decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 1), (2, 2)}


def test_decontamination_of_names_anywhere(spark):
    pens = "Natalia buys 12 pens. Natalia gives 5 pens to Tom. Natalia sells 3 pens. How many pens does Natalia have?"
    met = "Yesterday Tom met Anna near the old bridge while Peter sold 3 books to Maria before supper"
    bench = spark.createDataFrame([(1, pens), (2, met)], "item_id long, text string")
    rows = [(1, pens.replace("Natalia", "Elena").replace("12", "20")), (2, met.replace(" Anna", "\nAnna").replace(" Peter", "\nPeter")), (3, met.replace("Tom", "(Jim)").replace("Anna", '  "Eva"').replace("Peter", "\nPaul"))]
    got = decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 1), (2, 2), (3, 2)}


def contaminated_by_hand(docs, items):
    """The pairs, found by comparing every window of every item with every place of every text."""
    import regex

    def families(text):
        bare = regex.sub(r"[^\p{L}\p{N}\x20\x09-\x0D]+", "", text)
        placed = regex.sub("[0-9]+", "\1", bare)
        units = "|".join(sorted(decontamination.UNITS, key=len, reverse=True))
        placed = regex.sub(rf"(\x01[\x20\x09-\x0D]*+)(?:{units})(?!\p{{L}})", "\\1\2", placed)
        common = "|".join(decontamination.COMMON)
        placed = regex.sub(rf"(?<!\p{{L}})(?!(?i:{common})(?!\p{{L}}))\p{{Lu}}\p{{Ll}}+", "\3", placed)
        return bare.split(), [placed.lower().split(), bare.lower().split()]

    found = set()
    for item, text in items:
        iraw, iwords = families(text)
        size = min(8, len(iraw))
        places = [[i for i in range(len(w) - size + 1) if size] for w in iwords]
        places[0] = [i for i in places[0] if sum(x[0] in "\1\2\3" for x in iwords[0][i : i + size]) <= size // 2]
        enough = [min(6, -(-len(p) // 2)) for p in places]
        for doc, whole in docs:
            draw, dwords = families(whole)
            at = [collections.defaultdict(list), collections.defaultdict(list)]
            for f in (0, 1):
                for d in range(len(draw) - size + 1):
                    at[f][tuple(dwords[f][d : d + size])].append(d)
            hits = [[(i, d) for i in places[f] for d in at[f].get(tuple(iwords[f][i : i + size]), ())] for f in (0, 1)]
            if not any(h and len({i for i, _ in h}) >= e for h, e in zip(hits, enough)):
                continue
            for f, own in enumerate(hits):
                shifts = sorted({d - i for i, d in own})
                spans = [[s] for s in shifts[:1]]
                for a, b in zip(shifts, shifts[1:]):
                    if b - a > 8:
                        spans.append([])
                    spans[-1].append(b)
                for chosen in [*([s] for s in shifts), *spans, shifts]:
                    some = [(i, d) for i, d in own if d - i in chosen]
                    values = collections.defaultdict(set)
                    for i, d in some:
                        for k in range(size):
                            if f == 0 and any(c in "\1\2\3" for c in iwords[0][i + k]):
                                values[iwords[0][i + k], iraw[i + k]].add(draw[d + k])
                    if some and len({i for i, _ in some}) >= enough[f] and sum(len(v) == 1 for v in values.values()) >= 0.8 * len(values):
                        found.add((doc, item))
    return found


def test_decontamination_equals_brute_force(spark):
    r = random.Random(12)
    names, nouns = ["Anna", "Tom", "Élise", "Mia", "Otto"], ["pens", "apples", "km", "books", "kg", "old maps"]
    shapes = ["{n} has {x} {w} and gives {y} {w} to {m}. How many {w} does {n} have left in the end?", "On Monday {n} walked {x} km, then {y} miles; {m} took {z} hours.\nWho was faster on the long way home?", "{x} + {y} * {z} - 3 equals what number, asks {m}?", "Where is {n}?", "the same words come again and again and the same words come again and again here"]
    make = lambda t: t.format(n=r.choice(names), m=r.choice(names), w=r.choice(nouns), x=r.randint(1, 9), y=r.randint(10, 99), z=f"{r.randint(1, 9)}.5")
    items = [(i, make(shapes[i % 5])) for i in range(10)]
    docs = []
    for d in range(60):
        parts = []
        for _ in range(r.randint(1, 4)):
            text = r.choice([make(r.choice(shapes)), r.choice(items)[1], "some plain filler words of no meaning at all"])
            words = text.split(" ")
            for _ in range(r.choice([0, 0, 1, 3])):
                at = r.randrange(len(words))
                words[at : at + r.randint(0, 1)] = r.choice([["extra"], ["Words"], [], ["(7)"]])
            parts.append(r.choice([" ", "  ", "\n"]).join(words))
        docs.append((d, " ".join(parts)))
    got = decontamination.contaminated(spark.createDataFrame([*docs, *docs[:5]], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = contaminated_by_hand(docs, items)
    assert {(x["doc_id"], x["item_id"]) for x in got} == want and len(got) == len(want) > 20 and len(want) < 300


def test_license_scan(spark, none):
    rows = [(1, "p/LICENSE", "Released under the MIT License."), (2, "p/a/b.txt", "code\n" * 5), (3, "p/a/c.txt", "code here\n" * 9 + "Licensed under the Apache License, Version 2.0."), (4, "q/x.txt", "licensed to nobody at all, as the words of this line have little to do with templates"), (5, None, None), (6, "p/a/d/LICENSE", "This work is licensed under the GNU General Public License, version 3."), (7, "p/a/d/e/f.c", "")]
    got = by_id(license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string")))
    assert [(got[i]["license"], got[i]["basis"]) for i in range(1, 8)] == [("mit", "own"), ("mit", "inherited"), ("apache-2.0", "own"), (None, "none"), (None, "none"), ("gpl-3.0", "own"), ("gpl-3.0", "inherited")]
    assert got[2]["directory"] == "p" and got[7]["directory"] == "p/a/d"
    assert license_scan.license_scan(none.withColumn("path", F.lit("a/b"))).count() == 0


def test_license_files_and_headers(spark):
    """Whole texts of licenses in files with and without a telling name, their titles or holders; headers in comments."""
    named = {k: v.replace("Copyright (c)", "Copyright (c) 2021 Some Holder and Friends,") for k, v in license_scan.TEXTS.items()}
    untitled = named["mit"].removeprefix("MIT License ")
    header = license_scan.NOTICES["apache-2.0"][2]
    comment = "\n".join(f" * {header[i : i + 60]}" for i in range(0, len(header), 60))
    gpl = license_scan.NOTICES["gpl-3.0"][2]
    rows = [(i, f"p{i}/{'LICENSE' if i % 2 else 'terms.txt'}", "\n".join(re.split(r"(?<=[.:]) (?=[A-Z0-9])", named[k]))) for i, k in enumerate(sorted(named))]
    rows += [(20, "m/COPYING", untitled.replace(". ", ".\n\n")), (21, "m/src/a.c", "int x;\n" * 9), (22, "c/a.java", f"/*\n * Copyright 2020 Me. All rights reserved.\n *\n{comment}\n */\npackage x;\n" + "class A {}\n\n" * 30), (23, "c/b.java", "class B {}")]
    rows += [(24, "g/a.py", "# " + gpl.replace(" under", "\n# under").replace(" either", "\n# either") + "\n\nimport os\n\nprint(os)\n" * 20), (25, "z/notes.txt", "permission slips are due on monday, and the copy of the software is with the office. " * 30), (26, "z/LICENSE", "Ask the office."), (None, "z/LICENSE", untitled)]
    got = by_id(license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string")))
    assert {sorted(named)[i]: got[i]["license"] for i in range(len(named))} == {k: k for k in named}
    assert [(got[i]["license"], got[i]["basis"]) for i in (20, 21, 22, 23, 24, 25, 26)] == [("mit", "own"), ("mit", "inherited"), ("apache-2.0", "own"), (None, "none"), ("gpl-3.0", "own"), (None, "none"), (None, "none")]


def test_native_operators_run_no_python(spark):
    """No plan that ran for them, those of the written tables included, has a Python node."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    before = store.executionsCount()
    for m in (license_scan, decontamination):
        m.query(spark, SF).write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    plans = [store.executionsList().apply(i).physicalPlanDescription() for i in range(store.executionsList().size())][-(store.executionsCount() - before) :]
    assert len(plans) > 10 and not any(re.search("Python|Pandas|Arrow", p) for p in plans)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = registry.queries()[name](spark, SF)
    want = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r)) for r in got.select(names).collect())


def lines_by_hand(texts):
    """Of texts by id: without the runs of two lines or more that stand at an earlier place."""
    first = {}
    split = {i: [x for x in t.split("\n") if x] for i, t in texts.items()}
    for i in sorted(split):
        for k, pair in enumerate(zip(split[i], split[i][1:])):
            first.setdefault(pair, (i, k))
    out = {}
    for i, lines in split.items():
        gone = {j for k, pair in enumerate(zip(lines, lines[1:])) for j in (k, k + 1) if first[pair][0] < i or first[pair][1] <= k - 2}
        out[i] = [x for k, x in enumerate(lines) if k not in gone]
    return out


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Stage after stage on whole small tables with nulls, empty texts, copies, near copies and benchmark items."""
    import corpus_pipeline

    real = [r.asDict() for r in C.table(spark, SF, "documents").orderBy("doc_id").limit(90).collect()]
    bench = [(r["item_id"], r["text"]) for r in C.table(spark, SF, "benchmark").collect()]
    longest = max(real, key=lambda r: len(r["text"]))
    more = [None, "", " \n ", "123 456", longest["text"], longest["text"] + " and one more word", longest["text"].replace(" ", "  "), "Before it. " + bench[0][1] + " After it.", real[3]["text"] + "\n" + real[4]["text"]]
    rows = real + [{"doc_id": 10_000 + i, "text": t, "lang": [None, "en"][i % 2], "source": [None, "src0"][i % 2], "n_chars": None} for i, t in enumerate(more)]
    rows += [{**real[5]}, {"doc_id": None, "text": "a null id", "lang": None, "source": None, "n_chars": 1}]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    folder = str(tmp_path)
    spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], schema).write.parquet(folder + "/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(folder + "/benchmark.parquet")
    tell = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)
    stages = dict(corpus_pipeline.STAGES)
    docs = C.table(spark, folder, "documents")
    step = lambda name: C.materialize(stages[name](spark, docs, folder), "test")

    train = [(r["text"], r["lang"]) for r in rows if r["lang"] and r["text"] is not None and r["doc_id"] is not None]
    before, docs = tell(docs), step("language ID")
    told = bayes(train, [t for _, t in before])
    assert tell(docs) == [x for x, (la, share) in zip(before, told) if la != "und" and share >= 0.5]

    before, docs = tell(docs), step("line dedup")
    want = lines_by_hand({i: t for i, t in before if i is not None})
    assert all([x for x in t.split("\n") if x] == want[i] for i, t in tell(docs) if i is not None) and len(tell(docs)) == len(before)

    before, docs = tell(docs), step("n-gram Jaccard join")
    sets = {i: {tuple(words(t)[k : k + 5]) for k in range(max(1, len(words(t)) - 4))} - {()} for i, t in before if i is not None}
    up = {i: i for i in sets}
    top = lambda x: x if up[x] == x else top(up[x])
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    assert tell(docs) == [x for x in before if x[0] is None or top(x[0]) == x[0]] and len(tell(docs)) < len(before)

    before, docs = tell(docs), step("benchmark decontamination")
    bad = {i for i, _ in contaminated_by_hand([x for x in before if x[0] is not None], bench)}
    assert bad and tell(docs) == [x for x in before if x[0] not in bad]

    before, out = docs.collect(), step("mixing sources to target weights").collect()
    sizes = collections.Counter()
    for r in before:
        sizes[r["source"]] += len((r["text"] or "").split())
    names = sorted(sizes, key=lambda x: (x is None, x))
    target = shared_out({n: sizes[n] for n in names}, [1 + i % 3 for i in range(len(names))], sum(sizes.values()))
    copies = collections.Counter((r["doc_id"], r["text"]) for r in out)
    assert max(copies.values()) <= 3 * max(collections.Counter((r["doc_id"], r["text"]) for r in before).values()) and {x for x in copies} <= {(r["doc_id"], r["text"]) for r in before}
    taken = collections.Counter()
    for r in out:
        taken[r["source"]] += len((r["text"] or "").split())
    largest = {n: max((len((r["text"] or "").split()) for r in before if r["source"] == n), default=0) for n in names}
    assert all(abs(taken[n] - target[n]) <= largest[n] for n in names)
    run = corpus_pipeline.run(spark, folder)
    assert sorted(map(repr, run.collect())) == sorted(map(repr, out))


def test_toxicity_scores_equal_brute_force(spark, docs):
    import pyarrow as pa

    vocabulary = ["one", "two", "bad", "worse", "fine", "é"]
    model = np.append(np.zeros(1 << toxicity.BITS), -2.5)
    weight = {"bad": 1.5, "worse": 3.0, "fine": -2.0}
    for w, v in weight.items():
        model[toxicity.features(pa.array([w]))[1]] = v
    r = random.Random(3)
    texts = ["".join(r.choice(vocabulary) + r.choice([" ", ", ", ". ", "!", "?\n", "\n"]) for _ in range(r.randint(0, 60))) for _ in range(80)] + [None, "", "...", "Bad\x00WORSE"]
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    got = by_id(toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, ["doc_id"]))
    for i, t in enumerate(texts):
        none, most = 1 - sigmoid(-2.5), []
        for sentence in re.split(rb"[.!?\n]", (t or "").encode()):
            ws = [w.decode().translate(FOLD) for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", sentence)]
            if any(w in weight for w in ws):
                most.append(sigmoid(sum(weight.get(w, 0) for w in ws) - 2.5))
                none *= 1 - most[-1]
        assert got[i]["score"] == pytest.approx(1 - none)
        assert sorted(s["score"] for s in got[i]["toxic_sentences"]) == pytest.approx(sorted(x for x in most if x >= 0.3))


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert set(registry.queries()) | {"pipeline"} <= names and set(entry.oracle_sql()) <= names
    assert sorted(int(q[2:].split("_")[0]) for q in registry.queries()) == list(range(1, 11))
