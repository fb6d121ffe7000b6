"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Texts are stripped of all but letters, digits and blanks; then numbers, names and units become typed placeholders and
words are lower-cased. Windows of
WINDOW canonical words of every whole document are hash-joined with those of the benchmark (broadcast if it has at
most MAX_BROADCAST windows, else shuffled), and so are windows of plain words (lower-cased, no placeholders), which
find verbatim copies whatever their slots are. Where windows match, words are compared again, and the values
in the slots are checked: each slot value of the item must stand for one value in the document (ties of parameters
are renamed alike), which catches re-parameterised questions and clears texts that only look alike. A canonical
window with more slots than half its words proves nothing and is joined by its plain words only.

A document is contaminated by an item if canonical windows at LEAST places of the item match (or half of the item's
windows, if it has fewer than twice LEAST) and slots agree in 80 % of the item's slot values, or if as many plain windows match. This is asked of every occurrence by itself, so that two differing copies in one document don't contradict
each other: of the windows of one shift (place in the document less place in the item), of shifts at most WINDOW apart
from the next (words put in or left out), and of the whole document; one that passes is enough.

Defined results: null, empty and blank texts match nothing; an item shorter than WINDOW words is one window of its own
length, and is looked up at every place of every document; repeated rows count as one document; null ids match nothing;
an empty table gives an empty result. Only doc_id, text, item_id are read. n_windows, n_slots and n_agreeing are those
of the best occurrence by canonical windows, n_verbatim counts plain windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

QUERY, SQL = "op8_decontamination", None
WINDOW, LEAST = 8, 6
MAX_BROADCAST = 2_000_000
CANONICAL, PLAIN = 0, 1
NUMBER, UNIT, NAME = "\u0001", "\u0002", "\u0003"
#: Fixed list of units, as they stand after a number.
UNITS = ["km", "m", "cm", "mm", "kg", "g", "mg", "lb", "oz", "l", "ml", "s", "ms", "min", "h", "hours", "minutes", "seconds", "days", "years", "mph", "dollars", "euros", "cents", "percent", "miles", "feet", "inches", "meters", "grams", "liters"]
#: Words that aren't names at the start of a sentence.
COMMON = "a about after all also an and are as at because before both but by can could did do does during each every find for from had has have he her here his how i if in is it its let many most my no not now of on one or our she so some that the their then there these they this those to two under was we were what when where which while who whose why will with would you your".split()
#: Words are what is left between blanks when all but letters and digits is dropped, so no later step joins or splits any.
_STRIP = r"[^\p{L}\p{N}\x20\x09-\x0D]+"
_NUMBER = r"[0-9]+"
_UNIT = rf"(\x01[\x20\x09-\x0D]*+)(?:{'|'.join(sorted(UNITS, key=lambda u: (-len(u), u)))})(?!\p{{L}})"
#: Any other capitalised word is a name, wherever it stands, so that a copy's line breaks and quotes change nothing.
_NAME = rf"(?=\p{{Lu}})(?<!\p{{L}})(?!(?i:{'|'.join(COMMON)})(?!\p{{L}}))\p{{Lu}}\p{{Ll}}+"
_SLOT = r"[\x01-\x03]"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, C.WORD_SPLIT), "")


def placed(bare: Column) -> Column:
    """Stripped text with placeholders."""
    bare = F.regexp_replace(bare, _NUMBER, NUMBER)
    bare = F.regexp_replace(bare, _UNIT, "$1" + UNIT)
    return F.regexp_replace(bare, _NAME, NAME)


def _families(df: DataFrame, key: str) -> DataFrame:
    """key, family, v: the hashes of a text's canonical words (family 0) and of its lower-cased words (family 1), which are as many."""
    df = df.where(F.col(key).isNotNull() & F.col("text").isNotNull()).select(key, F.regexp_replace("text", _STRIP, "").alias("bare"))
    df = df.select(key, _words(F.lower(placed(F.col("bare")))).alias("w0"), _words(F.lower("bare")).alias("w1"))
    hashes = [F.transform(f"w{f}", lambda w: F.xxhash64(w)) for f in (CANONICAL, PLAIN)]
    return df.select(key, F.inline(F.array(*(F.struct(F.lit(f).alias("family"), v.alias("v")) for f, v in enumerate(hashes)))))


def _windows(df: DataFrame, key: str) -> DataFrame:
    """key, family, size, pos, h: the windows of `size` words (a column, WINDOW at most) of each row of _families().
    Neighbours are zipped as arrays and hashed as columns, which is compiled code throughout."""
    places = F.greatest(F.size("v") - F.col("size") + 1, F.lit(0))
    shifted = [F.when(F.lit(k) < F.col("size"), F.slice("v", k + 1, places)).otherwise(F.array().cast("array<bigint>")).alias(f"z{k}") for k in range(WINDOW)]
    df = df.select(key, "family", "size", F.posexplode(F.arrays_zip(*shifted)).alias("pos", "z"))
    return df.select(key, "family", "size", "pos", F.xxhash64("family", "size", *(F.col(f"z.z{k}") for k in range(WINDOW))).alias("h"))


def _item_windows(items: DataFrame) -> DataFrame:
    """item_id, family, size, ipos, h: windows of WINDOW words, or of all words of a shorter item."""
    return _windows(_families(items, "item_id").withColumn("size", F.least(F.lit(WINDOW), F.size("v"))).where("size > 0"), "item_id").withColumnRenamed("pos", "ipos")


def _doc_windows(docs: DataFrame, sizes: list[tuple[int, int]]) -> DataFrame:
    """doc_id, pos, h of the windows of each (family, size)."""
    wanted = F.array(*(F.struct(F.lit(f).alias("f"), F.lit(n).alias("n")) for f, n in sizes))
    each = F.transform(F.filter(wanted, lambda x: x["f"] == F.col("family")), lambda x: x["n"])
    return _windows(_families(docs, "doc_id").select("doc_id", "family", "v", F.explode(each).alias("size")), "doc_id").select("doc_id", "pos", "h")


def _aligned(df: DataFrame, key: str, words: str) -> DataFrame:
    """key, family and an array of (raw, canon) for each of its words."""
    df = df.select(key, F.regexp_replace("text", _STRIP, "").alias("bare"))
    raw = _words(F.col("bare"))
    canon = [_words(F.lower(placed(F.col("bare")))), _words(F.lower("bare"))]
    return df.select(key, F.inline(F.array(*(F.struct(F.lit(f).alias("family"), F.arrays_zip(raw.alias("raw"), c.alias("canon")).alias(words)) for f, c in enumerate(canon)))))


def _occurrences(both: DataFrame, *keys: str) -> DataFrame:
    """both's rows once for each occurrence (`at`) that they may belong to: one shift; neighbouring shifts; the whole document."""
    by = Window.partitionBy("doc_id", "item_id", *keys).orderBy("shift")
    new = F.coalesce((F.col("shift") - F.lag("shift").over(by) > WINDOW).cast("int"), F.lit(0))
    both = both.withColumn("new", new).withColumn("span", F.sum("new").over(by.rangeBetween(Window.unboundedPreceding, 0)).cast("int"))
    at = [F.struct(F.lit(k).alias("by"), F.col(c).cast("int").alias("n")) for k, c in enumerate(["shift", "span"])]
    return both.withColumn("at", F.explode(F.array(*at, F.struct(F.lit(2).alias("by"), F.lit(0).alias("n"))))).drop("new", "span")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows, item_windows, n_slots, n_agreeing, n_verbatim of contaminated pairs."""
    with C.Scratch(docs.sparkSession) as s:
        s.sized(benchmark.count(), 5000)
        items = benchmark.where("item_id is not null and text is not null").select("item_id", "text").distinct()
        words = _aligned(items, "item_id", "iwords")
        slots = F.size(F.filter(F.slice("iwords", F.col("ipos") + 1, F.col("size")), lambda z: z["canon"].rlike(_SLOT)))
        iw = _item_windows(items).join(words, ["item_id", "family"]).where((F.col("family") == PLAIN) | (slots <= F.floor(F.col("size") / 2)))
        iw = s.light(iw.select("item_id", "family", "size", "ipos", "h"), "bench-windows")
        sizes = {(r["family"], r["size"]): r["count"] for r in iw.groupBy("family", "size").count().collect()}
        n = sum(sizes.values())
        of = lambda f: F.countDistinct(F.when(F.col("family") == f, F.col("ipos")))
        sized = iw.groupBy("item_id").agg(of(CANONICAL).alias("item_windows"), of(PLAIN).alias("plain_windows"))
        enough_of = lambda n: F.least(F.lit(LEAST), F.ceil(n / 2))
        # A document needs so many different windows of an item at least, unless windows repeat in the item.
        each = iw.groupBy("item_id", "family").agg(F.count("*").alias("all"), F.countDistinct("h").alias("different"))
        each = each.select("item_id", "family", F.when(F.col("all") == F.col("different"), enough_of(F.col("all"))).otherwise(1).alias("need"))
        keys = s.light(iw.join(each, ["item_id", "family"]).groupBy("h", "family").agg(F.min("need").alias("need")), "bench-keys")
        dw = _doc_windows(docs, sorted(sizes) or [(PLAIN, WINDOW)])
        hits = s.table(dw.join(F.broadcast(keys) if n <= MAX_BROADCAST else keys, "h"), "bench-hits")
        s.sized(hits.count())
        rich = hits.groupBy("doc_id", "family").agg(F.countDistinct("h").alias("n"), F.min("need").alias("need")).where("n >= need").select("doc_id").distinct()
        hits = s.light(hits.join(rich, "doc_id", "left_semi").select("doc_id", "pos", "h").distinct(), "bench-rich")
        pairs = hits.join(F.broadcast(iw) if n <= MAX_BROADCAST else iw, "h")
        most = F.when(F.col("family") == PLAIN, F.col("plain_windows")).otherwise(F.col("item_windows"))
        enough = enough_of(most)
        wanted = pairs.groupBy("doc_id", "item_id", "family").agg(F.countDistinct("ipos").alias("c")).join(sized, "item_id").where(F.col("c") >= enough).select("doc_id", "item_id", "item_windows", "plain_windows").distinct()
        wanted = s.light(wanted, "bench-pairs")
        ids = wanted.select("doc_id").distinct()
        few = docs.select("doc_id", "text").where("text is not null").join(C.small(ids, wanted), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
        places = pairs.join(wanted, ["doc_id", "item_id"]).select("doc_id", "item_id", "family", "size", "item_windows", "plain_windows", "pos", "ipos")
        both = places.join(_aligned(few, "doc_id", "dwords"), ["doc_id", "family"]).withColumn("d", F.slice("dwords", F.col("pos") + 1, F.col("size"))).drop("dwords")
        both = both.join(words, ["item_id", "family"]).withColumn("i", F.slice("iwords", F.col("ipos") + 1, F.col("size"))).drop("iwords")
        both = both.where(F.col("d.canon") == F.col("i.canon"))
        both = both.select("doc_id", "item_id", "family", "item_windows", "plain_windows", "ipos", (F.col("pos") - F.col("ipos")).alias("shift"), F.filter(F.zip_with("i", "d", lambda i, d: F.struct(i["canon"].alias("kind"), i["raw"].alias("item"), d["raw"].alias("doc"))), lambda z: (F.col("family") == CANONICAL) & z["kind"].rlike(_SLOT)).alias("slots"))
        both = s.light(both, "bench-both")
        at = ["doc_id", "item_id", "family", "at"]
        both = _occurrences(both, "family")
        counts = both.groupBy(*at).agg(F.first("item_windows").alias("item_windows"), F.first("plain_windows").alias("plain_windows"), F.countDistinct("ipos").alias("n"))
        values = both.select(*at, F.explode("slots").alias("s")).select(*at, "s.*").distinct()
        values = values.groupBy(*at, "kind", "item").agg(F.count("*").alias("c")).groupBy(*at).agg(F.count("*").alias("n_slots"), F.count(F.when(F.col("c") == 1, 1)).alias("n_agreeing"))
        told = counts.join(values, at, "left").fillna(0, ["n_slots", "n_agreeing"])
        good = (F.col("n") >= enough) & (F.col("n_agreeing") >= 0.8 * F.col("n_slots"))
        best = F.max(F.when(F.col("family") == CANONICAL, F.struct(good.alias("good"), "n", "n_agreeing", "n_slots")))
        told = told.groupBy("doc_id", "item_id").agg(F.max(good).alias("good"), F.first("item_windows").alias("item_windows"), best.alias("r"), F.max(F.when(F.col("family") == PLAIN, F.col("n"))).alias("n_verbatim"))
        zero = lambda x: F.coalesce(F.col(x), F.lit(0).cast("long"))
        return s.kept(told.where("good").select("doc_id", "item_id", zero("r.n").alias("n_windows"), "item_windows", zero("r.n_slots").alias("n_slots"), zero("r.n_agreeing").alias("n_agreeing"), zero("n_verbatim").alias("n_verbatim")), "bench-found")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that no item contaminates."""
    gone = C.materialize(contaminated(docs, benchmark).select("doc_id").distinct(), "bench-gone")
    return docs.join(C.small(gone), "doc_id", "left_anti").select(*docs.columns)
