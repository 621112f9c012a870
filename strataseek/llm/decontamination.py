"""Benchmark passages in documents, re-parameterised ones too, in DataFrame functions alone.

Texts become templates: numbers, the units behind them and names inside sentences turn
into typed placeholders; everything else is lower-cased words. Windows of template
words, with their slot values, are taken from each benchmark item at a stride and
joined by hash with all windows of the documents. A window with too few plain words is
no evidence and isn't indexed (unless the item has no other). Hits on one alignment of
an item with a document must fill the slots consistently: one item value always takes the
same document value (two may take the same). Windows with an item value that takes several
don't count; windows without slots always do. A document holds an item if
the consistent hits cover enough of its windows.

Windows with names are looked up both as templates and with the names as words, so a
copy in lower case is found. The slots that are compared are those of the form whose key was
found: with the names as words, a name is no slot. Any white space counts as one blank.

Documents are looked through in segments, so that what a window carries along, and what a task holds of a document with many hits, is
bounded. Of the index only bits of its keys are broadcast (a Bloom filter in chunks, of bounded size); windows that pass, a few of
ten thousand of them by chance, meet the index with their slots alone: an index of few windows is broadcast for it, a larger one met by a shuffle.

Cases: a null or empty text on either side has no windows; an item shorter than a window
is one window; repeated rows and rows that share an id are reported once for each different
text; null ids are kept; an empty table on either side gives no rows; further columns don't matter.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataseek.llm.scratch import materialize

WINDOW = 8
STRIDE = 4
#: Plain words that a window needs to be evidence.
PLAIN = 5
#: Share of an item's windows that must be found.
SHARE = 0.5
#: Windows of an index that is broadcast: at most about 15 MB.
BLOCK = 50_000
#: Windows whose bits are broadcast together, about 5 bytes each; more than that go in passes, one after the other.
SIEVED = 8_000_000
#: Words of a segment, besides those of windows that go over its end.
SEGMENT = 64
#: Bits of a chunk, for so many of each key.
CHUNK_BITS, KEY_BITS = 4096, 32

#: Private-use characters, which no word has: placeholders, and the point inside a number.
NUMBER, UNIT, NAME, POINT = "\ue000", "\ue001", "\ue002", "\ue003"
#: Units of measure and currency, as words behind a number.
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg lb lbs pound pounds ounce ounces ton tons ml l liter liters litre litres gallon gallons"
    " s sec second seconds min minute minutes h hour hours day days week weeks month months year years percent degree degrees dollar dollars cent cents euro euros"
    " usd eur gbp mph kmh kb mb gb tb hz khz mhz ghz v w kw kwh j kj cal kcal"
)


def _templates(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text_hash, raw (words), typed and named (template words with and without names as words): aligned arrays."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # The blank between digit and letter comes before the forms part, so that all three have the same words.
    plain = F.regexp_replace(text, r"[\s\p{Z}]{2,}|[[\s\p{Z}]&&[^ ]]", " ")
    marked = F.regexp_replace(F.regexp_replace(plain, r"(?<=\p{Nd})[.,](?=\p{Nd})", POINT), r"(?<=\p{Nd})(?=\p{L})", " ")
    df = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), marked.alias("t"))
    # U+0130 becomes two characters, and two words, in lower case.
    names = F.regexp_replace("t", r"(?<=[\p{Ll},;] )(?!\x{130})\p{Lu}\p{Ll}+(?![\p{L}\p{Nd}])", NAME)

    def typed(t: Column) -> Column:
        t = F.regexp_replace(F.lower(t), rf"(?<![\p{{L}}\p{{Nd}}{POINT}])\p{{Nd}}[\p{{Nd}}{POINT}]*", NUMBER)
        return F.regexp_replace(t, rf"(?<={NUMBER} )(?:{'|'.join(UNITS.split())})(?![\p{{L}}\p{{Nd}}])", UNIT)

    def words(t: Column) -> Column:
        return F.array_remove(F.split(t, rf"[^\p{{L}}\p{{Nd}}{NUMBER}-{POINT}]+", -1), "")

    df = df.select("id", "text_hash", "t", names.alias("n"))
    df = df.select(
        "id",
        "text_hash",
        words(F.lower("t")).alias("raw"),
        words(typed(F.col("n"))).alias("typed"),
        F.when(F.col("n") != F.col("t"), words(typed(F.col("t")))).alias("named"),
    )
    return df


def _keys(words: Column, width: int) -> Column:
    """Hash of each window that begins in a segment, of hashes of words."""
    return F.when(F.size(words) >= width, F.transform(_starts(words, width), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(width))))).otherwise(F.array().cast("array<bigint>"))


def _starts(words: Column, width: int) -> Column:
    return F.sequence(F.lit(0), F.greatest(F.least(F.size(words) - width, F.lit(SEGMENT - 1)), F.lit(0)))


def _slots(form: Column, raw: Column, at: Column, width: Column | int) -> Column:
    """Array of (type, value) of the placeholders among ``width`` words of one form (typed or named) from ``at`` on."""
    own = F.zip_with(F.slice(form, at + 1, width), F.slice(raw, at + 1, width), lambda t, r: F.struct(t.alias("kind"), r.alias("value")))
    return F.filter(own, lambda x: x["kind"].isin(NUMBER, UNIT, NAME))


def index_items(items: DataFrame, *, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """width, key, item_id, item_at, item_slots, item_windows: what is looked up of each item."""
    t = _templates(items, id_col, text_col).where(F.size("raw") > 0)
    t = t.select("id", "raw", "typed", F.coalesce("named", "typed").alias("named"), F.least(F.size("typed"), F.lit(WINDOW)).alias("width"))
    last = F.size("typed") - F.col("width")
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(STRIDE)), F.array(last)))
    t = t.withColumn("item_at", F.explode(starts))
    slots = lambda w: _slots(F.col(w), F.col("raw"), F.col("item_at"), F.col("width"))
    t = t.withColumn("plain", F.col("width") - F.size(slots("typed")))
    per_item = Window.partitionBy("id", "typed")
    needed = F.least(F.lit(PLAIN), F.max("plain").over(per_item))
    t = t.withColumn("needed", needed).where(F.col("plain") >= F.col("needed"))
    t = t.withColumn("item_windows", F.count(F.lit(1)).over(per_item))
    # As one hash of hashes, like the documents' windows.
    keyed = lambda w: F.xxhash64(*(F.xxhash64(F.get(F.col(w), F.col("item_at") + k)) for k in range(WINDOW)))
    short = lambda w: F.xxhash64(F.array_join(F.slice(w, F.col("item_at") + 1, F.col("width")), " "))
    key = lambda w: F.when(F.col("width") == WINDOW, keyed(w)).otherwise(short(w))
    looked_up = F.array_distinct(F.array(*(F.struct(key(w).alias("key"), slots(w).alias("item_slots")) for w in ("typed", "named"))))
    return t.select("width", F.explode(looked_up).alias("x"), F.col("id").alias("item_id"), "item_at", "item_windows").select("width", "x.key", "item_id", "item_at", "x.item_slots", "item_windows")


def _windows(docs: DataFrame, width: int) -> DataFrame:
    """id, text_hash, from, raw, typed, named, at, key: one row for each window of this width, with the words of its segment; first of the typed words, then of the named."""
    own = lambda w, i: F.slice(w, i + 1, SEGMENT + WINDOW - 1).alias(w)
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.size("typed") - 1, F.lit(0)), F.lit(SEGMENT)), lambda i: F.struct(i.alias("from"), *(own(w, i) for w in ("raw", "typed", "named"))))
    # The outer forms: for the others Spark would filter on the whole expression first, and inline it for that.
    docs = docs.select("id", "text_hash", F.explode_outer(cut).alias("s")).select("id", "text_hash", "s.*")
    hashes = lambda w: F.transform(w, lambda x: F.xxhash64(x))
    h = docs.select("*", hashes("typed").alias("h1"), hashes("named").alias("h2"))
    if width == WINDOW:
        keys = [_keys(F.col("h1"), width), F.when(F.col("h2").isNotNull(), _keys(F.col("h2"), width))]
    else:
        joined = lambda w: F.when(
            F.size(w) >= width, F.transform(_starts(F.col(w), width), lambda i: F.xxhash64(F.array_join(F.slice(F.col(w), i + 1, width), " ")))
        ).otherwise(F.array().cast("array<bigint>"))
        keys = [joined("typed"), F.when(F.col("named").isNotNull(), joined("named"))]
    both = F.concat(keys[0], F.coalesce(keys[1], F.array().cast("array<bigint>")))
    return h.select(*docs.columns, both.alias("keys")).select(*docs.columns, F.posexplode_outer("keys").alias("at", "key"))


def _placed(met: DataFrame, width: int) -> DataFrame:
    """id, text_hash, width, key, at (in the document), slots: of windows that passed the sieve, without the words."""
    n = F.greatest(F.least(F.size("typed") - width + 1, F.lit(SEGMENT)), F.lit(1))
    at, form = F.col("at") % n, F.when(F.col("at") < n, F.col("typed")).otherwise(F.col("named"))
    # Words are looked at on hits alone; up to here, the arrays are only passed on inside one generated loop.
    return met.select("id", "text_hash", F.lit(width).alias("width"), "key", (F.col("from") + at).alias("at"), _slots(form, F.col("raw"), at, width).alias("slots"))


def _bits(key: str, chunks: int) -> tuple[Column, list[Column]]:
    """The chunk of a key, of 2 ** ``chunks``, and three bits in it."""
    return F.shiftrightunsigned(key, 64 - chunks), [F.shiftright(key, 12 * j).bitwiseAND(F.lit(CHUNK_BITS - 1)).cast("int") for j in range(3)]


def _sieve(keys: DataFrame, chunks: int) -> DataFrame:
    """chunk, words: the bits of all keys, CHUNK_BITS of them in a row."""
    chunk, bits = _bits("key", chunks)
    each = keys.select(chunk.alias("chunk"), F.explode(F.array(*bits)).alias("bit")).select("chunk", F.shiftright("bit", 6).alias("word"), F.expr("shiftleft(1L, bit & 63)").alias("mask"))
    words = each.groupBy("chunk", "word").agg(F.bit_or("mask").alias("mask")).groupBy("chunk").agg(F.map_from_entries(F.collect_list(F.struct("word", "mask"))).alias("set"))
    return words.select("chunk", F.transform(F.sequence(F.lit(0), F.lit(CHUNK_BITS // 64 - 1)), lambda i: F.coalesce(F.try_element_at("set", i), F.lit(0).cast("long"))).alias("words"))


def _held(bits: list[Column]) -> Column:
    return reduce(Column.__and__, [F.getbit(F.get("words", F.shiftright(bit, 6)), bit.bitwiseAND(F.lit(63))) == 1 for bit in bits])


def _hits(docs: DataFrame, index: DataFrame, widths: list[int], windows: int) -> DataFrame:
    """One row for each window of a document that equals one of the index."""
    passes = max(1, ceil(windows / SIEVED))
    chunks = max(1, ceil(log2(max(1, KEY_BITS * windows / passes / CHUNK_BITS))))
    chunk, bits = _bits("key", chunks)
    parts = []
    for i in range(passes):
        own = index if passes == 1 else index.where(F.pmod(F.xxhash64("key"), F.lit(passes)) == i)
        passed = []
        for width in widths:
            sieve = _sieve(own.where(F.col("width") == width).select("key"), chunks)
            passed.append(_placed(_windows(docs, width).withColumn("chunk", chunk).join(F.broadcast(sieve), "chunk").where(_held(bits)), width))
        part = reduce(DataFrame.union, passed)
        parts.append(part if passes == 1 else materialize(part, "sieved-windows"))
    # Else by a merge, whatever the sizes: Spark would broadcast an index whose files are small, and it is several times as large in memory.
    met = F.broadcast(index) if windows <= BLOCK else index.hint("merge")
    return reduce(DataFrame.union, parts).join(met, ["width", "key"]).select("id", "text_hash", "item_id", "item_at", "item_slots", "item_windows", "at", "slots")


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    share: float = SHARE,
) -> DataFrame:
    """doc_id, text_hash, item_id, found_windows, item_windows, n_slots, verbatim: one row for each document text and item that it holds."""
    index = materialize(index_items(items, id_col=item_id_col, text_col=item_text_col), "template-windows")
    shapes = index.groupBy("width").agg(F.count(F.lit(1))).collect()  # WINDOW rows at most
    templates = _templates(docs, id_col, text_col)
    widths, windows = sorted(r[0] for r in shapes) or [WINDOW], sum(r[1] for r in shapes)
    hits = _hits(templates, index, widths, windows)

    same = F.size("item_slots") == F.size("slots")
    pairs = F.zip_with("item_slots", "slots", lambda a, b: F.struct(a["kind"].alias("kind"), a["value"].alias("item"), b["value"].alias("doc")))
    # No filter on the slots: Spark would make it part of the join, which then leaves the generated loop.
    aligned = hits.groupBy("id", "text_hash", "item_id", "item_windows", (F.col("at") - F.col("item_at")).alias("shift")).agg(
        F.collect_set(F.when(same, F.struct("item_at", pairs.alias("pairs")))).alias("windows")
    )
    aligned = aligned.withColumn("pairs", F.array_distinct(F.flatten(F.col("windows.pairs"))))
    sides = lambda pairs: F.transform(pairs, lambda x: F.struct(x["kind"], x["item"]))
    once = F.array_distinct(sides(F.col("pairs")))
    several = F.filter(once, lambda k: F.size(F.filter(sides(F.col("pairs")), lambda x: x == k)) > 1)
    # Few alignments conflict; the others needn't look.
    aligned = aligned.withColumn("several", F.when(F.size(once) < F.size("pairs"), several))
    consistent = F.filter("windows", lambda w: ~F.arrays_overlap(sides(w["pairs"]), F.col("several")))
    aligned = aligned.withColumn("kept", F.when(F.col("several").isNull(), F.col("windows")).otherwise(consistent))
    any_kept = F.size("kept") > 0
    held = aligned.groupBy("id", "text_hash", "item_id", "item_windows").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set(F.col("kept.item_at"))))).cast("long").alias("found_windows"),
        F.max(F.size(F.array_distinct(F.flatten(F.col("kept.pairs"))))).cast("long").alias("n_slots"),
        F.bool_and(F.when(any_kept, F.forall("pairs", lambda x: x["item"] == x["doc"]))).alias("verbatim"),
    )
    return held.where((F.col("found_windows") > 0) & (F.col("found_windows") >= F.col("item_windows") * share)).select(
        F.col("id").alias("doc_id"), "text_hash", "item_id", "found_windows", F.col("item_windows").cast("long"), "n_slots", "verbatim"
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """The rows of ``docs``, all columns, without those that hold an item."""
    found = find_contamination(docs, items, id_col=id_col, text_col=text_col, **more).select(F.col("doc_id").alias("__bad_id"), F.col("text_hash").alias("__bad_hash")).distinct()
    found = materialize(found, "contaminated")  # as a table, so that its size decides whether the texts are shuffled to meet it
    rows = docs.select(F.struct("*").alias("__row"), F.col(id_col).alias("__id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("__hash"))
    return rows.join(found, F.col("__id").eqNullSafe(F.col("__bad_id")) & (F.col("__hash") == F.col("__bad_hash")), "left_anti").select("__row.*")
