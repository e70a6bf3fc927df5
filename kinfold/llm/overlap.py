"""Benchmark passages in documents: windows of items found by their rarest shingle, verified word by word. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import cut

#: Words of a shingle; a window of fewer is one shingle.
SHINGLE = 5
#: Windows up to which they are broadcast, at some 200 bytes each.
SENT = 1 << 17
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` with A-Z in lower case; null has none."""
    plain = F.coalesce(text.cast("string"), F.lit(""))
    low = F.when(F.octet_length(plain) == F.length(plain), F.lower(plain)).otherwise(F.translate(plain, _UPPER, _LOWER))
    return F.regexp_extract_all(low, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))


def _shingle(own: str, at: Column, size: int) -> Column:
    """A hash of `size` words from a place on; it names a shingle, and is never trusted to be one."""
    return F.xxhash64(*(F.get(own, at + j) for j in range(size)))


def windows(items: DataFrame, size: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(window, words) of all different windows, and (window, item) of the items that they are in. Items of fewer words are one window, those without any none."""
    own = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("own")).where(F.size("own") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("own") - size, F.lit(0)))
    each = own.select("item", F.explode(F.transform(starts, lambda i: F.slice("own", i + 1, F.lit(size)))).alias("words"))
    named = each.withColumn("window", F.sha2(F.array_join("words", " "), 256))
    return cut(named.groupBy("window").agg(F.first("words").alias("words"))), cut(named.where("item is not null").select("window", "item").distinct())


def _placed(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """_k, n, own, at, size, shingle: the shingles of all documents, of each of the sizes; and for each document one row more, whose place is n, without any.

    The hash is made where a place has become a row, inside generated code, and the words go along by reference.
    """
    rows = docs.select("_k", "n", "own", F.posexplode(F.concat("own", F.array(F.lit("")))).alias("at", "_w")).drop("_w")
    size, shingle = F.lit(sizes[0]), _shingle("own", F.col("at"), sizes[0])
    if len(sizes) > 1:
        rows = rows.select("*", F.explode(F.when(F.col("at") < F.col("n"), F.array(*map(F.lit, sizes))).otherwise(F.array(F.lit(sizes[0])))).alias("size"))
        size = F.col("size")
        shingle = F.coalesce(*(F.when(size == x, _shingle("own", F.col("at"), x)) for x in sizes))
    return rows.select("_k", "n", "own", "at", size.alias("size"), F.when(F.col("at") + size <= F.col("n"), shingle).alias("shingle"))


def _rarest(docs: DataFrame, every: DataFrame, sizes: list[int], small: bool) -> DataFrame:
    """(window, words, shingle, offset) of each window: its shingle with the fewest occurrences in all documents, of several the first.

    A window has to occur whole, so one shingle of it is all the prefix that an overlap needs.
    """
    def own_of(size: int) -> DataFrame:
        whole = F.size("words") >= size if size == SHINGLE else F.size("words") == size
        each = F.transform(F.sequence(F.lit(0), F.size("words") - size), lambda i: _shingle("words", i, size))
        return every.where(whole).select("window", "words", F.posexplode(each).alias("offset", "shingle"))

    parts = [own_of(x) for x in sizes]
    own = parts[0]
    for p in parts[1:]:
        own = own.unionByName(p)
    asked = own.select("shingle").distinct()
    placed = _placed(docs, sizes).where("shingle is not null").select("shingle")
    if small:
        counts = placed.join(F.broadcast(asked), "shingle").groupBy("shingle").agg(F.count("*").alias("seen"))
    else:
        counts = placed.groupBy("shingle").agg(F.count("*").alias("seen")).join(asked, "shingle")
    # What no document has can't be in one.
    ranked = own.join(cut(counts), "shingle", "left")
    best = F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "offset", "shingle")).alias("b")
    return ranked.groupBy("window").agg(F.first("words").alias("words"), best).where("b.seen > 0").select("window", "words", "b.shingle", "b.offset")


def hits(docs: DataFrame, every: DataFrame, most: int = SENT) -> DataFrame:
    """From documents (_k, n, own) and windows (window, words) to (_k, n, window, start, length) of all occurrences, and a row without a window for each document.

    Windows are joined by their rarest shingle, bounded by place and length (an occurrence must begin and end in the document), and verified word by word. At most `most`
    windows are broadcast, and documents stay where they are; more are joined by shuffling places, and words only with the candidates that are left.
    """
    sizes = sorted((r[0] for r in every.select(F.least(F.size("words"), F.lit(SHINGLE)).alias("x")).distinct().collect()), reverse=True) or [SHINGLE]
    small = every.count() <= most
    rare = cut(_rarest(docs, every, sizes, small)).withColumnRenamed("words", "theirs")
    placed, length = _placed(docs, sizes), F.size("theirs")
    start = F.col("at") - F.col("offset")
    bounds = (F.col("s.shingle") == F.col("r.shingle")) & (start >= 0) & (start + length <= F.col("n"))
    same = F.slice("own", F.col("at") - F.col("offset") + 1, length) == F.col("theirs")
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    if small:
        found = placed.alias("s").join(F.broadcast(rare).alias("r"), bounds & same, "left").where("window is not null or at = n")
        return found.select("_k", "n", "window", start.alias("start"), length.alias("length"))
    asked = placed.where("shingle is not null").select("_k", "n", "at", "shingle").alias("s").join(rare.alias("r"), bounds).select("_k", "window", "theirs", "at", "offset")
    verified = docs.join(cut(asked.distinct()), "_k").where(same).select("_k", "n", "window", start.alias("start"), length.alias("length"))
    return verified.unionByName(docs.select("_k", "n", none("window", "string"), none("start", "int"), none("length", "int")))


def contaminated(docs: DataFrame, items: DataFrame, size: int = 10, most: int = SENT, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, items, contaminated, and items as an array of item ids, which are sorted as strings.

    A window is `size` consecutive words of an item; an item of fewer words, but not none, is one window. A word of a document inside any occurrence of a window is hit;
    n_items are the items with a window that occurs in it.

    Null and empty texts have no words and no hits; null and repeated ids are documents like others, and repeated rows get equal results. Items that repeat an id
    are one item; windows of items without an id hit words, but no item is named. An empty table of documents gives an empty result; without items nothing is hit. Very
    long texts are taken whole. Other columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), text))
    read = docs.select(F.col(id_col).alias("id"), key.alias("_k"), words(F.col(text_col)).alias("own")).select("*", F.size("own").alias("n"))
    every, named = windows(items, size, item_col, item_text_col)
    found = cut(hits(read.select("_k", "n", "own"), every, most))
    rows = found.where("window is null").groupBy("_k").agg(F.max("n").cast("long").alias("n_words"))
    got = found.where("window is not null")
    # Occurrences in order of their starts: what each adds to the words hit so far.
    spans = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end"))))
    state = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    add = lambda a, s: F.struct((a["n"] + F.greatest(s["end"] - F.greatest(a["end"], s["start"]), F.lit(0))).alias("n"), F.greatest(a["end"], s["end"]).alias("end"))
    n_hit = got.groupBy("_k").agg(F.aggregate(spans, state, add)["n"].cast("long").alias("n_hit"))
    small = named.count() <= most
    by_item = got.select("_k", "window").distinct().join(F.broadcast(named) if small else named, "window")
    its = by_item.groupBy("_k").agg(F.array_sort(F.collect_set("item")).alias("items"))
    rows = rows.join(n_hit, "_k", "left").join(its, "_k", "left")
    ids = docs.select(F.col(id_col), key.alias("_k"))
    count = F.coalesce("n_hit", F.lit(0)).cast("long")
    out = ids.join(rows, "_k")
    return out.select(id_col, "n_words", count.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (count > 0).alias("contaminated"))
