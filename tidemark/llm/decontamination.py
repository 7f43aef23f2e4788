"""Benchmark decontamination by size-partitioned MinHash containment search.

Items (short) and documents (long) are sets of word shingles, hashed; the hash is the
random order of MinHash.  Items are partitioned by size, by powers of two, and every
partition is searched by itself.  An item's sketch is the k smallest of its hashes, with
k one more than the shingles that an item of its size can miss and still be contained to
``threshold``.  A document that contains the item therefore holds at least one hash of
the sketch: the search has no false negatives, whatever the document's size, which
fixed-size MinHash signatures can't offer for short items inside long documents.  A
document's side of a partition's sketches is those of its hashes under that partition's
largest, if the document is as large as the partition asks; candidates meet by
partition and hash.  They are verified by exact containment: the shingles, as strings,
that document and item share are joined and counted.

All of it is DataFrame functions: no Python runs on the executors.

Defined results: words are runs of letters and digits of the lower-cased text; items
of fewer words than a shingle are one shingle of all their words, items without
words match nothing, null texts have no words.  Pairs are reported once for rows
equal in id and text.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import row_key, unused, written

SHINGLE = 5
THRESHOLD = 0.8
#: Sketch rows up to which sketches and items' shingles are broadcast (counted first; a
#: sketch has a fifth of its item's shingles or more).
BROADCAST_ROWS = 100_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def _each(ws: str, width: int, make) -> Column:
    """``make`` of every run of ``width`` words of the array column ``ws``."""
    last = F.size(ws) - F.lit(width) + F.lit(1)
    starts = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: make(F.slice(F.col(ws), i, F.lit(width))))


def _hash(run: Column) -> Column:
    return F.xxhash64(run)


def _text(run: Column) -> Column:
    return F.concat_ws(" ", run)


def _all(ws: str, widths: list[int], make) -> Column:
    return F.array_distinct(F.concat(*(_each(ws, w, make) for w in widths)))


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, broadcast_rows: int = BROADCAST_ROWS, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment, row): pairs in which the document
    contains at least ``threshold`` of the item's shingles; ``row`` is the document's row key."""
    base = items.select(F.col(item_id).alias("item"), words(F.col(text_col)).alias("ws")).where(F.size("ws") > 0).distinct()
    base = base.withColumn("width", F.least(F.size("ws"), F.lit(shingle)))
    widths = [r.width for r in base.select("width").distinct().orderBy("width").collect()]  # at most `shingle` numbers
    if not widths:
        widths = [shingle]
    mine = lambda make: F.when(F.lit(False), F.array().cast("array<string>" if make is _text else "array<bigint>"))

    def own(make) -> Column:
        out = mine(make)
        for w in widths:
            out = out.when(F.col("width") == w, F.array_distinct(_each("ws", w, make)))
        return out

    kept = base.select("item", own(_text).alias("texts"), F.array_sort(own(_hash)).alias("hashes"))
    kept = kept.withColumn("q", F.size("texts")).withColumn("least", F.ceil(F.col("q") * F.lit(threshold) - F.lit(1e-9)).cast("int"))
    kept = written(kept.withColumn("part", F.floor(F.log2(F.col("q"))).cast("int")))
    # a hash that two of an item's shingles share would shorten the list: then all of it is used
    sketch = written(kept.select("item", "least", "part", F.explode(F.expr("slice(hashes, 1, greatest(q - least + 1, 1))")).alias("h")))
    # one row for each power of two that an item's size has
    parts = sketch.groupBy("part").agg(F.max("h").alias("cut"), F.min("least").alias("least"), F.count("*").alias("n")).orderBy("part").collect()
    small = sum(p["n"] for p in parts) <= broadcast_rows
    hint = F.broadcast if small else (lambda df: df)

    keyed = docs.select(F.col(doc_id).alias("doc"), F.col(text_col).alias("text"), row_key(doc_id, text_col).alias("row"))
    sized = keyed.select("doc", "row", words(F.col("text")).alias("ws")).select("doc", "row", _all("ws", widths, _hash).alias("hs"))

    def side(p) -> Column:
        under = F.transform(F.filter("hs", lambda h: h <= F.lit(p["cut"])), lambda h: F.struct(F.lit(p["part"]).alias("part"), h.alias("h")))
        return F.when(F.size("hs") >= F.lit(p["least"]), under).otherwise(F.array().cast("array<struct<part:int,h:bigint>>"))

    sides = F.concat(*map(side, parts)) if parts else F.array().cast("array<struct<part:int,h:bigint>>")
    under = sized.select("doc", "row", F.size("hs").alias("n"), F.explode(sides).alias("side")).select("doc", "row", "n", "side.part", "side.h")
    hits = under.join(hint(sketch), ["part", "h"]).where(F.col("n") >= F.col("least"))
    pairs = written(hits.select("doc", "row", "item").distinct())

    # verification: shared shingles as rows, so that no document's shingles are copied for each item
    found = pairs.select("doc", "row").distinct()
    texts = keyed.join(found, keyed["doc"].eqNullSafe(found["doc"]) & (keyed["row"] == found["row"]), "left_semi").dropDuplicates(["doc", "row"])
    mine = texts.select("doc", "row", words(F.col("text")).alias("ws")).select("doc", "row", F.explode(_all("ws", widths, _text)).alias("shingle"))
    full = written(kept.select("item", "q", "least", F.explode("texts").alias("shingle")))
    shared = mine.join(hint(full), "shingle").groupBy("doc", "row", "item").agg(F.count("*").alias("shared"), F.first("q").alias("q"), F.first("least").alias("least")).where(F.col("shared") >= F.col("least"))
    same = shared["doc"].eqNullSafe(pairs["doc"]) & (shared["row"] == pairs["row"]) & shared["item"].eqNullSafe(pairs["item"])
    both = shared.join(pairs, same, "left_semi")
    return both.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), F.col("shared").cast("long").alias("n_shared"), F.col("q").cast("long").alias("n_item"), (F.col("shared") / F.col("q")).alias("containment"), "row")


def without_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """The documents that contain no item to ``threshold``."""
    leak_id, leak_row, row = (unused(docs, c) for c in ("_leak_id", "_leak_row", "_row"))
    found = contaminated(docs, items, threshold, shingle).select(F.col("doc_id").alias(leak_id), F.col("row").alias(leak_row)).distinct()
    keyed = docs.withColumn(row, row_key())
    return keyed.join(found, keyed["doc_id"].eqNullSafe(found[leak_id]) & (keyed[row] == found[leak_row]), "left_anti").drop(row)
