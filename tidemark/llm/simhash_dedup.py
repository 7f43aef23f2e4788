"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2r bits share a variant: a value within r
bits of both.  Every distinct fingerprint emits all its variants, variants are
brought together, and those that two fingerprints share link them.

A variant is shuffled by its leading bits, not one by one: a fingerprint goes once
to each leading pattern within r - 1 bits of its own, with the number of bits left,
and the variants of that pattern are spelt out where they are compared.  That brings
together all that differ in at most 2r - 2 leading bits.  Others differ in one of the
bits below at most, so one half of these is equal in both: a fingerprint goes once to
each half's own value, where the variants that leave this half as it is are spelt out.
With b leading bits that makes b + 3 rows of a fingerprint for r = 2, and three for
r = 1, of which b grows as the logarithm of their number: the bits are as many as it
takes for a pattern to gather a bounded number of fingerprints.  Within a task the
patterns are split by further bits until the variants fit in a block of bounded
size, and each block is sorted.  All fingerprints of one variant lie within r bits
of it, hence within 2r of each other, so a star to the first of them keeps every
link's connection without listing all pairs of a group; the distance is verified
all the same.  Components are found by contraction on the executors.

``one_of_each``, for stages, looks for texts that share 0.8 or more of their shingles of
five words: at that similarity 64 bits differ in some ten places, beyond any ball, so
several shorter fingerprints are ball-hashed alike, and pairs that meet are verified by
their shingles.

Defined results: a null or empty text has fingerprint zero; rows with equal
fingerprints are linked whatever their number; a null id is never the smallest, and
a component of null ids only has a null component_id.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.shared import heavy_join, lower_ascii, mix64, row_key, row_slices, unused, words_of, written
from tidemark.llm.substring_dedup import word_ids

BITS = 64
SHINGLE = 4
RADIUS = 4
SEED = 42
#: Fewest leading bits by which variants are shuffled.
LEAD_BITS = 4
#: Fingerprints that one pattern of leading bits gathers, on the average at most.
GATHERED = 1 << 16
#: Near-duplicates for stages: words of a shingle, least Jaccard similarity, and the tables of
#: shorter fingerprints, one of which has to bring two texts together.
NEAR_SHINGLE = 5
SIMILARITY = 0.8
TABLES = 8
TABLE_BITS = 48
#: Variants sorted at once.
BLOCK = 1 << 21


def shingle_hashes(text: str, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of the text's shingles, repeats included."""
    words = words_of(lower_ascii(text))
    if not words:
        return np.zeros(0, dtype=np.uint64)
    raw = " ".join(words).encode("utf-8")
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(raw, SEED)], dtype=np.uint64)
    ends = np.flatnonzero(np.frombuffer(raw, dtype=np.uint8) == 0x20).tolist() + [len(raw)]
    view = memoryview(raw)
    begins = [0, *(e + 1 for e in ends[: len(words) - width])]
    return np.array([digest(view[a:b], SEED) for a, b in zip(begins, ends[width - 1 :], strict=True)], dtype=np.uint64)


def fingerprint(text: str, width: int = SHINGLE) -> int:
    h = shingle_hashes(text, width)
    n = len(h)
    if not n:
        return 0
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        part = h[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, row): the fingerprint as a signed long, and the row key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches):
            found = np.array([fingerprint(t or "", width) for t in part.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64)), part.column(2)], [id_col, "fp", "row"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col, row_key(id_col, text_col).alias("row")).mapInArrow(run, f"`{id_col}` {kind}, fp long, row long")


def _flips(bits: int, most: int) -> np.ndarray:
    """All words with at most ``most`` of the lowest ``bits`` bits set."""
    return np.array([sum(1 << b for b in c) for k in range(most + 1) for c in combinations(range(bits), k)], dtype=np.uint64)


def _met(fps: np.ndarray, left: np.ndarray, bits: int, keys: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Stars of fingerprints that share a variant.  ``left``: how many of the lowest
    ``bits`` bits of each one's key may still be flipped; the bits above have been
    settled, and keys that differ there do not meet.  A key is the fingerprint's lowest
    bits if not given."""
    if keys is None:
        keys = fps & np.uint64((1 << bits) - 1)
    if len(fps) < 2:
        return
    size = sum(int((left == k).sum()) * (1 + (k > 0) * bits + (k > 1) * bits * (bits - 1) // 2) for k in range(3)) if left.max() < 3 else BLOCK + 1
    if size > BLOCK and bits > 1:
        top = np.uint64(1 << (bits - 1))
        for side in (np.uint64(0), top):
            own = (keys & top) == side
            keep = own | (left > 0)
            yield from _met(fps[keep], (left - ~own)[keep], bits - 1, keys[keep] & ~top | side)
        return
    variants, who = [], []
    for k in np.unique(left).tolist():
        at = np.flatnonzero(left == k)
        flips = _flips(bits, k)
        variants.append((keys[at][:, None] ^ flips[None, :]).ravel())
        who.append(np.repeat(at, len(flips)))
    variants, who = np.concatenate(variants), np.concatenate(who)
    order = np.argsort(variants)
    variants, who = variants[order], who[order]
    head = np.ones(len(variants), dtype=bool)
    head[1:] = variants[1:] != variants[:-1]
    group = np.cumsum(head) - 1
    lead = np.minimum.reduceat(who, np.flatnonzero(head))[group]
    other = lead != who
    pair = np.unique(lead[other] * len(fps) + who[other])
    yield fps[pair // len(fps)], fps[pair % len(fps)]


def _local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest of stars with the same components as the edges."""
    v, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(v))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        new = new[root]
        if np.array_equal(new, root):
            break
        root = new
    far = root != np.arange(len(v))
    return v[far], v[root[far]]


def lead_bits_for(n: int, most: int) -> int:
    """The fewest leading bits with which a pattern within ``most`` bits gathers
    :data:`GATHERED` of ``n`` fingerprints on the average."""
    bits = LEAD_BITS
    while bits < BITS // 2 and n * len(_flips(bits, most)) > GATHERED << bits:
        bits += 1
    return bits


def _halves(fps: np.ndarray, bits: int, low: int) -> Iterator[tuple[np.ndarray, int, int]]:
    """Of the upper and of the lower half of the lowest ``low`` bits: the fingerprints with
    this half above their other bits, below what is above ``bits``; how many the other bits
    are, and how many the half has."""
    cut = low // 2
    field = lambda a, b: (fps >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)
    above = fps >> np.uint64(bits) << np.uint64(bits) if bits < BITS else np.uint64(0)
    lead, upper, lower = field(low, bits), field(cut, low), field(0, cut)
    join = lambda first, last, n, m: above | first << np.uint64(bits - n) | lead << np.uint64(m) | last
    yield join(upper, lower, low - cut, cut), bits - (low - cut), low - cut
    yield join(lower, upper, cut, low - cut), bits - cut, cut


def links(distinct: DataFrame, radius: int = RADIUS, lead_bits: int | None = None, bits: int = BITS, tables: int = 1, forest: bool = True) -> DataFrame:
    """(a, b): edges whose components are those of all pairs of ``distinct`` (column fp)
    with at most ``radius`` differing bits.  ``radius`` is even and at most 4.

    Fingerprints have ``bits`` bits; what is above is the number of one of ``tables``, which
    do not meet.  Without ``forest`` all edges that stars have come, not only as many as it
    takes to connect them."""
    if radius not in (2, 4):
        raise ValueError("radius must be 2 or 4")
    half = radius // 2
    lead_bits = lead_bits or lead_bits_for(distinct.count() // tables, half - 1)
    low = bits - lead_bits
    flips = _flips(lead_bits, half - 1)
    lefts = np.append(half - np.bitwise_count(flips).astype(np.int8), np.full(2, half, dtype=np.int8))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches, 8192):
            fps = part.column(0).to_numpy().view(np.uint64)
            # three kinds of patterns, told apart by the remainder: leading bits, and as many of either half
            leads = [((fps >> np.uint64(low))[:, None] ^ flips[None, :]) * np.uint64(3)]
            for kind, (turned, rest, size) in enumerate(_halves(fps, bits, low), 1):
                leads.append((turned >> np.uint64(rest + max(0, size - lead_bits)))[:, None] * np.uint64(3) + np.uint64(kind))
            lead = np.concatenate(leads, axis=1).ravel().view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(lead), pa.array(np.repeat(fps, len(lefts)).view(np.int64)), pa.array(np.tile(lefts, len(fps)))], ["lead", "fp", "left"])

    def stars(kind: int, fps: np.ndarray, left: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not kind:
            yield from _met(fps, left, low)
            return
        turned, rest, _ = list(_halves(fps, bits, low))[kind - 1]
        _, same, n = np.unique(turned >> np.uint64(rest), return_inverse=True, return_counts=True)
        shared = n[same] > 1
        for x, y in _met(fps[shared], left[shared], rest, turned[shared]):
            # what the leading bits, or the upper half, have brought together is not listed again
            other = np.bitwise_count((x ^ y) >> np.uint64(low)) > radius - 2
            if kind == 2:
                other &= (x ^ y) >> np.uint64(low // 2) << np.uint64(BITS - low + low // 2) != 0
            yield x[other], y[other]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fps = np.concatenate([p.column(1).to_numpy() for p in parts]).view(np.uint64)
            left = np.concatenate([p.column(2).to_numpy() for p in parts]).astype(np.int64)
            order = np.argsort(fps)  # a star's middle must not depend on the order of arrival
            fps, left = fps[order], left[order]
            a, b = [], []
            for x, y in stars(parts[0].column(0)[0].as_py() % 3, fps, left):
                near = np.bitwise_count(x ^ y) <= radius
                a.append(x[near])
                b.append(y[near])
            if a:
                x, y = np.concatenate(a), np.concatenate(b)
                if forest:
                    x, y = _local_roots(x, y)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            lead = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(lead[1:] != lead[:-1]) + 1).tolist(), len(lead)]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if held and held[-1].column(0)[0] != batch.column(0)[x]:
                    yield from solve(held)
                    held = []
                if y > x:
                    held.append(batch.slice(x, y - x))
        if held:
            yield from solve(held)

    sent = distinct.select("fp").mapInArrow(send, "lead long, fp long, left byte")
    return sent.repartition("lead").sortWithinPartitions("lead").mapInArrow(meet, "a long, b long")


def _rooted(fps: DataFrame, radius: int, id_col: str) -> DataFrame:
    """(fp, lead, root): of each distinct fingerprint the first row, and its component."""
    lead = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "row"))
    classes = written(fps.groupBy("fp").agg(lead.alias("lead"), F.count("*").alias("weight")))
    roots = components(links(classes, radius))
    return written(classes.join(roots, classes["fp"] == roots["v"], "left").select("fp", "lead", "weight", F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id): 16 hexadecimal digits, and the smallest id that
    can be reached by links of at most ``radius`` differing bits."""
    fps = written(fingerprints(docs, width, id_col, text_col))
    rooted = _rooted(fps, radius, id_col)
    least = rooted.groupBy("root").agg(F.min("lead.id").alias("component_id"))
    of_class = written(rooted.join(least, "root").select("fp", "component_id", "weight"))
    return heavy_join(fps, of_class, ["fp"]).select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _kept(docs: DataFrame, fps: DataFrame, leads: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``leads`` (lead: none, id, row) names, each once."""
    lead_id, lead_row, own = (unused(docs, c) for c in ("_lead_id", "_lead_row", "_row"))
    leads = leads.select(F.col("lead.id").alias(lead_id), F.col("lead.row").alias(lead_row))
    keyed = docs.withColumn(own, row_key())
    left = keyed.join(leads, keyed["doc_id"].eqNullSafe(leads[lead_id]) & (keyed[own] == leads[lead_row]), "left_semi")
    # texts are only shuffled again where some row is repeated as it is
    if not fps.groupBy("doc_id", "row").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        left = left.dropDuplicates(["doc_id", own])
    return left.drop(own)


def _shingles(column: pa.Array, width: int) -> list[np.ndarray]:
    """64-bit hashes of each text's word shingles, A-Z lower-cased, repeats included; texts
    of fewer words have one of all their words."""
    ids, sizes = word_ids(pc.ascii_lower(column))
    out = []
    for own in np.split(ids, np.cumsum(sizes)[:-1]):
        n = max(min(len(own), 1), len(own) - width + 1)
        h = np.zeros(n, dtype=np.uint64)
        for j in range(min(width, len(own))):
            h = mix64(h * np.uint64(3) + own[j : j + n])
        out.append(h)
    return out


def signatures(docs: DataFrame, width: int = NEAR_SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, words, row): :data:`TABLES` SimHash fingerprints of :data:`TABLE_BITS` bits by
    independent hashes, each with the number of its table above."""
    n_words = TABLES * TABLE_BITS // 64
    salts = mix64(np.arange(1, n_words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    scale = np.left_shift(np.uint64(1), np.arange(TABLE_BITS, dtype=np.uint64))
    table = np.arange(TABLES, dtype=np.uint64) << np.uint64(TABLE_BITS)

    def one(h: np.ndarray) -> np.ndarray:
        ones = np.zeros(TABLES * TABLE_BITS, dtype=np.int64)
        for at in range(0, len(h), 1 << 14):
            part = mix64(h[at : at + (1 << 14), None] ^ salts[None, :])
            ones += np.unpackbits(part.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint32)
        bits = (2 * ones > len(h)).reshape(TABLES, TABLE_BITS)
        return (bits * scale).sum(axis=1, dtype=np.uint64) | table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches):
            words = [one(h) for h in _shingles(part.column(1), width)]
            flat = np.concatenate(words).view(np.int64) if words else np.zeros(0, dtype=np.int64)
            lists = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, TABLES, dtype=np.int32), pa.array(flat))
            yield pa.RecordBatch.from_arrays([part.column(0), lists, part.column(2)], [id_col, "words", "row"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col, row_key(id_col, text_col).alias("row")).mapInArrow(run, f"`{id_col}` {kind}, words array<long>, row long")


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """(v, own): the distinct shingle hashes of each text (v, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches):
            own = [np.unique(h).view(np.int64) for h in _shingles(part.column(1), width)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own, pa.list_(pa.int64()))], ["v", "own"])

    return texts.select("v", "text").mapInArrow(run, "v long, own array<long>")


def one_of_each(docs: DataFrame, width: int = NEAR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The documents without near-duplicates: of each group one row stays, that with the
    smallest doc_id (null last; rows of one id in the order of their row keys).

    Texts with equal signatures are one class.  The first texts of two classes are linked
    if they share at least ``similarity`` of their distinct shingles (Jaccard, verified)
    and, in one table at least, their fingerprints meet within :data:`RADIUS` bits.  Groups
    are connected classes.  Texts without words are one class.
    """
    fps = written(signatures(docs, width))
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "row"))
    classes = written(fps.groupBy("words").agg(lead.alias("lead")).select(F.xxhash64("words").alias("v"), "words", "lead"))
    places = written(classes.select("v", F.explode("words").alias("fp")))
    first = written(places.groupBy("fp").agg(F.min("v").alias("b"), F.count("*").alias("weight")))
    same = heavy_join(places, first.where("weight > 1"), ["fp"]).select(F.col("v").alias("a"), "b")
    met = written(links(first, RADIUS, bits=TABLE_BITS, tables=TABLES, forest=False).distinct())
    other = met.join(first.select(F.col("fp").alias("a"), F.col("b").alias("va")), "a").join(first.select(F.col("fp").alias("b"), F.col("b").alias("vb")), "b").select(F.col("va").alias("a"), F.col("vb").alias("b"))
    pairs = written(same.unionByName(other).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    wanted = pairs.select(F.col("a").alias("v")).union(pairs.select("b")).groupBy("v").agg(F.count("*").alias("weight"))
    named = classes.join(wanted, "v").select("v", "weight", F.col("lead.id").alias("_lead_id"), F.col("lead.row").alias("_lead_row"))
    keyed = docs.select("doc_id", "text", row_key().alias("_row"))
    texts = keyed.join(named, keyed["doc_id"].eqNullSafe(named["_lead_id"]) & (keyed["_row"] == named["_lead_row"])).select("v", "text").dropDuplicates(["v"])
    sets = written(_sets(texts, width)).join(wanted, "v")
    both = heavy_join(pairs, sets.select(F.col("v").alias("a"), F.col("own").alias("x"), "weight"), ["a"]).drop("weight")
    both = heavy_join(both, sets.select(F.col("v").alias("b"), F.col("own").alias("y"), "weight"), ["b"])
    shared = F.size(F.array_intersect("x", "y"))
    alike = both.where(shared >= (F.size("x") + F.size("y") - shared) * F.lit(similarity - 1e-9)).select("a", "b")
    roots = components(alike)
    leads = classes.join(roots, "v", "left").groupBy(F.coalesce("root", "v").alias("root")).agg(F.min("lead").alias("lead"))
    return _kept(docs, fps, leads)
