"""Repeated strings of a fixed least length, found over sparsely sampled suffixes.

Both the suffix-array and the suffix-tree operator ask, for every position of a
sequence of symbols (bytes, or words as 64-bit hashes), whether the ``length``
symbols that begin there (a *window*) begin elsewhere too.  Sorting every suffix
of the corpus would shuffle the corpus ``length`` times over, so suffixes are
sampled by content:

1.  Each window is assigned to one *anchor* in it: of its ``length - prefix + 1``
    prefixes of ``prefix`` symbols the one with the smallest hash, the leftmost
    on a tie.  Equal windows have equal anchors at equal offsets, so equal
    windows only meet under the same anchor prefix.  Windows that follow each
    other share anchors; a row stands for such a run (its *context* is the
    symbols that its windows cover).
2.  Rows are grouped by the anchor's prefix and only prefixes that occur more than
    once go on.  Equal contexts under a prefix become one *class*, a leaf with a
    count; the first of them stands for all.
3.  A prefix with more than ``group_limit`` classes is lengthened: a class's windows
    are halved by their offset from the anchor, and each half holds a longer string
    around the anchor, which is its new prefix.  Prefixes are lengthened step by step
    until every group fits; at the last step a prefix is a whole window.
4.  What is left under one prefix is one partition of the suffixes.  Partitions are
    packed, many to a block of bounded size, and each block is suffix-sorted, with the
    common prefixes of neighbours (:class:`Block`).  The operators read their arrays
    and trees from it: for each window's suffix how far it is covered.

The sampling is exact: no window is lost.  Blocks compare symbols, not hashes of
windows.  Equality of prefixes and of contexts is decided by 64-bit hashes of each,
both of which would have to collide at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import heavy_join, mix64, row_key, written

#: Symbols hashed at once, and of a long text in one piece.
PIECE = 1 << 19
#: Classes under one prefix beyond which the prefix is lengthened.
GROUP_LIMIT = 4096
#: Symbols that are suffix-sorted at once.
BLOCK = 1 << 20

_BASE = 0x9E6C63D0876A9A47 | 1

#: The symbols of a batch of texts, end to end, and how many each text has.
Symbols = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


@lru_cache(maxsize=1)
def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    n = 2 * PIECE
    up = np.full(n, _BASE, dtype=np.uint64)
    down = np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@dataclass(frozen=True)
class Shape:
    """What is looked for: windows of ``length`` symbols, anchors of ``prefix`` symbols,
    ``width`` bytes a symbol."""

    length: int
    prefix: int
    width: int

    def symbols(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, dtype=np.uint8 if self.width == 1 else np.uint64)

    def values(self, symbols: np.ndarray) -> np.ndarray:
        return BYTE_VALUES[symbols] if self.width == 1 else mix64(symbols)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, end to end, and how many each text has."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, places, data = column.buffers()
    at = np.frombuffer(places, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, np.diff(at.astype(np.int64))


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    out, span = v, 1
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return out if span == width else np.minimum(out[: len(out) - (width - span)], out[width - span :])


def _prefix_sums(values: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers()[0][: len(values)], out=sums[1:])
    return sums


def _context_hash(sums: np.ndarray, first: np.ndarray, span: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Of ``span`` symbols from ``first`` on, in which the first window has its anchor at ``offset``."""
    return mix64((sums[first + span] - sums[first]) * powers()[1][first] + mix64(span.astype(np.uint64) * np.uint64(4096) + offset.astype(np.uint64)))


def anchors(symbols: np.ndarray, sizes: np.ndarray, shape: Shape):
    """Runs of windows with one anchor: arrays (sequence, key, context, first window,
    windows, offset of the anchor in the first window), in order."""
    found = []
    pack, held = [], 0

    def flush() -> None:
        nonlocal pack, held
        if pack:
            found.append(_anchors(pack, shape))
            pack, held = [], 0

    ends = np.cumsum(sizes)
    for i in np.flatnonzero(sizes >= shape.length).tolist():
        s = symbols[ends[i] - sizes[i] : ends[i]]
        for at in range(0, len(s) - shape.length + 1, PIECE):
            piece = s[at : at + PIECE + shape.length - 1]
            if held + len(piece) > PIECE + shape.length:
                flush()
            pack.append((i, at, piece))
            held += len(piece)
    flush()
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else None


def _anchors(pack: list[tuple[int, int, np.ndarray]], shape: Shape):
    length, prefix = shape.length, shape.prefix
    sizes = np.array([len(p) for _, _, p in pack])
    begins = np.cumsum(sizes) - sizes
    sums = _prefix_sums(shape.values(np.concatenate([p for _, _, p in pack])))
    down = powers()[1]
    grams = mix64((sums[prefix:] - sums[:-prefix]) * down[: len(sums) - prefix])
    low = np.uint64(0xFFFFFFFF)
    packed = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    chosen = (_sliding_min(packed, length - prefix + 1) & low).astype(np.int64)
    inside = np.zeros(len(chosen) + 1, dtype=np.int8)  # windows that stay within their piece
    inside[begins] += 1
    stops = begins + sizes - length + 1
    np.subtract.at(inside, np.minimum(stops, len(chosen)), 1)
    inside = np.cumsum(inside[:-1]) > 0
    fresh = inside.copy()
    fresh[1:] &= (chosen[1:] != chosen[:-1]) | ~inside[:-1]
    fresh[begins] = inside[begins]
    first = np.flatnonzero(fresh)
    piece = np.searchsorted(begins, first, side="right") - 1
    n = np.diff(np.append(first, len(chosen)))
    n = np.minimum(n, stops[piece] - first)
    at = chosen[first]
    offset = at - first
    context = _context_hash(sums, first, n + length - 1, offset)
    owner = np.array([i for i, _, _ in pack])[piece]
    base = np.array([a for _, a, _ in pack])[piece] - begins[piece]
    return owner, grams[at].view(np.int64), context.view(np.int64), first + base, n, offset


class Block:
    """Sequences of symbols with the suffixes of all their windows in suffix order.

    ``order`` holds the windows (numbered through all sequences) by their suffixes up to
    the ends of their sequences, ties by number; ``common[r]`` is the number of symbols
    that the suffixes ``order[r - 1]`` and ``order[r]`` share (0 for r = 0).  Both are
    exact up to a depth of at least ``length`` symbols.
    """

    def __init__(self, sequences: list[np.ndarray], length: int):
        sizes = np.array([len(s) for s in sequences])
        self.begins = np.cumsum(sizes + 1) - sizes - 1  # a separator, below all symbols, ends each
        n = sizes - length + 1
        self.sequence = np.repeat(np.arange(len(sizes)), n)
        self.within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.starts = self.begins[self.sequence] + self.within
        room = sizes[self.sequence] - self.within
        self.size = int(sizes.sum() + len(sizes))
        if sequences[0].dtype == np.uint8:
            rank = np.concatenate([x for s in sequences for x in (s.astype(np.int64) + 1, np.zeros(1, dtype=np.int64))])
        else:
            rank = np.zeros(self.size, dtype=np.int64)
            inside = np.ones(self.size, dtype=bool)
            inside[self.begins + sizes] = False
            rank[inside] = np.unique(np.concatenate(sequences), return_inverse=True)[1] + 1
        # ranks of runs of `span` symbols, as many runs to a number as its bits hold
        levels, span = [(1, rank)], 1
        while span < length:
            bits = int(rank.max()).bit_length()
            many = min(63 // bits, -(-length // span))
            key = np.zeros(len(rank), dtype=np.int64)
            for j in range(many):
                key <<= bits
                key[: max(len(rank) - j * span, 0)] |= rank[j * span :]
            rank = np.unique(key, return_inverse=True)[1] + 1
            span *= many
            levels.append((span, rank))
        self.order = np.argsort(rank[self.starts], kind="stable")
        a, b = self.starts[self.order[:-1]], self.starts[self.order[1:]]
        most = np.minimum(room[self.order[:-1]], room[self.order[1:]])
        same = np.zeros(len(a), dtype=np.int64)
        above = 2 * span  # at the top one step, below as many as a run of the level above holds
        for span, rank in reversed(levels):
            live = np.arange(len(a))
            for _ in range(above // span - 1):
                live = live[same[live] < most[live]]
                live = live[rank[a[live] + same[live]] == rank[b[live] + same[live]]]
                if not len(live):
                    break
                same[live] += span
            above = span
        self.common = np.zeros(len(self.order), dtype=np.int64)
        self.common[1:] = np.minimum(same, most)

    def covered(self, reach: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(sequence, begins, ends) of what the windows' first ``reach`` symbols cover."""
        step = np.zeros(self.size + 1, dtype=np.int64)
        hit = np.flatnonzero(reach)
        np.add.at(step, self.starts[hit], 1)
        np.subtract.at(step, self.starts[hit] + reach[hit], 1)
        a, b = runs_of(np.cumsum(step) > 0)
        owner = np.searchsorted(self.begins, a, side="right") - 1
        for i in np.unique(owner).tolist():
            own = slice(*np.searchsorted(owner, [i, i + 1]))
            yield i, a[own] - self.begins[i], b[own] - self.begins[i]


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


#: Which windows count as repeated: "all" that occur more than once, "later" ones that
#: have occurred before (by id and position), or "later_docs" that occur under a smaller id.
MODES = ("all", "later", "later_docs")

#: For a block and the document (by ascending id) of each sequence: how many symbols from
#: each window on are repeated, 0 or at least the window's length.
Reach = Callable[[Block, np.ndarray], np.ndarray]


def _lengthened(shape: Shape, symbols: bytes, n: int, offset: int, low: int, high: int) -> Iterator[tuple]:
    """Halves the windows of a class, of which a prefix allows offsets ``low`` to ``high`` of
    the anchor: (low, high, key, context, first window, windows, offset of the anchor in it)."""
    cut = shape.symbols(symbols)
    sums = _prefix_sums(shape.values(cut))
    middle = (low + high) // 2
    for a, b in ((low, middle), (middle + 1, high)):
        begin, end = max(0, offset - b), min(n, offset - a + 1)  # window j has offset - j
        if begin < end:
            # all windows of these offsets hold what lies between
            at = np.array([offset - a])
            key = _context_hash(sums, at, np.array([shape.length - b + a]), np.array([a]))
            context = _context_hash(sums, np.array([begin]), np.array([end - begin + shape.length - 1]), np.array([offset - begin]))
            yield a, b, int(key.view(np.int64)[0]), int(context.view(np.int64)[0]), begin, end - begin, offset - begin


_PART = [("key0", pa.int64()), ("context0", pa.int64()), ("first", pa.int32()), ("settled", pa.bool_()), ("low", pa.int32()), ("high", pa.int32()), ("key", pa.int64()), ("context", pa.int64()), ("pos", pa.int32()), ("n", pa.int32()), ("offset", pa.int32()), ("symbols", pa.binary())]
_PART_DDL = "key0 long, context0 long, first int, settled boolean, low int, high int, key long, context long, pos int, n int, offset int, symbols binary"


def _parts_batch(ids: list, rows: list, parts: list[tuple], id_pa: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*parts, strict=True)) or [()] * len(_PART)
    return pa.RecordBatch.from_arrays([pa.array(ids, id_pa), pa.array(rows, pa.int64()), *(pa.array(c, t) for c, (_, t) in zip(columns, _PART, strict=True))], ["id", "row", *(n for n, _ in _PART)])


def repeated(docs: DataFrame, symbols_of: Symbols, shape: Shape, mode: str, reach: Reach, id_col: str = "doc_id", text_col: str = "text", group_limit: int = GROUP_LIMIT) -> DataFrame:
    """The documents with their repeated windows: (id, text, spans), where spans is an
    array of (begin, end) symbol positions in order, covered by repeated windows; null
    where there are none.

    Rows equal in id and text are one document to "later_docs" and copies of each other
    to the other modes.  A null id comes before all others.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    id_type = docs.schema[id_col].dataType.simpleString()
    length = shape.length
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("row"))

    def sliced(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = max(1, batch.num_rows * 4 * PIECE // max(1, batch.column(column).nbytes))
            for b in range(0, batch.num_rows, size):
                yield batch.slice(b, size)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, 1):
            found = anchors(*symbols_of(part.column(1)), shape)
            if found is None:
                continue
            owner, key, context, first, n, offset = found
            # of equal contexts within a row the first one stands for the others
            order = np.lexsort((first, context, key, owner))
            same = np.zeros(len(order), dtype=bool)
            o = order
            same[o[1:]] = (owner[o[1:]] == owner[o[:-1]]) & (key[o[1:]] == key[o[:-1]]) & (context[o[1:]] == context[o[:-1]])
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(owner)), part.column(2).take(pa.array(owner)), pa.array(key), pa.array(context), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(offset.astype(np.int32)), pa.array(same)],
                ["id", "row", "key", "context", "first", "n", "offset", "again"],
            )

    rows = written(keyed.mapInArrow(emit, f"id {id_type}, row long, key long, context long, first int, n int, offset int, again boolean"))
    kept = written(heavy_join(rows, rows.groupBy("key").agg(F.count("*").alias("weight")).where("weight > 1"), ["key"]).drop("weight"))
    classes = written(kept.groupBy("key", "context").agg(F.count("*").alias("times"), F.min(F.struct("id", "row", "again", "first", "n", "offset")).alias("lead")))
    leads = heavy_join(classes, classes.groupBy("key").agg(F.count("*").alias("weight")), ["key"]).withColumnRenamed("weight", "classes")
    leads = leads.where((F.col("classes") > 1) | (F.col("times") > 1)).select("key", "context", "times", "classes", *(F.col(f"lead.{c}").alias(c) for c in ("id", "row", "first", "n", "offset")))
    leads = written(leads)

    # Classes of more than one row: what holds for copies of the first one as a whole.
    twins = leads.where("times > 1").select("key", "context", F.col("times").alias("weight"), F.col("id").alias("lead_id"), F.col("row").alias("lead_row"), F.col("first").alias("lead_first"))
    copies = heavy_join(kept, twins, ["key", "context"])
    is_lead = F.col("id").eqNullSafe(F.col("lead_id")) & (F.col("row") == F.col("lead_row")) & (F.col("first") == F.col("lead_first"))
    if mode == "later":
        copies = copies.where(~is_lead)
    elif mode == "later_docs":
        copies = copies.where(~F.col("id").eqNullSafe(F.col("lead_id")))
    whole = copies.select("id", "row", F.col("first").alias("begin"), (F.col("first") + F.col("n") + length - 1).alias("end"))

    # Classes that share a prefix with others: their symbols go to the block of the prefix.
    wanted = leads.where("classes > 1").withColumn("settled", F.lit(mode == "all") & (F.col("times") > 1))
    per_doc = wanted.groupBy("id", "row").agg(F.collect_list(F.struct("key", "context", "first", "n", "offset", "settled", (F.col("classes") > group_limit).alias("hot"))).alias("runs"))
    texts = keyed.join(per_doc, keyed["id"].eqNullSafe(per_doc["id"]) & (keyed["row"] == per_doc["row"])).select(keyed["id"], keyed["row"], "text", "runs")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, 2):
            symbols, sizes = symbols_of(part.column(2))
            ends = np.cumsum(sizes)
            ids, marks, out, hot = [], [], [], []
            for rid, row, runs, begin in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(3).to_pylist(), (ends - sizes).tolist(), strict=True):
                for r in runs:
                    at, n = r["first"], r["n"]
                    cut = symbols[begin + at : begin + at + n + length - 1].tobytes()
                    ids.append(rid)
                    marks.append(row)
                    out.append((r["key"], r["context"], at, r["settled"], 0, length - shape.prefix, r["key"], r["context"], at, n, r["offset"], cut))
                    hot.append(r["hot"])
            made = _parts_batch(ids, marks, out, part.column(0).type)
            yield pa.RecordBatch.from_arrays([*made.columns, pa.array(hot, pa.bool_())], [*made.schema.names, "hot"])

    base = f"id {id_type}, row long, {_PART_DDL}"
    has_hot = not leads.where(F.col("classes") > group_limit).isEmpty()
    members = texts.mapInArrow(contexts, f"{base}, hot boolean")
    if has_hot:
        members = written(members)
    ready = members.where("not hot").drop("hot") if has_hot else members.drop("hot")
    spans = f"id {id_type}, row long, key long, context long, first int, begin int, end int"
    part_spans = None

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, 13):
            ids, marks, out = [], [], []
            for rid, row, key0, context0, first, settled, low, high, _, _, pos, n, offset, symbols in zip(*(c.to_pylist() for c in part.columns), strict=True):
                for a, b, key, context, begin, many, off in _lengthened(shape, symbols, n, offset, low, high):
                    ids.append(rid)
                    marks.append(row)
                    out.append((key0, context0, first, settled, a, b, key, context, pos + begin, many, off, symbols[begin * shape.width : (begin + many + length - 1) * shape.width]))
            yield _parts_batch(ids, marks, out, part.column(0).type)

    hot = members.where("hot").drop("hot").dropDuplicates(["key", "context"]) if has_hot else None
    while hot is not None and not hot.isEmpty():
        # prefixes grow by one step; equal parts of several classes become one again
        parts = written(hot.select("id", "row", *(n for n, _ in _PART)).mapInArrow(split, base))
        same = parts.groupBy("key", "context").agg(F.count("*").alias("weight"), F.min(F.struct("id", "row", "pos")).alias("lead"))
        parts = written(heavy_join(parts, written(same), ["key", "context"]))
        leading = F.struct("id", "row", "pos").eqNullSafe(F.col("lead"))
        other = ~F.col("id").eqNullSafe(F.col("lead.id")) if mode == "later_docs" else (F.col("weight") > 1 if mode == "all" else ~leading)
        done = parts.where(other & ~F.col("settled")).select("id", "row", F.col("key0").alias("key"), F.col("context0").alias("context"), "first", F.col("pos").alias("begin"), (F.col("pos") + F.col("n") + length - 1).alias("end"))
        part_spans = done if part_spans is None else part_spans.unionByName(done)
        alive = parts.where(leading | ~other) if mode == "later_docs" else parts.where(leading)
        alive = alive.withColumn("settled", F.col("settled") | (F.lit(mode == "all") & (F.col("weight") > 1))).drop("weight", "lead")
        counts = written(alive.groupBy("key").agg(F.count("*").alias("weight")).where("weight > 1"))
        sized = written(heavy_join(alive, counts, ["key"]))
        ready = ready.unionByName(sized.where(F.col("weight") <= group_limit).drop("weight"))
        # at one offset a prefix is a whole window: what is left there belongs to one document
        hot = sized.where((F.col("weight") > group_limit) & (F.col("low") < F.col("high"))).drop("weight")

    def sort_block(rows: list, id_pa) -> pa.RecordBatch | None:
        """``rows``: (id, row, key0, context0, first, settled, key, context, pos, symbols) of whole prefixes."""
        rows = list({(r[6], r[7], r[0], r[1], r[8]): r for r in rows}.values())  # a repeated row brings its contexts twice
        rows.sort(key=lambda r: (r[0] is not None, r[0], r[1], r[8]))
        doc = np.zeros(len(rows), dtype=np.int64)
        for i in range(1, len(rows)):
            doc[i] = doc[i - 1] + (rows[i][0] != rows[i - 1][0])
        block = Block([shape.symbols(r[9]) for r in rows], length)
        which, a, b = [], [], []
        for i, x, y in block.covered(reach(block, doc)):
            if not rows[i][5]:
                which += [i] * len(x)
                a += (x + rows[i][8]).tolist()
                b += (y + rows[i][8]).tolist()
        if not which:
            return None
        own = [rows[i] for i in which]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in own], id_pa), *(pa.array([r[k] for r in own], pa.int64()) for k in (1, 2, 3)), pa.array([r[4] for r in own], pa.int32()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["id", "row", "key", "context", "first", "begin", "end"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by prefix; whole prefixes are gathered up to a block."""
        held, size, id_pa = [], 0, None
        for batch in batches:
            id_pa = batch.column(0).type
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= BLOCK and held[-1][6] != r[6]:
                    if (out := sort_block(held, id_pa)) is not None:
                        yield out
                    held, size = [], 0
                held.append(r)
                size += len(r[9]) // shape.width
        if held and (out := sort_block(held, id_pa)) is not None:
            yield out

    ready = ready.select("id", "row", "key0", "context0", "first", "settled", "key", "context", "pos", "symbols")
    partial = ready.repartition("key").sortWithinPartitions("key").mapInArrow(blocks, spans)
    if part_spans is not None:
        partial = partial.unionByName(part_spans)
    if mode == "later_docs":
        # a class that recurs under its first id: what holds for its first place holds for the rest
        partial = written(partial)
        of_class = leads.where("times > 1").select("key", "context", "times").join(partial.groupBy("key", "context").agg(F.collect_set(F.struct((F.col("begin") - F.col("first")).alias("b"), (F.col("end") - F.col("first")).alias("e"))).alias("found"), F.first(F.struct("id", "row", "first")).alias("lead")), ["key", "context"])
        moved = heavy_join(kept, of_class.withColumnRenamed("times", "weight"), ["key", "context"]).where(F.col("id").eqNullSafe(F.col("lead.id")) & ~((F.col("row") == F.col("lead.row")) & (F.col("first") == F.col("lead.first"))))
        moved = moved.select("id", "row", "first", F.explode("found").alias("s"))
        whole = whole.unionByName(moved.select("id", "row", (F.col("first") + F.col("s.b")).alias("begin"), (F.col("first") + F.col("s.e")).alias("end")))
    found = whole.unionByName(partial.select("id", "row", "begin", "end"))
    marks = found.groupBy("id", "row").agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("spans"))
    return keyed.join(marks, keyed["id"].eqNullSafe(marks["id"]) & (keyed["row"] == marks["row"]), "left").select(keyed["id"], "text", "spans")


def merged_spans(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Overlapping and touching spans, given in order, made one."""
    out: list[list[int]] = []
    for s in spans or ():
        if out and s["begin"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["end"])
        else:
            out.append([s["begin"], s["end"]])
    return [(a, b) for a, b in out]
