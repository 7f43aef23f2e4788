"""Context-triggered piecewise hashing of documents.

A rolling hash of the last seven bytes ends a chunk wherever it hits a trigger value
for the block size; every chunk's hash gives one of 64 characters.  Triggers of a
block size are triggers of half of it too.  The block size is the largest for which
the text has at least ``MIN_CHUNKS`` triggers, or the next one where these are more than
``MAX_CHUNKS``, as in repetitive texts, so that signatures are bounded whatever the text;
the fingerprint holds the signatures
at that size and at the next: ``size:signature:signature of twice the size``.
Fingerprints are compared by edit distance (insertions and deletions) between
signatures of one block size, provided that they share a run of characters.

Defined results: a null text is empty; its fingerprint has empty signatures.  Texts
are whole, signatures are not cut.  Ties of the id are ordered by text; null ids come
before all others; the document after the last is the first, of a single document it
is itself.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.shared import mix64, written

SMALLEST = 3
MIN_CHUNKS = 32
MAX_CHUNKS = 256
RUN = 4
_ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", dtype=np.uint8)
_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)).astype(np.uint32)
_ROLL = np.uint32(0x01000193)
#: Bytes hashed at once.
PIECE = 1 << 20
_BASE = 0x5851F42D4C957F2D


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _BASE, dtype=np.uint64)
    down = np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _triggers(raw: np.ndarray) -> np.ndarray:
    """The rolling hash at every byte, of it and the six before."""
    values = _VALUES[raw]
    out = values.copy()
    for back in range(1, 7):
        out[back:] += values[:-back] * np.uint32(pow(int(_ROLL), back, 1 << 32))
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x2C1B3C6D)
    out ^= out >> np.uint32(12)
    return out


def _signature(ends: np.ndarray, sums: np.ndarray, n: int) -> str:
    """One character for each chunk; ``ends`` are the positions after the triggers."""
    if not n:
        return ""
    stops = ends if len(ends) and ends[-1] == n else np.append(ends, n)
    begins = np.concatenate([[0], stops[:-1]])
    hashes = mix64((sums[stops] - sums[begins]) * _POWERS[0][1][begins] + (stops - begins).astype(np.uint64))
    return _ALPHABET[(hashes >> np.uint64(58)).astype(np.int64)].tobytes().decode("ascii")


def fingerprint(text: str) -> str:
    raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
    n = len(raw)
    if not _POWERS or len(_POWERS[0][0]) <= n:
        _POWERS[:] = [_powers(max(n + 1, 1 << 18))]
    rolled = _triggers(raw) if n else np.zeros(0, dtype=np.uint32)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(raw.astype(np.uint64) * _POWERS[0][0][:n] + _POWERS[0][0][:n], out=sums[1:])
    # position and trigger strength: how often the block size can be doubled and still hit
    hit = np.flatnonzero(rolled % np.uint32(SMALLEST) == SMALLEST - 1)
    quotient = rolled[hit] // np.uint32(SMALLEST)
    strength = np.zeros(len(hit), dtype=np.int64)
    alive = np.arange(len(hit))
    level = 0
    while len(alive):
        alive = alive[(quotient[alive] >> np.uint32(level)) & np.uint32(1) == 1]
        level += 1
        strength[alive] = level
        if level > 28:
            break
    k = 0
    while int((strength >= k + 1).sum()) >= MIN_CHUNKS:
        k += 1
    if int((strength >= k).sum()) > MAX_CHUNKS:  # all but the same window again and again: the next size has few
        k += 1
    ends = hit + 1
    return f"{SMALLEST << k}:{_signature(ends[strength >= k], sums, n)}:{_signature(ends[strength >= k + 1], sums, n)}"


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        m = where.get(c)
        if m:
            x = row & m
            row = ((row + x) | (row - x)) & full
    return len(a) - row.bit_count()


def _alike(a: str, b: str) -> float:
    if a == b:
        return 1.0 if a else 0.0
    if min(len(a), len(b)) < RUN or {a[i : i + RUN] for i in range(len(a) - RUN + 1)}.isdisjoint(b[i : i + RUN] for i in range(len(b) - RUN + 1)):
        return 0.0
    return 2 * _common(a, b) / (len(a) + len(b))  # 1 - distance / most distance possible


def likeness(a: str, b: str) -> float:
    """0 to 1; 1 for equal fingerprints, 0 for block sizes that aren't compatible."""
    if a == b:
        return 1.0
    (x, a1, a2), (y, b1, b2) = a.split(":"), b.split(":")
    x, y = int(x), int(y)
    if x == y:
        return max(_alike(a1, b1), _alike(a2, b2))
    if x == 2 * y:
        return _alike(a1, b2)
    if y == 2 * x:
        return _alike(a2, b1)
    return 0.0


def edited_text(text: str, after: str) -> str:
    """The last half of ``text`` replaced by the beginning of ``after``."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _row(text: str, fp: str, after: str, after_fp: str) -> tuple:
    edited = edited_text(text, after)
    efp = fingerprint(edited)
    return hashlib.sha256(edited.encode("utf-8")).hexdigest(), efp, likeness(fp, efp), likeness(fp, after_fp)


_FIELDS = [("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_DDL = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next): each document beside its edited text and the next document by id.

    Texts are range-partitioned by id once; only the last document of each partition
    meets the first of the next one in a second, small step.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    ranged = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).repartitionByRange("id").sortWithinPartitions("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        before = None  # (id, text, fingerprint) of the row that still has no next
        names = ["id", *(n for n, _ in _FIELDS), "part", "head", "head_text", "tail_text"]

        def batch(rows: list[tuple], id_pa: pa.DataType) -> pa.RecordBatch:
            types = [id_pa, *(t for _, t in _FIELDS), pa.int32(), pa.bool_(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        id_pa = None
        for whole in batches:
            id_pa = whole.schema.field(0).type
            for at in range(0, whole.num_rows, 256):
                cut = whole.slice(at, 256)
                rows = []
                for rid, text in zip(cut.column(0).to_pylist(), cut.column(1).to_pylist(), strict=True):
                    text = text or ""
                    fp = fingerprint(text)
                    if before is None:
                        rows.append((rid, None, None, fp, None, None, None, part, True, text, None))
                    else:
                        bid, btext, bfp = before
                        sha, efp, near, far = _row(btext, bfp, text, fp)
                        rows.append((bid, len(btext), sha, bfp, efp, near, far, part, False, None, None))
                    before = (rid, text, fp)
                if rows:
                    yield batch(rows, id_pa)
        if before is not None:
            bid, btext, bfp = before
            yield batch([(bid, len(btext), None, bfp, None, None, None, part, False, None, btext)], id_pa)

    done = written(ranged.mapInArrow(run, f"id {kind}, {_DDL}, part int, head boolean, head_text string, tail_text string"))
    inner = done.where("not head and tail_text is null")
    # one row a partition from here on; texts take no part in the window
    parts = done.where("head").select("part")
    order = W.orderBy("part")
    following = parts.select("part", F.coalesce(F.lead("part").over(order), F.first("part").over(order)).alias("after"))
    heads = done.where("head").select(F.col("part").alias("after"), F.col("head_text"), F.col("fingerprint").alias("head_fp"))
    tails = done.where("tail_text is not null").select("id", "part", "n_chars", "fingerprint", "tail_text")
    edge = tails.join(following, "part").join(heads, "after").select("id", "n_chars", "fingerprint", "tail_text", "head_text", "head_fp")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [_row(t, f, h, g) for f, t, h, g in zip(*(c.to_pylist() for c in b.columns[2:]), strict=True)]
            sha, efp, near, far = (list(c) for c in zip(*made, strict=True)) if made else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sha, pa.string()), b.column(2), pa.array(efp, pa.string()), pa.array(near, pa.float64()), pa.array(far, pa.float64())], ["id", *(n for n, _ in _FIELDS)])

    closed = edge.mapInArrow(close, f"id {kind}, {_DDL}")
    out = inner.select("id", *(n for n, _ in _FIELDS)).unionByName(closed)
    return out.withColumnRenamed("id", id_col)
