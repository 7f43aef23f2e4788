"""Removal of repeated word windows by prefix-partitioned suffix trees.

Suffixes of word sequences are partitioned by a prefix, lengthened step by step where a
prefix is too common for one group (see ``sparse_suffix``).  Each group's suffixes are
sorted, and the prefixes that neighbours share give the internal nodes of the group's
suffix tree.  The topmost nodes of a depth of at least ``window`` words are repeats: all
their leaves but those of the smallest id lose the node's string.

Defined results: words are runs of characters other than space and 0x09 to 0x0D,
taken unchanged; a null text has none.  Documents with fewer words than ``window``
lose nothing.  Repeats inside one document, or among rows of one id, stay.  A null
id comes before all others.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from tidemark.llm.shared import SPACE_CHARS, mix64, row_slices, words_of
from tidemark.llm.sparse_suffix import BYTE_VALUES, GROUP_LIMIT, Block, Shape, merged_spans, powers, repeated, runs_of, text_bytes

WINDOW = 50
#: Words of more bytes are hashed one by one.
LONG_WORD = 512
#: Bytes of text hashed at once.
CHUNK = 1 << 19
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[ord(c) for c in SPACE_CHARS]] = True


def word_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a string column, end to end, and how many each text
    has.  White space is ASCII, so words are runs of the UTF-8 bytes."""
    raw, sizes = text_bytes(column)
    text_ends = np.cumsum(sizes)
    word = ~_SPACE[raw]
    head, tail = word.copy(), word.copy()
    head[1:] &= ~word[:-1]
    tail[:-1] &= ~word[1:]
    edges = text_ends[:-1][(text_ends[:-1] > 0) & (text_ends[:-1] < len(raw))]  # words end with their texts
    head[edges] = word[edges]
    tail[edges - 1] = word[edges - 1]
    begins, ends = np.flatnonzero(head), np.flatnonzero(tail) + 1
    out = np.empty(len(begins), dtype=np.uint64)
    up, down = powers()
    at = 0
    while at < len(begins):
        if ends[at] - begins[at] > LONG_WORD:
            out[at] = xxhash.xxh3_64_intdigest(raw[begins[at] : ends[at]].tobytes())
            at += 1
            continue
        base = begins[at]
        stop = int(np.searchsorted(ends, base + CHUNK, side="right"))
        long = np.flatnonzero(ends[at:stop] - begins[at:stop] > LONG_WORD)
        stop = at + int(long[0]) if len(long) else stop
        piece = raw[base : ends[stop - 1]]
        sums = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum(BYTE_VALUES[piece] * up[: len(piece)], out=sums[1:])
        b, e = begins[at:stop] - base, ends[at:stop] - base
        out[at:stop] = mix64((sums[e] - sums[b]) * down[b] + (e - b).astype(np.uint64))
        at = stop
    places = np.searchsorted(begins, np.concatenate([[0], text_ends]))
    return out, np.diff(places)


def deep_nodes(common: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The topmost internal nodes of the suffix tree that lie at least ``depth`` deep:
    (first leaf, after the last leaf, depth of the node), leaves being places in suffix
    order.  An internal node is an interval of places; what its neighbours share is its
    string, which is a maximal repeat to the right."""
    inside = common >= depth
    begin, end = runs_of(inside)
    deep = np.minimum.reduceat(np.where(inside, common, np.iinfo(np.int64).max), begin) if len(begin) else begin
    return begin - 1, end, deep


def _reach(window: int):
    def reach(block: Block, doc: np.ndarray) -> np.ndarray:
        first, last, depth = deep_nodes(block.common, window)
        out = np.zeros(len(block.order), dtype=np.int64)
        if len(first):
            n = last - first
            leaf = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
            at = block.order[leaf]
            own = doc[block.sequence[at]]
            least = np.minimum.reduceat(own, np.cumsum(n) - n)
            out[at] = np.where(own > np.repeat(least, n), np.repeat(depth, n), 0)
        return out

    return reach


def repeated_spans(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(id, text, spans): the word ranges that windows of an earlier id cover."""
    return repeated(docs, word_ids, Shape(window, max(1, window // 2), 8), "later_docs", _reach(window), id_col, text_col, group_limit)


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, kept): ``kept`` is what is left, its words
    joined by one space."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches):
            rows = []
            for text, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                words = words_of(text or "")
                at, left = 0, []
                for a, b in merged_spans(spans):
                    left += words[at:a]
                    at = b
                left += words[at:]
                kept = " ".join(left)
                rows.append((len(words), len(words) - len(left), hashlib.sha256(kept.encode("utf-8")).hexdigest(), kept))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))], [id_col, "n_words", "n_removed", "kept_sha256", "kept"])

    spans = repeated_spans(docs, window, id_col, text_col, group_limit)
    kind = docs.schema[id_col].dataType.simpleString()
    return spans.mapInArrow(cut, f"`{id_col}` {kind}, n_words long, n_removed long, kept_sha256 string, kept string")
