"""Removal of repeated byte strings by suffix arrays and longest-previous-factor arrays.

Blocks of suffixes that begin alike are suffix-sorted (see ``sparse_suffix``), numbered
by id and position.  In suffix order the previous and the next smaller number of a
suffix give its longest earlier match: the longest-previous-factor array.  A suffix
whose factor has at least ``min_bytes`` bytes repeats an earlier one, and all of the
factor goes; ``keep="none"`` adds the array of the reversed numbers, which tells what
comes again later.

Defined results: texts are UTF-8 bytes and a null text is empty.  Texts shorter
than ``min_bytes`` lose nothing.  Matches never cross documents.  Rows equal in id
and text count as copies of each other with ``keep="none"`` and as one document
with ``keep="first"``, where a null id comes before all others.  Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.shared import row_slices
from tidemark.llm.sparse_suffix import GROUP_LIMIT, Block, Shape, merged_spans, repeated, text_bytes

MIN_BYTES = 400


def _previous_smaller(order: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """For each place in suffix order what its suffix shares with the one at the nearest
    place before it that holds a smaller number; 0 where that is below ``least``.

    Every place points at the one before it and, while that holds a larger number, on to
    where that one points: all between is larger, and shares no less than the minimum.
    """
    place, shared = np.arange(len(order)) - 1, np.where(common >= least, common, 0)
    live = np.flatnonzero(shared)
    live = live[order[place[live]] > order[live]]
    while len(live):
        p = place[live]
        shared[live], place[live] = np.minimum(shared[live], shared[p]), place[p]
        live = live[shared[live] > 0]
        live = live[order[place[live]] > order[live]]
    return shared


def longest_factors(order: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """The longest-previous-factor array: for each number the longest prefix of its suffix
    that also begins at a smaller number, by the previous and the next smaller number in
    suffix order.  Factors below ``least`` count as 0."""
    before = _previous_smaller(order, common, least)
    after = _previous_smaller(order[::-1], np.append(common[:1] * 0, common[:0:-1]), least)[::-1]
    out = np.empty_like(before)
    out[order] = np.maximum(before, after)
    return out


def _reach(keep: str, min_bytes: int):
    def reach(block: Block, doc: np.ndarray) -> np.ndarray:
        earlier = longest_factors(block.order, block.common, min_bytes)
        if keep == "first":
            return earlier
        # the same with the numbers reversed: matches that come later
        return np.maximum(earlier, longest_factors(len(block.order) - 1 - block.order, block.common, min_bytes)[::-1])

    return reach


def repeated_spans(docs: DataFrame, min_bytes: int = MIN_BYTES, keep: str = "none", id_col: str = "doc_id", text_col: str = "text", group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(id, text, spans): the byte ranges of every document that repeated strings of at
    least ``min_bytes`` bytes cover; ``keep="first"`` leaves each string's first place out."""
    shape = Shape(min_bytes, max(1, min_bytes * 11 // 20), 1)
    return repeated(docs, text_bytes, shape, {"none": "all", "first": "later"}[keep], _reach(keep, min_bytes), id_col, text_col, group_limit)


def remove_repeats(docs: DataFrame, min_bytes: int = MIN_BYTES, keep: str = "none", id_col: str = "doc_id", text_col: str = "text", group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept): ``kept`` is what is left of
    the text, as bytes, since a cut may fall inside a character."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches):
            rows = []
            for text, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                raw = (text or "").encode("utf-8")
                gone = merged_spans(spans)
                at, pieces = 0, []
                for a, b in gone:
                    pieces.append(raw[at:a])
                    at = b
                kept = b"".join([*pieces, raw[at:]])
                rows.append((len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True))], [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    spans = repeated_spans(docs, min_bytes, keep, id_col, text_col, group_limit)
    kind = docs.schema[id_col].dataType.simpleString()
    return spans.mapInArrow(cut, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
