"""Token counts by rank-synchronous merging of arrays.

A batch's distinct pre-tokens lie end to end in one array of symbols.  In each
round every pre-token looks up the ranks of its neighbouring pairs, finds its
own lowest, and merges all occurrences of that pair; all pre-tokens do so at
once.  A pre-token leaves the arrays when none of its pairs has a rank; what is
left of it are its tokens.  A very long pre-token has arrays of its own, in which a
round finds the lowest pair's places without going through the rest.

Defined results: a null text counts as the empty text (0 bytes, 0 tokens).
Special strings of the vocabulary inside a text count one token each, as the
library does by default.  Repeated rows are counted each; columns that are not
named are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemark.llm.shared import row_slices

#: Pre-tokens whose counts a worker remembers before it starts afresh.
CACHE_ENTRIES = 250_000
#: Bytes of new pre-tokens merged at once.
MERGE_BYTES = 1 << 20
#: Pre-tokens of more characters are merged by themselves.
LONG_PIECE = 2_000
#: Below U+0250, but for three digits and three fractions that are no decimals and
#: four separators, re's classes are those of the pattern, and re is the faster one.
_NOT_PLAIN = re.compile("[^\\x00-\\x1b\\x20-\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-\\u024f]")
_plain_pieces = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall
_NO_RANK = np.int64(1 << 40)


def _byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable
    Latin-1 characters stand for themselves, the rest follow from code point 256."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def _split_pattern(pre_tokenizer) -> str:
    """The byte-level splitting pattern with letters and numbers as the library knows
    them.  Code points newer than Python's own tables are asked of the library."""
    newer = {"L": [], "N": []}
    for kind in newer:
        known = regex.compile(rf"\p{{{kind}}}")
        probe = "a" if kind == "L" else "1"
        for cp in range(0x80, 0x110000):
            c = chr(cp)
            if unicodedata.category(c) == "Cn" and known.match(c) and len(pre_tokenizer.pre_tokenize_str(probe + c)) != 1:
                newer[kind].append(cp)

    def without(kind: str) -> str:
        spans: list[list[int]] = []
        for cp in newer[kind]:
            if spans and spans[-1][1] == cp - 1:
                spans[-1][1] = cp
            else:
                spans.append([cp, cp])
        return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in spans)

    def minus(kind: str) -> str:
        return rf"[\p{{{kind}}}--[{without(kind)}]]" if newer[kind] else rf"\p{{{kind}}}"

    letter, number = minus("L"), minus("N")
    return rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?[^\s{letter}{number}]+|\s+(?!\S)|\s+"


class PairMerger:
    """Counts the tokens of texts under a byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
        right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        self.pair_rank = np.argsort((left << 20) | right, kind="stable").astype(np.int64)
        self.pair_keys = ((left << 20) | right)[self.pair_rank]
        self.byte_ids = np.array([vocab[c] for c in _byte_chars()], dtype=np.int64)
        self.byte_pairs = self.ranks(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256)).reshape(256, 256)
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pieces = regex.compile(_split_pattern(Tokenizer.from_file(path).pre_tokenizer)).findall
        self.cache: dict[str, int] = {}

    def split(self, text: str) -> list[str]:
        return self.pieces(text) if _NOT_PLAIN.search(text) else _plain_pieces(text)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs; those that cannot be merged come last."""
        keys = (left << 20) | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_rank[at], _NO_RANK)

    def merged_lengths(self, pieces: list[bytes]) -> np.ndarray:
        """How many symbols are left of each piece when no pair can be merged."""
        out = np.zeros(len(pieces), dtype=np.int64)
        lengths = np.array([len(p) for p in pieces], dtype=np.int64)
        raw = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        who = np.flatnonzero(lengths)
        lengths = lengths[who]
        sym = self.byte_ids[raw]
        rank = np.full(len(sym), _NO_RANK)  # of the pair that begins here
        rank[:-1] = self.byte_pairs[raw[:-1], raw[1:]]
        rank[np.cumsum(lengths) - 1] = _NO_RANK  # pairs do not reach into the next piece
        while len(who):
            starts = np.zeros(len(who), dtype=np.int64)
            np.cumsum(lengths[:-1], out=starts[1:])
            best = np.minimum.reduceat(rank, starts)
            going = best < _NO_RANK
            out[who[~going]] = lengths[~going]
            if not going.any():
                break
            hits = np.flatnonzero((rank == np.repeat(best, lengths)) & (rank < _NO_RANK))
            # in a run such as "aaa" the pairs overlap; every second one is merged, from the left
            fresh = np.ones(len(hits), dtype=bool)
            fresh[1:] = hits[1:] != hits[:-1] + 1
            n = np.arange(len(hits))
            hits = hits[(n - np.maximum.accumulate(np.where(fresh, n, 0))) % 2 == 0]
            sym[hits] = self.made[rank[hits]]
            keep = np.repeat(going, lengths)
            keep[hits + 1] = False
            gone = np.zeros(len(sym), dtype=np.int64)
            gone[hits + 1] = 1
            lengths = (lengths - np.add.reduceat(gone, starts))[going]
            where = (np.cumsum(keep) - 1)[hits]
            sym, rank = sym[keep], rank[keep]
            ends = np.zeros(len(sym), dtype=bool)
            ends[np.cumsum(lengths) - 1] = True
            # only pairs beside a merged symbol have changed
            near = np.zeros(len(sym), dtype=bool)
            near[where] = near[where[where > 0] - 1] = True
            rank[near & ends] = _NO_RANK
            changed = np.flatnonzero(near & ~ends)
            rank[changed] = self.ranks(sym[changed], sym[changed + 1])
            who = who[going]
        return out

    def long_length(self, piece: bytes) -> int:
        """How many symbols are left of one long piece.  Places of a pair are kept by its
        rank, so that a round, which merges all places of the lowest rank, costs no more
        than these; the arrays are linked, not packed."""
        raw = np.frombuffer(piece, dtype=np.uint8)
        n = len(raw)
        sym = np.append(self.byte_ids[raw], -1)  # the last one is no symbol
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        rank = np.append(self.byte_pairs[raw[:-1], raw[1:]], [_NO_RANK, _NO_RANK])  # of the pair that begins here
        places: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def keep(at: np.ndarray) -> None:
            at = at[rank[at] < _NO_RANK]
            at = at[np.argsort(rank[at], kind="stable")]
            cuts = np.flatnonzero(np.diff(rank[at], prepend=-1))
            for r, own in zip(rank[at[cuts]].tolist(), np.split(at, cuts[1:]), strict=False):
                if r not in places:
                    places[r] = []
                    heapq.heappush(heap, r)
                places[r].append(own)

        if n > 1:
            keep(np.arange(n - 1))
        left = n
        while heap:
            r = heapq.heappop(heap)
            hits = np.unique(np.concatenate(places.pop(r)))
            hits = hits[rank[hits] == r]
            if not len(hits):
                continue
            # in a run such as "aaa" the pairs overlap; every second one is merged, from the left
            fresh = np.ones(len(hits), dtype=bool)
            fresh[1:] = after[hits[:-1]] != hits[1:]
            k = np.arange(len(hits))
            hits = hits[(k - np.maximum.accumulate(np.where(fresh, k, 0))) % 2 == 0]
            gone = after[hits]
            sym[hits] = self.made[r]
            rank[gone] = _NO_RANK
            after[hits] = after[gone]
            before[after[gone]] = hits
            left -= len(hits)
            changed = np.unique(np.concatenate([hits, before[hits]]))
            changed = changed[changed >= 0]
            new = np.where(after[changed] < n, self.ranks(sym[changed], sym[np.minimum(after[changed], n)]), _NO_RANK)
            rank[changed] = new
            keep(changed)
        return left

    def _learn(self, new: list[str]) -> None:
        if len(self.cache) + len(new) > CACHE_ENTRIES:
            self.cache.clear()
        self.cache.update((p, self.long_length(p.encode("utf-8"))) for p in new if len(p) > LONG_PIECE)
        new = [p for p in new if len(p) <= LONG_PIECE]
        chunk, size = [], 0
        for i, piece in enumerate(new):
            chunk.append(piece)
            size += len(piece)
            if size >= MERGE_BYTES or i == len(new) - 1:
                counts = self.merged_lengths([p.encode("utf-8") for p in chunk])
                self.cache.update(zip(chunk, counts.tolist(), strict=True))
                chunk, size = [], 0

    def counts(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text."""
        split, extra = [], []
        for text in texts:
            if self.special and self.special.search(text):
                parts = self.special.split(text)
                extra.append(len(parts) - 1)
                split.append([p for part in parts for p in self.split(part)])
            else:
                extra.append(0)
                split.append(self.split(text))
        every = set().union(*split)
        new = [p for p in every if p not in self.cache]
        if new:
            self._learn(list(every) if len(self.cache) + len(new) > CACHE_ENTRIES else new)
        got = self.cache.__getitem__
        return [n + sum(map(got, pieces)) for n, pieces in zip(extra, split, strict=True)]


@lru_cache(maxsize=2)
def merger(path: str) -> PairMerger:
    return PairMerger(path)


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every row.

    ``vocabulary`` is the path of a byte-level BPE file that every executor has,
    or the name of one in the ``public_tokenizers`` package.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        import public_tokenizers

        model = merger(vocabulary if os.path.sep in vocabulary else public_tokenizers.path(vocabulary))
        for part in row_slices(batches, 128):
            texts = [t or "" for t in part.column(1).to_pylist()]
            sizes = [len(t) if t.isascii() else len(t.encode("utf-8")) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(model.counts(texts), pa.int64())], [id_col, "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long")
