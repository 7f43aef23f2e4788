"""Toxicity scores from subword bags under a linear softmax.

A word is the bag of itself and its character n-grams, hashed to buckets; a text is
the average of its words' bucket vectors; a linear softmax on the average gives the
score.  Bucket vectors and softmax are trained together in numpy (full-batch Adam on
the cross-entropy), so a misspelling that training never saw is still near the words
with which it shares n-grams.

Training takes at most ``sample_rows`` labelled rows, up to half of them of either label,
chosen by a hash of their ids, whose texts together have at most ``sample_bytes`` bytes
(documented bounds); it runs on the driver, which keeps counts of the texts only.  Both
labels weigh the same in all, so a score of 0.5 means that a text is as typical of one
as of the other.  Scoring folds vectors and softmax into one number per bucket, a table
of fixed size that goes to the executors, and reads every text whole.

Defined results: a null text is empty, and a text without words gets the score of the
intercept.  A label row counts once per id (toxic if any of them is); rows with null
ids or labels, and labels without documents, are not learnt from.  A text that does not
fit in what is left of ``sample_bytes`` is passed over, and later ones are still
learnt from.  With nothing to learn from the score is 0.5 everywhere and no document
is called toxic; with one kind of label it tends to that kind.  Only the text is an
input of the score.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from string import punctuation

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import mix64, row_slices, unused, words_of

#: Labelled rows learnt from, half of them of either label.
SAMPLE_ROWS = 8_000
SAMPLE_BYTES = 64_000_000
BUCKETS = 1 << 18
DIM = 4
GRAMS = (3, 6)
STEPS = 60
RATE = 0.4
DECAY = 0.003
#: Zero vectors that every text's average takes in besides its own, so that a few chance
#: n-grams of a short text weigh little.
NEUTRAL = 1_000
#: Largest absolute value of a bucket vector's numbers before training.
SPREAD = 0.025
#: Gradients well below this hardly move a bucket: those of few texts are not learnt by heart.
EPSILON = 1e-4
FOLDS = 5
#: Words whose n-grams are hashed and summed at once in training.
CHUNK = 20_000
#: Words whose sums a worker remembers before it starts afresh.
CACHE_ENTRIES = 200_000


def _tokens(text: str) -> list[str]:
    return words_of(text.lower())


def buckets_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words, end to end, and how many each has: the word without
    punctuation at its ends, in brackets, and the n-grams of that."""
    marked = [f"<{w.strip(punctuation) or w}>" for w in words]
    whole = np.array([zlib.crc32(m.encode("utf-8")) for m in marked], dtype=np.int64) % BUCKETS
    chars = np.frombuffer("".join(marked).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    sizes = np.array(list(map(len, marked)), dtype=np.int64)
    n_of = np.ones(len(words), dtype=np.int64)
    for n in range(GRAMS[0], GRAMS[1] + 1):
        n_of += np.maximum(sizes - n + 1, 0)
    place = np.cumsum(n_of) - n_of  # where the next bucket of each word goes
    out = np.empty(int(n_of.sum()), dtype=np.int32)
    out[place] = whole
    place += 1
    begins = np.cumsum(sizes) - sizes
    h = np.zeros(len(chars), dtype=np.uint64)
    for n in range(1, GRAMS[1] + 1):
        if len(chars) < n:
            break
        h = h[: len(chars) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + chars[n - 1 :] + np.uint64(1)
        if n >= GRAMS[0]:
            own = np.maximum(sizes - n + 1, 0)
            within = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
            out[np.repeat(place, own) + within] = mix64(h[np.repeat(begins, own) + within]) % np.uint64(BUCKETS)
            place += own
    return out, n_of


@dataclass
class Model:
    """``weight`` of each bucket and the ``bias``: the log-odds of a text is the mean
    weight of its buckets and of :data:`NEUTRAL` zeros, plus the bias."""

    weight: np.ndarray
    bias: float
    trained: bool = True

    def scores(self, texts: list[str], cache: tuple[dict[str, float], dict[str, int]]) -> np.ndarray:
        out = np.empty(len(texts))
        sums, counts = cache
        split = [_tokens(t) for t in texts]
        every = set().union(*split)
        if len(sums) > CACHE_ENTRIES:
            sums.clear()
            counts.clear()
        new = [w for w in every if w not in sums]
        if new:
            bucket, n = buckets_of(new)
            weights = np.add.reduceat(self.weight[bucket], np.cumsum(n) - n)
            sums.update(zip(new, weights.tolist(), strict=True))
            counts.update(zip(new, n.tolist(), strict=True))
        for i, words in enumerate(split):
            z = self.bias
            if words:
                z += sum(map(sums.__getitem__, words)) / (sum(map(counts.__getitem__, words)) + NEUTRAL)
            out[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
        return out


class _Bags:
    """The sample as counts: texts hold words, words hold buckets."""

    def __init__(self, texts: Iterable[str]):
        index: dict[str, int] = {}
        word, times, sizes = array("i"), array("f"), []
        for text in texts:
            bag = Counter(_tokens(text))
            sizes.append(len(bag))
            word.extend(index.setdefault(w, len(index)) for w in bag)
            times.extend(bag.values())
        self.n_texts = len(sizes)
        self.word = np.frombuffer(word, dtype=np.int32) if word else np.zeros(0, dtype=np.int32)
        self.text = np.repeat(np.arange(self.n_texts, dtype=np.int32), sizes)
        vocabulary = list(index)
        del index
        self.chunks = []
        grams = [np.zeros(0, dtype=np.int64)]
        for at in range(0, len(vocabulary), CHUNK):
            found, n = buckets_of(vocabulary[at : at + CHUNK])
            self.chunks.append((at, found, n, np.cumsum(n) - n))
            grams.append(n)
        self.grams = np.concatenate(grams)
        held = np.frombuffer(times, dtype=np.float32) if times else np.zeros(0, dtype=np.float32)
        self.share = (held / self._total(held * self.grams[self.word])[self.text]).astype(np.float32)

    def _total(self, grams: np.ndarray) -> np.ndarray:
        return np.bincount(self.text, grams, self.n_texts) + NEUTRAL

    def means(self, v: np.ndarray) -> np.ndarray:
        """For each text the average of ``v`` over its buckets."""
        of_word = np.empty(len(self.grams), dtype=np.float32)
        for at, bucket, n, starts in self.chunks:
            of_word[at : at + len(n)] = np.add.reduceat(v[bucket], starts)
        return np.bincount(self.text, of_word[self.word] * self.share, self.n_texts)

    def back(self, d: np.ndarray) -> np.ndarray:
        """The transpose of :meth:`means`: a number for each text to one for each bucket."""
        of_word = np.bincount(self.word, d[self.text] * self.share, len(self.grams)).astype(np.float32)
        out = np.zeros(BUCKETS)
        for at, bucket, n, _ in self.chunks:
            out += np.bincount(bucket, np.repeat(of_word[at : at + len(n)], n), BUCKETS)
        return out.astype(np.float32)


def fit(texts: Iterable[str], labels: list[int], steps: int = STEPS, rate: float = RATE, decay: float = DECAY, seed: int = 1) -> Model:
    """Trains embeddings and softmax jointly; both labels weigh the same in all.  Texts
    become counts as they come, and ``labels`` is read after the last of them.

    With A the texts' averaging of buckets, E the embeddings and W the softmax, the
    softmax of two classes needs A (E W) and its gradients A' dz only, so the large
    products are taken once a step and not once for each dimension.
    """
    bags = _Bags(texts)
    if not bags.n_texts:
        return Model(np.zeros(BUCKETS), 0.0, trained=False)
    y = np.array(labels, dtype=np.float32)
    kinds = [max(1.0, float((y == k).sum())) for k in (0, 1)]
    weigh = np.where(y > 0, 1 / kinds[1], 1 / kinds[0])
    weigh /= weigh.sum()
    rng = np.random.default_rng(seed)
    e = rng.uniform(-SPREAD, SPREAD, (BUCKETS, DIM)).astype(np.float32)
    w = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    c = np.zeros(2, dtype=np.float32)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (e, w, c)]
    for step in range(1, steps + 1):
        side = w[:, 1] - w[:, 0]
        z = bags.means(e @ side) + (c[1] - c[0])
        dz = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weigh).astype(np.float32)
        back = bags.back(dz)
        dw = e.T @ back
        grads = [back[:, None] * side[None, :], np.stack([-dw, dw], axis=1), np.array([-dz.sum(), dz.sum()], dtype=np.float32)]
        e *= 1 - rate * decay
        for param, grad, (m, v) in zip((e, w, c), grads, state, strict=True):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            param -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + EPSILON)
    return Model((e @ (w[:, 1] - w[:, 0])).astype(np.float64), float(c[1] - c[0]))


def held_out(id_col: str = "doc_id"):
    """Ids whose CRC-32, as decimal text, is divisible by the number of folds."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fits a model to ``labels`` (doc_id, toxic) of the folds that are not held out."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    marked = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    first = lambda kind, n: marked.where(kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    picked = first(F.col("toxic") > 0, sample_rows // 2).unionByName(first(F.col("toxic") <= 0, sample_rows - sample_rows // 2))
    fits = F.coalesce(F.octet_length("text"), F.lit(0)) <= sample_bytes  # others never reach the driver
    rows = docs.select("doc_id", "text").where(fits).join(F.broadcast(picked), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").select("text", "toxic")
    marks: list[int] = []

    def texts() -> Iterator[str]:
        size = 0
        for r in rows.toLocalIterator():
            own = len((r.text or "").encode("utf-8"))
            if size + own > sample_bytes:
                continue
            if len(marks) == sample_rows:
                break
            size += own
            marks.append(int(r.toxic > 0))
            yield r.text or ""

    return fit(texts(), marks)


_caches: dict[int, tuple[dict[str, float], dict[str, int]]] = {}


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "_score") -> DataFrame:
    """The columns of ``docs`` and ``score_col``, a name that they must not have."""
    others = [c for c in docs.columns if c != text_col]
    name = zlib.crc32(model.weight.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _caches:
            _caches.clear()
        cache = _caches.setdefault(name, ({}, {}))
        for part in row_slices(batches):
            found = model.scores([t or "" for t in part.column(0).to_pylist()], cache)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found)], [text_col, *others, score_col])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in [text_col, *others])
    return docs.select(*(F.col(f"`{c}`") for c in [text_col, *others])).mapInArrow(run, f"{schema}, `{score_col}` double").select(*(F.col(f"`{c}`") for c in [*docs.columns, score_col]))


def is_toxic(model: Model, score_col: str = "_score"):
    """Whether the model calls a scored row toxic; one that learnt nothing calls none so."""
    return F.col(score_col) >= 0.5 if model.trained else F.lit(False)


def not_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the model does not call toxic."""
    model = train(docs, labels)
    name = unused(docs, "_score")
    return score(docs, model, score_col=name).where(~is_toxic(model, name)).drop(name) if model.trained else docs
