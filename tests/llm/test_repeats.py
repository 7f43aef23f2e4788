"""Suffix-array and suffix-tree removal against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import substring_dedup, suffix_array_dedup
from tidemark.llm import sparse_suffix as P
from tidemark.llm.shared import words_of


def shared(a, b):
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_blocks_factors_and_nodes():
    """Suffix order, common prefixes, longest previous factors and tree nodes against
    all pairs of suffixes."""
    rng = random.Random(1)
    for t in range(120):
        length = rng.randint(1, 12)
        seqs = [bytes(rng.choice(b"ab") for _ in range(rng.randint(length, length + 25))) for _ in range(rng.randint(1, 9))]
        seqs += [seqs[0]] * 2 * (t % 3 == 0)
        arrays = [np.frombuffer(s, dtype=np.uint8) if t % 2 else np.frombuffer(s, dtype=np.uint8).astype(np.uint64) * 7 for s in seqs]
        block = P.Block(arrays, length)
        suffixes = [s[i:] for s in seqs for i in range(len(s) - length + 1)]
        assert sorted(block.order.tolist()) == list(range(len(suffixes)))
        for r in range(1, len(suffixes)):
            a, b = suffixes[block.order[r - 1]], suffixes[block.order[r]]
            assert a[:length] <= b[:length]
            assert block.common[r] == shared(a, b) or length <= block.common[r] <= shared(a, b)
        factors = suffix_array_dedup.longest_factors(block.order, block.common, length)
        for i, s in enumerate(suffixes):
            longest = max((shared(s, suffixes[j]) for j in range(i)), default=0)
            assert (factors[i] > 0) == (longest >= length) and factors[i] <= longest
        first, last, depth = substring_dedup.deep_nodes(block.common, length)
        nodes = defaultdict(list)
        for i, s in enumerate(suffixes):
            nodes[s[:length]].append(i)
        assert sorted(sorted(block.order[x:y].tolist()) for x, y in zip(first, last)) == sorted(v for v in nodes.values() if len(v) > 1)
        assert all(d >= length and len({suffixes[i][:d] for i in block.order[x:y]}) == 1 for x, y, d in zip(first, last, depth))


def test_word_ids():
    texts = ["a b  c", None, "", "  x", "y ", "word " * 300 + "z" * 2000, " \t\n\x0b\x0c\rq\x1cé ü k", "end"]
    for own in (texts, ["x"], [""], [None], ["", "a"], ["a", "", "b"], []):
        ids, sizes = substring_dedup.word_ids(pa.array(own, pa.string()))
        words = [w for t in own for w in words_of(t or "")]
        assert sizes.tolist() == [len(words_of(t or "")) for t in own]
        assert len(set(zip(words, ids.tolist()))) == len(set(words)) == len(set(ids.tolist()))


def test_pieces_of_long_texts(monkeypatch):
    """Anchors do not depend on where a long text is cut, and windows at a cut are kept."""
    rng = random.Random(3)
    text = np.array([rng.randrange(3) for _ in range(3000)], dtype=np.uint8)
    shape = P.Shape(20, 10, 1)
    windows = lambda found: {(k, f + j, o - j) for _, k, _, f, n, o in zip(*(x.tolist() for x in found)) for j in range(n)}
    whole = windows(P.anchors(text, np.array([3000]), shape))
    assert len(whole) == 2981
    for piece in (64, 500, 2980, 2981):
        monkeypatch.setattr(P, "PIECE", piece)
        P.powers.cache_clear()
        assert windows(P.anchors(text, np.array([3000]), shape)) == whole
    P.powers.cache_clear()


def brute_bytes(rows, length, keep):
    seen, count = set(), Counter()
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    raws = [(t or "").encode() for _, t in rows]
    for raw in raws:
        count.update(raw[i : i + length] for i in range(len(raw) - length + 1))
    out = {}
    for (rid, _), raw in zip(rows, raws):
        gone = [False] * len(raw)
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if (w in seen) if keep == "first" else count[w] > 1:
                gone[i : i + length] = [True] * length
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[rid] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def brute_words(rows, window):
    least = {}
    for rid, t in rows:
        w = words_of(t or "")
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            least[k] = min(least.get(k, rid), rid)
    out = defaultdict(list)
    for rid, t in rows:
        w = words_of(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < rid:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[rid].append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return {k: sorted(v) for k, v in out.items()}


def corpus(seed, sep):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5)))
    shared = [sep.join(word() for _ in range(rng.randint(8, 40))) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [sep.join(word() for _ in range(rng.randint(0, 15)))]
        for _ in range(rng.randint(0, 3)):
            parts.append(rng.choice(shared))
            parts.append(sep.join(word() for _ in range(rng.randint(0, 6))))
        rows.append((i, sep.join(parts)))
    base = sep.join(word() for _ in range(60))
    for i in range(60, 80):  # copies, and near copies
        w = base.split(sep)
        if i % 2:
            w[rng.randrange(len(w))] = word()
        rows.append((i, sep.join(w)))
    rows += [(80, None), (81, ""), (82, "a" * 200), (83, "a" * 90), (84, "ab" * 100), (85, " ".join(["x"] * 120)), (86, " ".join(["x"] * 70))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("keep, group_limit", [("none", 3), ("first", 3), ("none", 10_000)])
def test_suffix_array(spark, keep, group_limit):
    rows = corpus(1, " ")
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, key string, n int").repartition(5)
    got = suffix_array_dedup.remove_repeats(docs, 40, keep, group_limit=group_limit).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_bytes(rows, 40, keep)
    assert len(got) == len(rows)


@pytest.mark.parametrize("group_limit", [3, 10_000])
def test_suffix_tree(spark, group_limit):
    rows = corpus(2, " ")
    rows += [(7, rows[0][1] + " and more words here"), (90, rows[5][1])]  # a repeated id
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, row int").repartition(5)
    got = defaultdict(list)
    for r in substring_dedup.remove_repeats(docs, 12, group_limit=group_limit).collect():
        got[r.doc_id].append((r.n_words, r.n_removed, r.kept_sha256))
    assert {k: sorted(v) for k, v in got.items()} == brute_words(rows, 12)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(120))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text + " tail")], "doc_id long, text string")
    got = suffix_array_dedup.remove_repeats(docs).collect()
    assert sorted(r.n_removed for r in got) == [len(text)] * 3
    first = suffix_array_dedup.remove_repeats(docs.where("doc_id = 1"), keep="first").collect()
    assert [r.n_removed for r in first] == [0, 0]
    tree = substring_dedup.remove_repeats(docs).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in tree) == [(0, 0), (1, 120), (1, 120)]
    assert suffix_array_dedup.remove_repeats(docs.limit(0)).count() == 0
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0
