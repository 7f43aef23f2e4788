"""Token counts, toxicity, fingerprints, line dedup, decontamination and mixing."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontamination, fingerprints, line_dedup, mixing, queries, token_counts, toxicity
from tidemark.llm.shared import SPACE_CHARS, words_of

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "\n", "\n\n", "a", "\x1c", "é" * 30, "x" * 5000, "<|endoftext|>a<|endoftext|>", "Ünï 🙂 code\u00a0space", "a b c d e f g"]


def odd_docs(spark):
    rows = [(i, t, "en", None, None) for i, t in enumerate(ODD)] + [(3, ODD[3], "en", "s", 1), (None, "null id", None, None, None)]
    return spark.createDataFrame(rows, DOCS).withColumn("text2", F.lit(1)).withColumn("size", F.lit("clash")).withColumn("keys", F.lit(0))


def test_words():
    assert words_of("a\x1cb c\x0bd\u00a0e\x85f") == ["a\x1cb", "c", "d\u00a0e\x85f"]
    assert words_of("") == words_of(SPACE_CHARS) == []


def test_token_counts(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(1)
    texts = [t for t in ODD if t] + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0xD7FF), 32, 10, 39, rng.randrange(0x10000, 0x2FFFF)])) for _ in range(rng.randrange(80))) for _ in range(400)]
    model = token_counts.PairMerger(public_tokenizers.path("byte_bpe_50k.json"))
    want = [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert model.counts(texts) == want
    token_counts.CACHE_ENTRIES, kept = 50, token_counts.CACHE_ENTRIES
    try:
        assert [n for t in texts for n in model.counts([t])] == want
    finally:
        token_counts.CACHE_ENTRIES = kept
    got = token_counts.count_tokens(odd_docs(spark), "byte_bpe_50k.json").collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got) == sorted((i or 0, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in [*enumerate(ODD), (3, ODD[3]), (None, "null id")])
    assert token_counts.count_tokens(odd_docs(spark).limit(0), "byte_bpe_50k.json").count() == 0


def test_merges_lowest_rank_first():
    model = token_counts.PairMerger(public_tokenizers.path("byte_bpe_50k.json"))

    def slow(piece):
        sym = [int(model.byte_ids[b]) for b in piece]
        while len(sym) > 1:
            ranks = model.ranks(np.array(sym[:-1]), np.array(sym[1:])).tolist()
            low = min(ranks)
            if low >= token_counts._NO_RANK:
                break
            at = ranks.index(low)
            sym[at : at + 2] = [int(model.made[low])]
        return len(sym)

    rng = random.Random(2)
    pieces = [bytes(rng.choice(b"aeinrst th") for _ in range(rng.randrange(1, 25))) for _ in range(300)] + [b"a" * n for n in range(1, 20)]
    assert model.merged_lengths(pieces).tolist() == [slow(p) for p in pieces]


def test_long_pre_tokens():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, model = Tokenizer.from_file(path), token_counts.PairMerger(path)
    rng = random.Random(6)
    for n, letters in ((1, "a"), (2, "ab"), (700, "aab"), (2_500, "abcdefghijklmnopqrstuvwxyz"), (5_000, "a"), (60_000, "théing"), (1_000_000, "etaoinshrdlu")):
        text = "".join(rng.choice(letters) for _ in range(n))
        want = len(lib.encode(text, add_special_tokens=False).ids)
        assert model.counts([text]) == [want]
        if n < 5_000:
            assert model.long_length(text.encode()) == want == model.merged_lengths([text.encode()])[0]


def test_toxicity(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    rows, labels = [], []
    for i in range(600):
        bad = rng.random() < 0.3
        words = [word() for _ in range(rng.randint(20, 60))]
        for _ in range(3 * bad):
            words[rng.randrange(len(words))] = rng.choice(["horriblex", "disgustix"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1), (5, None), (10_000, 1), (7, labels[7][1])], "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sorted(r.doc_id for r in docs.where(toxicity.held_out()).collect()) == held
    scores = model.scores([rows[i][1] for i in held], ({}, {}))
    right = np.mean([(s >= 0.5) == bool(labels[i][1]) for i, s in zip(held, scores)])
    assert right >= 0.9
    near = model.scores(["abc def horriblexx gah", "abc def horrible gah", "abc def gah beg"], ({}, {}))
    assert min(near[:2]) > near[2]  # unseen spellings share n-grams
    got = toxicity.score(odd_docs(spark), model)
    assert got.columns[:-1] == odd_docs(spark).columns
    assert all(0 <= r._score <= 1 for r in got.collect()) and got.count() == len(ODD) + 2
    assert toxicity.score(docs.limit(0), model).count() == 0
    none = toxicity.train(docs, marks.limit(0))
    assert set(none.scores(["a", ""], ({}, {}))) == {0.5}


def slow_fit(texts, labels, steps, rate, decay, seed=1):
    """The same model with one vector per text, dense matrices and the plain chain rule."""
    T = toxicity
    A = np.zeros((len(texts), T.BUCKETS))
    for i, text in enumerate(texts):
        words = T._tokens(text)
        found = T.buckets_of(words)[0] if words else np.zeros(0, dtype=np.int64)
        np.add.at(A[i], found, 1 / (len(found) + T.NEUTRAL))
    y = np.array(labels)
    onehot = np.stack([1 - y, y], axis=1)
    weigh = np.where(y > 0, 1 / max(1, (y > 0).sum()), 1 / max(1, (y == 0).sum()))
    weigh = weigh / weigh.sum()
    rng = np.random.default_rng(seed)
    E, W, c = rng.uniform(-T.SPREAD, T.SPREAD, (T.BUCKETS, T.DIM)), rng.normal(0, 0.5, (T.DIM, 2)), np.zeros(2)
    moments = [[0, 0], [0, 0], [0, 0]]
    for t in range(1, steps + 1):
        H = A @ E
        P = np.exp(H @ W + c)
        P /= P.sum(axis=1, keepdims=True)
        D = (P - onehot) * weigh[:, None]
        grads = [A.T @ (D @ W.T), H.T @ D, D.sum(axis=0)]
        E = E * (1 - rate * decay)
        new = []
        for p, g, m in zip([E, W, c], grads, moments):
            m[0], m[1] = 0.9 * m[0] + 0.1 * g, 0.99 * m[1] + 0.01 * g * g
            new.append(p - rate * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.99**t)) + T.EPSILON))
        E, W, c = new
    z = A @ E @ W + c
    return 1 / (1 + np.exp(z[:, 0] - z[:, 1]))


def test_toxicity_is_the_plain_model(monkeypatch):
    monkeypatch.setattr(toxicity, "BUCKETS", 512)
    monkeypatch.setattr(toxicity, "CHUNK", 7)
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("abcé") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 30))) for _ in range(60)] + ["", "...", "a b"]
    labels = [int("ab" in t and i % 3 > 0) for i, t in enumerate(texts)]
    model = toxicity.fit(iter(texts), labels, steps=12)
    assert np.abs(model.scores(texts, ({}, {})) - slow_fit(texts, labels, 12, toxicity.RATE, toxicity.DECAY)).max() < 2e-3
    assert np.array_equal(model.weight, toxicity.fit(texts, labels, steps=12).weight)


def test_buckets_of_words(monkeypatch):
    words = ["ab", "...", "été", "a", "longerword", "(word)"]
    found, n = toxicity.buckets_of(words)
    ends = np.cumsum(n).tolist()
    for w, b, e in zip(words, [0, *ends], ends):
        alone, size = toxicity.buckets_of([w])
        assert found[b:e].tolist() == alone.tolist() and size[0] == e - b
        marked = "<" + (w.strip("().") or w) + ">"
        assert e - b == 1 + sum(max(len(marked) - k + 1, 0) for k in range(toxicity.GRAMS[0], toxicity.GRAMS[1] + 1))
    assert set(toxicity.buckets_of(["word"])[0]) == set(toxicity.buckets_of(["(word)"])[0])


def test_toxicity_sample_has_both_labels(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(400)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 20 == 0)) for i in range(400)], "doc_id long, toxic int")
    seen = {}
    toxicity.fit, kept = lambda texts, labels: seen.update(texts=list(texts), labels=labels), toxicity.fit
    try:
        toxicity.train(docs, marks, sample_rows=30)
    finally:
        toxicity.fit = kept
    learnable = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    assert sum(seen["labels"]) == min(15, sum(i % 20 == 0 for i in learnable)) and len(seen["labels"]) == sum(seen["labels"]) + 15
    assert {int(t.split()[1]) for t in seen["texts"]} <= set(learnable)


def test_toxicity_without_sample(spark):
    """Nothing to learn from calls nothing toxic; an oversized text costs no other."""
    rows = [(i, "good calm word" if i % 3 else "bad vile word") for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)], "doc_id long, toxic int")
    assert toxicity.not_toxic(docs, marks.limit(0)).count() == 240
    order = [r.doc_id for r in docs.where(~toxicity.held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    for width in (900, 2000):  # a text that takes too much of the bound, and one of more than the bound
        big = docs.withColumn("text", F.when(F.col("doc_id").isin(order[0], order[1]), F.repeat(F.lit("x"), width)).otherwise(F.col("text")))
        model = toxicity.train(big, marks, sample_bytes=1_500)
        assert model.trained and model.scores([rows[1][1], rows[0][1]], ({}, {})).round().tolist() == [0, 1]


def test_fingerprints(spark):
    text = " ".join(f"word{i * 7919 % 1000}" for i in range(600))
    fp = fingerprints.fingerprint(text)
    size, one, two = fp.split(":")
    assert len(one) >= fingerprints.MIN_CHUNKS and len(two) < len(one)
    changed = text[:2000] + "CHANGED" + text[2000:]
    other = " ".join(f"other{i * 31 % 997}" for i in range(600))
    assert fingerprints.likeness(fp, fp) == 1 and fingerprints.likeness(fp, fingerprints.fingerprint(changed)) > 0.8
    assert fingerprints.likeness(fp, fingerprints.fingerprint(other)) == 0
    a, b = "ABCBDAB", "BDCABA"
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert fingerprints._common(a, b) == table[-1][-1]
    rows = [(i, t) for i, t in enumerate([*ODD, text, changed, other])] + [(3, "tie"), (None, "first of all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {(r.doc_id, r.fingerprint, r.n_chars, r.edited_sha256) for r in fingerprints.with_next(docs).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want = set()
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, after = t or "", after or ""
        half = len(t) // 2
        want.add((i, fingerprints.fingerprint(t), len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
    assert got == want
    single = fingerprints.with_next(docs.where("doc_id = 5")).collect()
    assert len(single) == 1 and single[0].near_next == 1
    assert fingerprints.with_next(docs.limit(0)).count() == 0


def slow_fingerprint(text):
    """The same signatures byte by byte."""
    fp, raw, mask = fingerprints, text.encode("utf-8"), (1 << 64) - 1
    mix = lambda x: int(fp.mix64(np.array([x], dtype=np.uint64))[0])
    value = [mix((b + 1) * 0xD1B54A32D192ED03 & mask) & 0xFFFFFFFF for b in range(256)]
    strengths = {}
    for i in range(len(raw)):
        h = sum(value[raw[i - k]] * pow(0x01000193, k, 1 << 32) for k in range(7) if i - k >= 0) & 0xFFFFFFFF
        h ^= h >> 15
        h = h * 0x2C1B3C6D & 0xFFFFFFFF
        h ^= h >> 12
        if h % fp.SMALLEST == fp.SMALLEST - 1:
            q, k = h // fp.SMALLEST, 0
            while q >> k & 1 and k < 30:
                k += 1
            strengths[i + 1] = k
    many = lambda k: sum(x >= k for x in strengths.values())
    k = 0
    while many(k + 1) >= fp.MIN_CHUNKS:
        k += 1
    k += many(k) > fp.MAX_CHUNKS

    def signature(k):
        ends = sorted(e for e, x in strengths.items() if x >= k)
        ends += [len(raw)] if raw and (not ends or ends[-1] != len(raw)) else []
        out, at = "", 0
        for e in ends if raw else []:
            h = sum((b + 1) * pow(fp._BASE, i, 1 << 64) for i, b in enumerate(raw[at:e])) + e - at & mask
            out += chr(fp._ALPHABET[mix(h) >> 58])
            at = e
        return out

    return f"{fp.SMALLEST << k}:{signature(k)}:{signature(k + 1)}"


def slow_likeness(a, b):
    def common(x, y):
        table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, p in enumerate(x):
            for j, q in enumerate(y):
                table[i + 1][j + 1] = table[i][j] + 1 if p == q else max(table[i][j + 1], table[i + 1][j])
        return table[-1][-1]

    if a == b:
        return 1.0
    (n, *x), (m, *y) = ((int(p[0]), *p[1:]) for p in (a.split(":"), b.split(":")))
    best = 0.0
    for i in (0, 1):
        for j in (0, 1):
            p, q = x[i], y[j]
            if n << i == m << j and any(p[k : k + 4] in q for k in range(len(p) - 3)):
                best = max(best, 2 * common(p, q) / (len(p) + len(q)))
    return best


def test_fingerprints_against_brute_force(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghéß🙂") for _ in range(rng.randint(1, 8)))
    texts = [" ".join(word() for _ in range(n)) for n in (0, 1, 3, 40, 400, 900)] + ["c" * 3000, "ab" * 900, "a phrase again. " * 150]
    texts += [texts[4][:900] + "CHANGED" + texts[4][900:], texts[5] + texts[4]]
    assert [fingerprints.fingerprint(t) for t in texts] == [slow_fingerprint(t) for t in texts]
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in fingerprints.with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for i, t in rows:
        after = texts[(i + 1) % len(texts)]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        a, e, n = slow_fingerprint(t), slow_fingerprint(edited), slow_fingerprint(after)
        r = got[i]
        assert (r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) == (a, e, slow_likeness(a, e), slow_likeness(a, n))


def test_signatures_are_bounded():
    import time

    began = time.time()
    for text in ("c" * 5_000_000, "ab" * 50_000, "the same phrase once more; " * 180_000, "x\n" * 400_000):
        one, two = fingerprints.fingerprint(text), fingerprints.fingerprint(text + "tail")
        assert all(len(x) <= fingerprints.MAX_CHUNKS + 1 for fp in (one, two) for x in fp.split(":")[1:])
        assert fingerprints.likeness(one, one) == 1 and 0 <= fingerprints.likeness(one, two) <= 1
    assert time.time() - began < 30


def brute_lines(rows):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(SPACE_CHARS))
    holders = {}
    for n, (i, t) in enumerate(rows):
        for k in {key(x) for x in (t or "").split("\n")}:
            holders.setdefault(k, []).append(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and i != max((h for h in holders[key(x)] if h is not None), default=None))]
        out.append((i or 0, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("batches, fanout", [(1, 4), (5, 2)])
def test_line_dedup(spark, batches, fanout):
    rng = random.Random(4)
    lines = [f"{'Shared' if i % 2 else 'shared'} line number {i} é" for i in range(8)] + ["short", "", " " * 30, "exactly twenty chars", "nineteen characters"]
    rows = [(i, "\n".join(rng.choice([x, f"  {x}\t", x.upper() if "é" not in x else x]) for x in rng.choices(lines, k=rng.randint(0, 6)))) for i in range(40)] + [(40, None), (3, lines[0]), (None, lines[0]), (41, "\r\n".join(lines))]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, keys string")
    got = line_dedup.drop_shared_lines(docs, batches=batches, fanout=fanout)
    assert got.columns == ["doc_id", "text", "keys", "line_dedup"]
    found = got.collect()
    assert sorted((r.doc_id or 0, r.line_dedup.n_lines, r.line_dedup.n_dropped, r.line_dedup.kept_sha256) for r in found) == brute_lines(rows)
    assert all(hashlib.sha256((r.text or "").encode()).hexdigest() == r.line_dedup.kept_sha256 for r in found)
    assert line_dedup.drop_shared_lines(docs.limit(0)).count() == 0


def test_line_runs(spark):
    """Keys are in one run at most; what is seen again is counted as an update."""
    runs = line_dedup.LineRuns(fanout=2)
    batch = lambda *k: spark.createDataFrame([(i, x.encode()) for i, x in enumerate(k)], "id long, key binary")
    keys = lambda df: sorted(bytes(r.key).decode() for r in df.collect())
    for own, new in ((("a", "b"), ["a", "b"]), (("b", "c", "b"), ["c"]), (("d", "a"), ["d"]), (("a", "c", "e"), ["e"])):
        assert keys(runs.unseen(batch(*own)).where("seen is null").select("key").distinct()) == new
        runs.add(batch(*own))
        held = [k for run in runs.runs() for k in keys(run)]
        assert len(held) == len(set(held))
    assert [len(level) for level in runs.levels] == [0, 0, 1] and [len(level) for level in runs.updates] == [1, 1]
    assert {bytes(r.key).decode(): (r.n, r.last) for r in runs.totals().collect()} == {"a": (3, 1), "b": (3, 2), "c": (2, 1), "d": (1, 0), "e": (1, 2)}


def test_line_dedup_goes_through_the_runs(spark, monkeypatch):
    asked, unseen = [], line_dedup.LineRuns.unseen
    monkeypatch.setattr(line_dedup.LineRuns, "unseen", lambda self, lines: asked.append(len(self.runs())) or unseen(self, lines))
    docs = spark.createDataFrame([(i, f"the very same line of text\nline of its own, number {i}") for i in range(30)], "doc_id long, text string")
    got = line_dedup.drop_shared_lines(docs).collect()
    assert sum(r.line_dedup.n_dropped for r in got) == 29 and len(asked) == line_dedup.BATCHES and max(asked) >= 2


def test_decontamination(spark):
    import re

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 5)))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([30, 12, 40, 6, 5, 3, 1, 20])] + [(8, None), (9, "..."), (0, "repeated id, other words here now")]
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(30)]
    for i in range(30, 60):
        w = items[rng.randrange(8)][1].split()
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = word()
        docs.append((i, " ".join([word() for _ in range(20)] + [x.upper() + "," for x in w] + [word() for _ in range(20)])))
    docs += [(60, None), (61, ""), (30, docs[30][1]), (None, docs[31][1])]
    norm = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    sh = lambda w, n: {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}
    want = set()
    for d, t in docs:
        for i, x in items:
            w = norm(x)
            s = sh(w, min(5, len(w))) if w else set()
            n = len(s & sh(norm(t), min(5, len(w)))) if s else 0
            if s and n / len(s) >= 0.8:
                want.add((d, i, n, len(s)))
    ddf = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, row int")
    idf = spark.createDataFrame(items, "item_id long, text string")
    for limit in (0, 1000):
        got = [(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in decontamination.contaminated(ddf, idf, broadcast_rows=limit).collect()]
        assert set(got) == want and len(got) == len(want) and len(want) > 10
    # every size partition finds its own items, with its own cut
    for low, high in ((0, 2), (2, 8), (8, 40)):
        some = [(i, x) for i, x in items if low <= len(norm(x)) < high]
        if some:
            part = decontamination.contaminated(ddf, spark.createDataFrame(some, "item_id long, text string")).collect()
            assert {(r.doc_id, r.item_id) for r in part} == {(d, i) for d, i, _, q in want if any(i == j and q == len(sh(norm(x), min(5, len(norm(x))))) for j, x in some)}
    left = decontamination.without_leaks(ddf, idf)
    assert left.columns == ddf.columns
    bad = {d for d, *_ in want}
    assert Counter(r.doc_id for r in left.collect()) == Counter(d for d, _ in docs if d not in bad)
    assert decontamination.contaminated(ddf, idf.limit(0)).count() == 0 and decontamination.contaminated(ddf.limit(0), idf).count() == 0


def lague(weights, seats):
    got = [0] * len(weights)
    for _ in range(seats):
        best = max(range(len(weights)), key=lambda i: (weights[i] / (2 * got[i] + 1), -i))
        got[best] += 1
    return got


def test_apportionment(spark):
    rng = random.Random(6)
    for seats in (0, 1, 7, 100, 1234):
        weights = [float(rng.choice([1, 2, 5, 50, 1000, 0.3])) for _ in range(9)]
        df = spark.createDataFrame([(i, w, seats, 1) for i, w in enumerate(weights)], "p int, w double, seats long, g int")
        got = {r.p: r.quota for r in mixing.apportion(df, ["p"], "w", "seats", ["g"]).collect()}
        assert [got[i] for i in range(9)] == lague(weights, seats)


def filled(sizes):
    weights, total = [(5, 2, 1)[i % 3] for i in range(len(sizes))], 1.5 * sum(sizes)
    full = set()
    while True:
        rest = total - sum(2 * sizes[i] for i in full)
        open_ = [i for i in range(len(sizes)) if i not in full]
        level = rest / max(sum(weights[i] for i in open_), 1)
        over = {i for i in open_ if weights[i] * level > 2 * sizes[i]}
        if not over:
            return [2.0 * sizes[i] if i in full else weights[i] * level for i in range(len(sizes))]
        full |= over


def test_mixing(spark):
    rng = random.Random(7)
    rows = [(i, None if i % 9 == 0 else " ".join("w" for _ in range(rng.randrange(200))), rng.choice(["a", "b", "B", "é", "z", None, "tiny"][: 7 if i < 20 else 6])) for i in range(400)]
    rows += [(400, "w " * 30_000, "a"), (5, "w w w", "a"), (5, "w w w", "a"), (None, "x y", "z")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    mix = lambda df: df.transform(lambda d: mixing.mix(d, shard_words=4000)).select("doc_id", "source", "size", "source_size", "target", "taken")
    got = [tuple(r) for r in mix(docs.repartition(3)).collect()]
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    assert sorted(got, key=key) == sorted((tuple(r) for r in mix(docs.repartition(8)).collect()), key=key)
    assert Counter((i, s, len(words_of(t or ""))) for i, t, s in rows) == Counter((r[0], r[1], r[2]) for r in got)
    names = sorted({r[2] for r in rows if r[2] is not None}) + [None]
    sizes = [sum(len(words_of(t or "")) for _, t, s in rows if s == n) for n in names]
    for n, size, target in zip(names, sizes, filled(sizes)):
        own = [r for r in got if r[1] == n]
        assert {r[3] for r in own} == {size} and abs(own[0][4] - target) < 1e-6 * max(1, target)
        assert all(0 <= r[5] <= 2 * r[2] for r in own) and abs(sum(r[5] for r in own) - target) <= 1
    assert mixing.mix(docs.limit(0)).count() == 0
    assert [r.taken for r in mixing.mix(docs.where("text is null").limit(3)).collect()] == [0, 0, 0]


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = P.drop_shared_lines(spark, docs, SF)
    assert left.columns == docs.columns and left.count() == docs.count()
    want = {(i, sha) for i, _, _, sha in brute_lines([(r.doc_id, r.text) for r in docs.collect()])}
    assert {(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in left.collect()} == want
    # columns that stages use inside, empty tables, and rows that are repeated
    clash = odd_docs(spark).select(*P.COLUMNS).withColumns({c: F.lit(7) for c in ("_score", "_row", "_gone_id", "_gone_keys", "line_dedup", "_leak_id", "_leak_row", "_lead_id", "_lead_row", "row", "words", "v")})
    for _, stage in P.STAGES[:-1]:
        got = stage(spark, clash, SF)
        assert got.columns == clash.columns and got.select("_row", "line_dedup", "v").distinct().collect() == [(7, 7, 7)]
    out = P.run(spark, SF)
    assert {"doc_id", "source", "size", "target", "taken"} <= set(out.columns) and 0 < out.count() < docs.count()


def test_queries_are_named():
    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{n}" for n in range(1, 11)]
    assert queries.ORACLES.keys() <= queries.QUERIES.keys()
