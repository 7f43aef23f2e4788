import random

import numpy as np
import xxhash

from tidemark.llm import simhash_dedup as S
from tidemark.llm.components import components
from tidemark.llm.shared import words_of


def brute_fp(text):
    w = words_of("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n, near):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if near(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(90), rng.randrange(90)) for _ in range(50)]
    got = {r.v: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    link = {frozenset(e) for e in edges}
    want = roots(170, lambda i, j: frozenset((i, j)) in link)
    for i in got:
        for j in got:
            assert (got[i] == got[j]) == (want[i] == want[j])


def test_links_are_whole(spark, monkeypatch):
    rng = random.Random(5)
    fps = {0, (1 << 64) - 1}
    for _ in range(30):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(8):
            for b in rng.sample(range(64), rng.randint(1, 6)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    for radius in (4, 2):
        want = roots(len(fps), lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= radius)  # noqa: B023
        got = {int(np.int64(r.v).view(np.uint64)): r.root for r in components(S.links(df, radius, lead_bits=3)).collect()}
        for i, f in enumerate(fps):
            for j, g in enumerate(fps):
                assert (want[i] == want[j]) == (got.get(f, f) == got.get(g, g))


def test_blocks_are_split(monkeypatch):
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 12, 300, dtype=np.uint64)
    fps = np.unique(fps)
    full = {(a, b) for x, y in S._met(fps, np.full(len(fps), 2), 12) for a, b in zip(x.tolist(), y.tolist())}
    monkeypatch.setattr(S, "BLOCK", 500)
    split = {(a, b) for x, y in S._met(fps, np.full(len(fps), 2), 12) for a, b in zip(x.tolist(), y.tolist())}
    r = lambda e: roots(len(fps), lambda i, j: (fps[j], fps[i]) in e or (fps[i], fps[j]) in e)
    assert r(full) == r(split)


def test_near_duplicates(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeÉZ") for _ in range(rng.randint(1, 6)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 40)))) for i in range(40)]
    base = [word() for _ in range(400)]
    for i in range(40, 60):
        w = list(base)
        w[rng.randrange(400)] = word()
        rows.append((i, "\n".join(w)))
    rows += [(60, None), (61, ""), (62, " \t"), (63, rows[3][1]), (None, rows[3][1]), (3, rows[3][1])]
    got = S.near_duplicates(spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, fp int").select("doc_id", "text", "fp")).collect()
    fp = [brute_fp(t) for _, t in rows]
    root = roots(len(rows), lambda i, j: bin(fp[i] ^ fp[j]).count("1") <= 4)
    want = [(rows[i][0], f"{fp[i]:016x}", min(r[0] for j, r in enumerate(rows) if root[j] == root[i] and r[0] is not None)) for i in range(len(rows))]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def shingle_set(text):
    w = words_of("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())


def jaccard(a, b):
    return 1.0 if a == b else len(a & b) / len(a | b)


def near_rows():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgÉZ") for _ in range(rng.randint(2, 7)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(30)]
    for base, changes in ((100, 1), (200, 3), (300, 30)):  # similar by some 0.97, 0.92 and 0.3
        text = [word() for _ in range(300)]
        for i in range(12):
            w = list(text)
            for k in range(changes * (i > 0)):
                w[(37 * i + 97 * k) % 300] = word()
            rows.append((base + i, "  ".join(w) if i % 2 else "\n".join(w)))
    rows += [(60, None), (61, ""), (62, " \t"), (63, rows[3][1].upper().replace("É", "É")), (None, rows[3][1]), (3, rows[3][1]), (70, "one two"), (71, "one  two"), (72, "one two three")]
    return rows


def test_one_of_each(spark):
    rows = near_rows()
    kept = S.one_of_each(spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, words int, v int"))
    assert kept.columns == ["doc_id", "text", "words", "v"]
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    sets = [shingle_set(t) for _, t in rows]
    root = roots(len(rows), lambda i, j: jaccard(sets[i], sets[j]) >= 0.8)
    want = sorted({min((rows[j][0] is None, rows[j][0] or 0) for j, r in enumerate(root) if r == root[i]) for i in range(len(rows))})
    assert got == want and len([i for _, i in got if i >= 300]) == 12
    assert S.one_of_each(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shorter_fingerprints_meet():
    """The stage's reach: pairs at a similarity of 0.9 meet, of 0.8 most do."""
    rng = np.random.default_rng(1)
    salts = S.mix64(np.arange(1, S.TABLES * S.TABLE_BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def words(h):
        return (2 * np.unpackbits(S.mix64(h[:, None] ^ salts[None, :]).view(np.uint8), axis=1).sum(axis=0, dtype=np.uint32) > len(h)).reshape(S.TABLES, S.TABLE_BITS)

    for similarity, least in ((0.9, 0.95), (0.8, 0.5)):
        met = 0
        for _ in range(200):
            n = 300
            same = round(2 * similarity / (1 + similarity) * n)
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            b = np.concatenate([a[:same], rng.integers(0, 1 << 63, n - same, dtype=np.uint64)])
            met += (words(a) != words(b)).sum(axis=1).min() <= S.RADIUS
        assert met / 200 >= least


def test_leading_bits_grow():
    assert S.lead_bits_for(1000, 2) == S.LEAD_BITS
    for n in (10**6, 10**9, 10**11):
        b = S.lead_bits_for(n, 2)
        assert n * len(S._flips(b, 2)) <= S.GATHERED << b


def rows_sent(links):
    """Rows that the first of two mapInArrow nodes made, once ``links`` has run."""
    links.collect()
    made, nodes = [], [links._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        name = node.nodeName()
        if name == "MapInArrow":
            made.append(node.metrics().apply("pythonNumRowsReceived").value())
        inner = [node.executedPlan()] if name == "AdaptiveSparkPlan" else [node.plan()] if name.endswith("QueryStage") else []
        nodes += inner + [node.children().apply(i) for i in range(node.children().size())]
    assert len(made) == 2
    return made[-1]


def test_rows_sent_grow_with_the_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(S, "GATHERED", 1024)
    rng = random.Random(11)
    fps = [(rng.getrandbits(63),) for _ in range(3300)]
    few, many = (rows_sent(S.links(spark.createDataFrame(fps[:n], "fp long"), 4, bits=48, tables=1)) for n in (660, 3300))
    assert few >= 660 and many <= 8 * few


def test_links_that_differ_in_any_bits_are_whole(spark):
    """Up to radius bits are dealt to the leading bits and both halves below in every way."""
    rng = random.Random(13)
    for radius, bits, lead_bits in ((4, 48, 9), (2, 48, 9), (4, 64, 5), (4, 48, 30)):
        low = bits - lead_bits
        fields = [range(low, bits), range(low // 2, low), range(low // 2)]
        fps = set()
        for parts in [(i, j, k) for i in range(radius + 2) for j in range(radius + 2) for k in range(radius + 2) if i + j + k in (radius, radius + 1)]:
            x = rng.getrandbits(bits) | (rng.randrange(8) << bits if bits < 64 else 0)
            y = x
            for field, n in zip(fields, parts, strict=True):
                for b in rng.sample(field, n):
                    y ^= 1 << b
            fps |= {x, y, x ^ 1 << 48} if bits < 64 else {x, y}  # tables do not meet
        fps = sorted(fps)
        distance = lambda i, j: bin(fps[i] ^ fps[j]).count("1") if bits == 64 or fps[i] >> bits == fps[j] >> bits else 64  # noqa: B023, E731
        want = {frozenset((fps[i], fps[j])) for i in range(len(fps)) for j in range(i) if distance(i, j) <= radius}
        df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
        found = S.links(df, radius, lead_bits, bits=bits, tables=8 if bits < 64 else 1, forest=False).collect()
        got = {frozenset(int(np.int64(f).view(np.uint64)) for f in (r.a, r.b)) for r in found}
        assert got == want and len(want) >= 6
