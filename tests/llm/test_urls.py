from itertools import combinations

from pyspark.sql import functions as F

from tidemark.llm import url_filter as U


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:at], rest[at:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(h, p, v) for h, p, v in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fits:
        return host, path, None, None
    h, p, v = max(fits, key=lambda r: len(r[0] + r[1]))
    return host, path, h + p, v


URLS = [None, "", "no scheme", "http://", "http://Example.ORG/es/1", "http://a.example.org/es", "http://a.example.org/en/12?x=1#y", "https://b.com/fr/x", "https://b.com/de/x", "https://b.com/de", "https://com/de/1", "https://xcom/de/1", "https://b.com?/fr/", "https://É.com/fr/", "http://a.org?u=http://b.com/de/", "http://h.net/a://b", "x://y.net\n/de/", "https://b.com/de/x", "http://org/", "http://org", "://b.org/", "a://b://c.org/"]


def test_parts_and_listed_rules(spark):
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in U.verdicts(df).collect()}
    assert len(got) == len(URLS)
    for i, url in enumerate(URLS):
        host, path, rule, verdict = brute(url)
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule), url
        assert r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")
    assert U.verdicts(df.limit(0)).count() == 0


def test_mined_rules(spark):
    rows = []
    for i in range(120):
        spam, fr = i % 4 == 0, i % 3 == 0
        tokens = (["host:spam"] if spam else ["host:good"]) + (["path:fr"] if fr else ["path:en"]) + ["host:example"]
        rows.append((tokens, "block" if spam and fr else "allow"))
    mined = {(tuple(r.tokens), r.label): r for r in U.mine(spark.createDataFrame(rows, "tokens array<string>, label string"), 0.02, 0.9).collect()}
    tokens = sorted({t for r in rows for t in r[0]})
    want = set()
    for n in (1, 2, 3):
        for c in combinations(tokens, n):
            hold = [y for x, y in rows if set(c) <= set(x)]
            for label in ("allow", "block"):
                conf = hold.count(label) / len(hold) if hold else 0
                if hold.count(label) / len(rows) >= 0.02 and conf >= 0.9:
                    less = [[y for x, y in rows if set(c) - {t} <= set(x)] for t in c] if n > 1 else []
                    if not any(h.count(label) / len(h) >= conf for h in less):
                        want.add((c, label))
    assert set(mined) == want and (("host:spam", "path:fr"), "block") in want
    labelled = spark.createDataFrame(rows, "tokens array<string>, label string")
    pages = spark.createDataFrame([(1, "http://spam.example/fr/1"), (2, "http://spam.example/en/1"), (3, "http://new.net/1")], "page_id long, url string")
    got = {r.page_id: (r.verdict, r.matched) for r in U.verdicts(pages, labelled=labelled, min_support=0.02, min_confidence=0.9).collect()}
    assert got[1] == ("block", ["host:spam", "path:fr"]) and got[2][0] == "allow" and got[3] == ("allow", None)
