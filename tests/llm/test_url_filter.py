import random

import numpy as np
from pyspark.sql import functions as F

from webquarry.llm import queries, url_filter as u


def slow(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        n = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n])
        path = rest[n:]
        path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    best = None
    for rule, v in queries.URL_RULES:
        h, p = rule[: rule.index("/")], rule[rule.index("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(rule) > len(best[0])):
            best = (rule, v)
    if best:
        return host, path, *best
    hit = any(host == b or host.endswith("." + b) for b in queries.BLOCKED_HOSTS)
    return host, path, None, "block" if hit else "allow"


URLS = [None, "", "no scheme", "http://", "http://COM/", "https://Example.COM/en/x?y#z", "http://www.example.com/en/1", "http://a.www.example.com/en/", "http://x.net/es/1", "http://x.net/es", "http://x.net/fr/?q", "http://notnet/es/", "http://com", "http://com?x/", "a://b://c/d", "http://spam-farm.example.org/en/", "http://m.casino-win.example.net/de/1", "http://x.com.\nq/a\nb", "http://ÉA.net/es/", "http://a..com/", "http://..net/fr/"]


def test_verdicts_equal_brute_force(spark, sf):
    urls = URLS + [r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    df = spark.createDataFrame([(i % 40, x) for i, x in enumerate(urls)], "page_id long, url string").selectExpr("*", "1 AS host", "2 AS key")
    got = u.judge(df, queries.URL_RULES, queries.BLOCKED_HOSTS)
    want = sorted(((i % 40, *slow(x)) for i, x in enumerate(urls)), key=str)
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.collect()), key=str) == want
    assert u.judge(df.limit(0), queries.URL_RULES, queries.BLOCKED_HOSTS).count() == 0
    parts = u.judge(df, queries.URL_RULES, queries.BLOCKED_HOSTS, max_bits=64)
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in parts.collect()), key=str) == want


def test_cascade_is_exact(spark):
    rng = random.Random(4)
    keys = [f"k{rng.random()}" for _ in range(5000)]
    df = spark.createDataFrame([(k, i < 700) for i, k in enumerate(keys)], "key string, yes boolean").select("key", "yes", *[h.alias(n) for h, n in zip(u.hashes(F.col("key")), ("h1", "h2"))])
    c = u.Cascade.build(df.where("yes"), df.where("NOT yes"))
    assert len(c.levels) > 1
    rows = df.collect()
    as_u = lambda n: np.array([r[n] for r in rows], dtype=np.int64).view(np.uint64)
    assert u.listed(c.levels, as_u("h1"), as_u("h2")).tolist() == [r.yes for r in rows]
    assert sum(x.bits for x in c.levels) < 64 * 700
