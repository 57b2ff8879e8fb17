import random
import re

import xxhash
from pyspark.sql import functions as F

from webquarry.llm import simhash


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(rows):
    fp = [slow_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return sorted(((d, f"{fp[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def test_fingerprint_equals_definition(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").take(40)] + [None, "", " \n", "A", "a b", "É Ä a\x0bb c"]
    assert [simhash.fingerprint(t) for t in texts] == [slow_fingerprint(t) for t in texts]


def test_components_equal_brute_force(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([3, 30, 300]))]
        for _ in range(rng.choice([1, 2, 6])):
            t = list(base)
            t[rng.randrange(len(t))] = "x" + str(rng.random())[:3]
            rows.append((len(rows) * 7 % 1009, " ".join(t)))
    rows += [(5000, None), (5001, ""), (5001, ""), (None, "only nulls"), (5002, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1)).withColumn("component_id", F.lit("x"))
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == slow_components(rows)


def test_big_buckets_lose_no_link(spark):
    rng = random.Random(2)
    fps = {rng.getrandbits(64)}
    while len(fps) < 400:  # a ball in which many share every segment
        x = rng.choice(sorted(fps))
        for _ in range(rng.choice([1, 2, 3])):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    from webquarry.llm.common import connected_components

    roots = {r.node % 2**64: r.root % 2**64 for r in connected_components(simhash.links(df)).collect()}
    for i, x in enumerate(fps):
        for y in fps[:i]:
            if (x ^ y).bit_count() <= 2:
                assert roots[x] == roots[y]
    for e in simhash.links(df).collect():
        assert ((e.a ^ e.b) % 2**64).bit_count() <= 2


def test_keep_one_and_empty(spark):
    rows = [(3, "a b c d"), (1, "a b c d"), (1, "a b c d"), (1, "the id of another text"), (2, "other words stand here"), (None, "z z z z"), (None, "z z z z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("c", F.lit(5)).withColumn("root", F.lit(1))
    kept = sorted((tuple(r) for r in simhash.keep_one(df).collect()), key=str)
    assert kept == sorted([(1, "a b c d", 5, 1), (1, "the id of another text", 5, 1), (2, "other words stand here", 5, 1), (None, "z z z z", 5, 1)], key=str)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0
