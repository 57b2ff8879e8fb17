import itertools
import random
import re

from pyspark.sql import functions as F

from webquarry.llm import decontam as d


def slow(docs, items):
    out = {}
    for (i, a), (j, b) in itertools.product(docs, items):
        t, q = [re.findall(r"[^\W_]+", (x or "").lower()) for x in (a, b)]
        w, best, run = min(len(q), d.WINDOW), 0, 0
        if not q:
            continue
        for diag in range(-len(q), len(t)):
            eq = [0 <= diag + k < len(t) and t[diag + k] == q[k] for k in range(len(q))]
            best = max([best, *(sum(eq[s : s + w]) for s in range(len(q) - w + 1))])
            run = max([run, *(len(list(g)) for same, g in itertools.groupby(eq) if same)])
        found = [(best, w)] * (best >= 0.8 * w - 1e-9) + [(min(run, w), min(run, w))] * (run >= d.EXACT)
        if found:
            out[i, j] = max(found)
    return out


def test_masks_hit_every_window():
    for n in range(11, 21):
        for subs in itertools.combinations(range(n), n // 5):
            bad = set(subs)
            assert any(not bad & {p + o for o in m} for m in d.MASKS for p in range(n - m[-1]))
    for n in range(1, 11):
        for subs in itertools.combinations(range(n), n // 5):
            assert any(not set(subs) & {p + o for o in m} for p, m in d.short_masks(n, 0.8)), (n, subs)


def case(rng):
    words = [f"w{i}" for i in range(300)]
    items = [(j, " ".join(rng.choice(words) for _ in range(n))) for j, n in enumerate([3, 8, 11, 15, 20, 33, 40, 59, 1, 2, 4, 5, 6, 7, 9, 10])] + [(90, None), (91, "")]
    docs = []
    for i in range(150):
        t = [rng.choice(words) for _ in range(rng.choice([0, 4, 40, 400]))]
        j, q = rng.choice(items[:16])
        q = q.split()
        for k in rng.sample(range(len(q)), rng.randrange(0, len(q) // 4 + 2)):
            q[k] = "sub" + str(k)
        at = rng.randrange(len(t) + 1)
        text = t[:at] + (q[rng.randrange(3) :] if i % 3 else []) + t[at:]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(x.upper() if rng.random() < 0.2 else x for x in text)))
    whole = [(300 + j, f"x {q} y") for j, q in items if q]
    return docs + whole + [(200, None), (201, "")], items


def test_leaks_equal_brute_force(spark):
    docs, items = case(random.Random(5))
    ddf = spark.createDataFrame(docs, "doc_id long, text string").withColumn("h", F.lit(1)).withColumn("item_id", F.lit("x")).withColumn("t", F.lit("y")).withColumn("ctx", F.lit(2))
    bdf = spark.createDataFrame(items, "item_id long, text string")
    want = slow(docs, items)
    assert {w for _, w in want.values()} >= {1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 15, 20}
    for block, size in ((10**6, 10**7), (300, 0)):  # one pass and broadcast seeds; several passes and shuffled seeds
        got = {(r.doc_id, r.item_id): (r.matched, r.window) for r in d.leaks(ddf, bdf, seed_block=block, broadcast_bytes=size).collect()}
        assert got == want
    kept = {r.doc_id for r in d.without_leaks(ddf, bdf).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in got}


def test_empty_sides(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f g h i j k l")], "item_id long, text string")
    assert d.leaks(docs, items).count() == 0
    assert d.leaks(items.withColumnRenamed("item_id", "doc_id"), docs.withColumnRenamed("doc_id", "item_id")).count() == 0
    same = items.withColumnRenamed("item_id", "doc_id")
    assert [tuple(r) for r in d.leaks(same.union(same), items).collect()] == [(1, 1, 12, 12, 1.0)]


def test_no_python_in_plan(spark, sf):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    plan = d.leaks(docs, bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_clean_rows_with_null_or_repeated_ids_stay(spark):
    item = "a b c d e f g h i j k l m n"
    rows = [(None, "x " + item), (None, "clean one"), (None, None), (1, item), (1, "clean two"), (1, item), (2, "clean one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = d.without_leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([r for r in rows if item not in (r[1] or "")], key=str)


def test_short_verbatim_excerpts_of_long_items(spark):
    item = [f"i{k}" for k in range(38)]
    docs = [(10 * n + at % 7, " ".join(["x"] * 30 + item[at : at + n] + ["y"] * 30)) for n in (10, 11, 13, 15) for at in (0, 12, 38 - n)]
    got = d.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert {r.doc_id: (r.matched, r.window) for r in got} == {i: (i // 10, i // 10) for i, _ in docs if i >= 110}


def test_only_hits_take_words_along(spark):
    item = " ".join(f"i{k}" for k in range(30))
    docs = spark.createDataFrame([(1, "z " * 200_000 + item), (2, " ".join(f"u{k}" for k in range(500)))], "doc_id long, text string")
    got = d._found(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    scans = [x for x in got.inputFiles() if "/hits-" in x]
    hits = spark.read.parquet(*{x.rsplit("/", 1)[0] for x in scans})
    assert hits.count() == 30 * 2 - 5 - 8 and hits.select("doc_id").distinct().count() == 1
    assert got.select("doc_id").first().doc_id == 1
