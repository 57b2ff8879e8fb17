import numpy as np

from webquarry.llm import ann


def brute(ids, x, every, k):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        out[int(ids[i])] = [(int(ids[j]), float(d[j])) for j in np.lexsort((ids, d)) if ids[j] != ids[i]][:k]
    return out


def test_pigeonhole_finds_the_whole_radius():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 1 << 16, size=(3000, 4)).astype(np.uint16)
    codes[:500] = codes[0] ^ (1 << rng.integers(0, 16, size=(500, 4))).astype(np.uint16)
    t = ann.Tables(codes)
    for r in (0, 1, 2, 3, 4, 5, 9, 14, 22, 27, 64):
        assert sorted(t.within(codes[0], r)) == np.flatnonzero(ann.hamming(codes[0], codes) <= r).tolist()


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.select("vec_id", "embedding").toPandas()
    ids, x = rows.vec_id.to_numpy(), np.stack(rows.embedding.to_list()).astype(np.float64)
    want = brute(ids, x, 100, 10)
    got = {}
    for r in ann.search(df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11))
        true = dict(want[q])
        hits += sum(v in true for _, v, _ in found)
        assert all(abs(true[v] - s) < 1e-12 for _, v, s in found if v in true)
    assert hits / (10 * len(want)) >= 0.9


def test_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, []), (None, [1.0, 1.0]), (8, [0.0, 2.0]), (8, [0.0, 2.0]), (100, [float("inf"), 1.0]), (200, [-1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS score", "2 AS x")
    got = [tuple(r) for r in ann.search(df).orderBy("query_id", "rank").collect()]
    assert [(q, r, v) for q, r, v, _ in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 200), (0, 4, 8), (0, 5, 8), (200, 1, 8), (200, 2, 8), (200, 3, 0), (200, 4, 1), (200, 5, 2)]
    assert got[0][3] == 0.0
    assert ann.search(df.limit(0)).count() == 0


def test_repeats_ragged_and_many_groups(spark, monkeypatch):
    """Every row but the query's own is a candidate; the radius holds all codes here, so that the result is exact."""
    monkeypatch.setattr(ann, "GROUP_ROWS", (40, 40))
    monkeypatch.setattr(ann, "TARGET", 1.0)
    rng = np.random.default_rng(2)
    rows = [(int(i), rng.normal(size=3).round(2).tolist()) for i in range(300)]
    rows += [(0, [0.5, 0.5, 0.5]), (0, [0.5, 0.5, 0.5]), (100, [9.0, 9.0, 9.0]), (7, rows[7][1])] + [(8, [1.0, 1.0, 1.0])] * 30 + [(9, [1.0]), (200, [1.0, 2.0])]
    rng.shuffle(rows)
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    full = [(i, tuple(x)) for i, x in rows if len(x) == 3]
    want = []
    for q in sorted({r for r in full if r[0] % 100 == 0}):
        rest = list(full)
        rest.remove(q)
        near = sorted((float(np.sqrt(((np.array(x) - np.array(q[1])) ** 2).sum())), i) for i, x in rest)[:10]
        want += [(q[0], n + 1, i, d) for n, (d, i) in enumerate(near)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_scans_dont_grow_with_queries(spark):
    def scans(every):
        df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
        return ann.search(df, every=every)._jdf.queryExecution().optimizedPlan().toString().count("Relation")

    assert scans(100) == scans(2)
