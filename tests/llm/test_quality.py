import numpy as np
from pyspark.sql import functions as F

from webquarry.llm import quality as q


def test_em_recovers_accuracies_and_classes():
    rng = np.random.default_rng(0)
    n = 40000
    kind = rng.choice(4, size=n, p=[0.85, 0.05, 0.05, 0.05])  # 0 good, else a kind of bad
    alarm = np.array([[0.01, 0.95, 0.7, 0.1], [0.01, 0.9, 0.1, 0.1], [0.02, 0.1, 0.9, 0.1], [0.01, 0.1, 0.9, 0.8], [0.01, 0.2, 0.1, 0.9]])
    bad = rng.random((n, 5)) < alarm[:, kind].T
    votes = np.where(rng.random((n, 5)) < 0.1, q.ABSTAIN, np.where(bad, q.BAD, q.GOOD))
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    m = q.LabelModel.fit(patterns, counts.astype(float))
    acc = [np.mean((bad[:, j] == (kind > 0))) for j in range(5)]
    assert np.allclose(m.accuracies(), acc, atol=0.03)
    at = {tuple(p): x for p, x in zip(patterns, m.posterior(patterns))}
    said = np.array([at[tuple(v)] for v in votes]) >= 0.5
    assert (said == (kind == 0)).mean() > 0.95 and said[kind == 0].mean() > 0.98
    # the posterior is Bayes' rule under the estimated tables
    row = patterns[7]
    like = [m.share[c] * np.prod([m.tables[j, c, v] for j, v in enumerate(row) if v != q.ABSTAIN]) for c in range(6)]
    assert abs(m.posterior(patterns[7:8])[0] - like[0] / sum(like)) < 1e-12


def test_packing():
    for p in (0, 1, 3**10 - 1, 4711):
        assert q.packed(tuple(q.unpacked(p))) == p


def test_a_useless_labeller_is_not_believed():
    rng = np.random.default_rng(1)
    n = 30000
    bad = rng.random(n) < 0.1
    votes = np.stack([np.where(rng.random(n) < 0.05, ~bad, bad), np.where(rng.random(n) < 0.1, ~bad, bad), np.where(rng.random(n) < 0.15, ~bad, bad), rng.random(n) < 0.5], axis=1)
    patterns, counts = np.unique(np.where(votes, q.BAD, q.GOOD), axis=0, return_counts=True)
    acc = q.LabelModel.fit(patterns, counts.astype(float)).accuracies()
    assert abs(acc[3] - 0.5) < 0.1 and min(acc[:3]) > 0.8


def test_agrees_with_labels_held_out(spark):
    """Neither the label model nor the scorer sees a label; half of the labelled rows are left out of the corpus they learn from, too."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 1
    model, scorer = q.train(docs.where(~out))
    rows = docs.where(out).join(labels, "doc_id").select("text", "quality").collect()
    keep = np.array([scorer.score(r.text) >= 0.5 for r in rows])
    good = np.array([r.quality == 1 for r in rows])
    assert len(rows) > 1000 and keep[good].mean() > 0.97 and keep[~good].mean() < 0.15


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "x"), (None, "The house of the man is in the town and it is old. " * 5), (6, "@@## " * 50000), (6, "@@## " * 50000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS a")
    got = {(r.doc_id, r.votes): r for r in q.assess(df).collect()}
    assert len(got) == 6 and all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 for r in got.values())
    assert all(not r.keep and r.score == 0 for r in got.values() if r.doc_id in (1, 2, 3))
    assert q.assess(df.limit(0)).count() == 0
    assert [r.labeller for r in q.labeller_report(df).collect()] == list(q.LABELLERS)
