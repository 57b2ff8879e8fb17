import itertools

import numpy as np

from webquarry.llm import langid


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    m = langid.Model(["a", "b", "c"], {})
    m.step = rng.normal(size=(3, 3))
    lengths = np.array([1, 5, 3])
    e = np.exp(rng.normal(size=(9, 3)))
    got = m.marginals(e, lengths)
    at = 0
    for n in lengths:
        want = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            for s in range(3):
                w = np.exp(m.step[s, path[0]]) * np.prod([e[at + i, k] for i, k in enumerate(path)]) * np.prod([np.exp(m.step[a, b]) for a, b in zip(path, path[1:])])
                for i, k in enumerate(path):
                    want[i, k] += w
        assert np.allclose(got[at : at + n], want / want.sum(axis=1, keepdims=True))
        at += n


def test_blocks_do_not_change_marginals(monkeypatch):
    rng = np.random.default_rng(1)
    m = langid.Model(["a", "b"], {})
    m.step = np.array([[2.0, 0.1], [0.3, 1.5]])
    e = np.exp(3 * rng.normal(size=(1500, 2)))
    lengths = np.array([700, 64, 65, 1, 670])
    want = m.marginals(e, lengths)
    for b in (1, 7, 2000):
        monkeypatch.setattr(langid, "BLOCK", b)
        assert np.allclose(m.marginals(e, lengths), want)


def test_long_texts_in_parts(monkeypatch):
    rng = np.random.default_rng(4)
    m = langid.Model(["a", "b", "c"], {})
    m.step = rng.normal(size=(3, 3))
    m.emit = rng.normal(size=m.emit.shape).astype(np.float32)
    texts = [" ".join("".join(rng.choice(list("abcde"), size=4)) for _ in range(n)) for n in (900, 3, 130, 128, 2000)]
    want = m.predict(texts)
    monkeypatch.setattr(langid, "GROUP_WORDS", 64)
    for (x, a, b), (y, c, d) in zip(m.predict(texts), want):
        assert x == y and abs(a - c) < 1e-9 and abs(b - d) < 1e-9


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(7)
    e, step, gold = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3)), rng.integers(3, size=(2, 4))

    def loss(e, step):
        out = 0.0
        for b in range(2):
            score = lambda path: sum(e[b, k, s] for k, s in enumerate(path)) + sum(step[x, y] for x, y in zip(path, path[1:]))
            first = lambda path: np.log(np.exp(step[:, path[0]]).sum() / 3)  # noqa: E731 - any label may come before the first word
            out += np.log(sum(np.exp(score(p) + first(p)) for p in itertools.product(range(3), repeat=4))) - score(gold[b]) - first(gold[b])
        return out

    grad, moves = langid._gradient(e, step, gold)
    for at in itertools.product(range(2), range(4), range(3)):
        d = np.zeros_like(e)
        d[at] = 1e-5
        assert abs((loss(e + d, step) - loss(e - d, step)) / 2e-5 - grad[at]) < 1e-6
    assert moves.shape == (3, 3) and abs(moves.sum()) < 1e-9


def test_rarer_languages_than_the_bound_are_left_out(spark):
    df = spark.createDataFrame([(i, f"word{i} text", "a" if i < 9 else f"l{i % 3}") for i in range(18)], "doc_id long, text string, lang string")
    assert {x for _, x in langid.sample(df, languages=2)} == {"a", "l0"}


def test_held_out_accuracy_and_switching(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    rows = docs.select("doc_id", "lang").collect()
    held = [r for r in rows if got[r.doc_id].held_out]
    assert len(held) > 100 and sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    model = langid.train(docs)
    de, es = (docs.where(f"lang = '{x}' AND n_chars > 2000 AND NOT text LIKE '%#%'").orderBy("doc_id").first().text.split()[:40] for x in ("de", "es"))
    words = langid.words_of(" ".join(de + es))
    m = model.marginals(model.emissions(words), np.array([len(words)]))
    top = [model.labels[k] for k in m.argmax(axis=1)]
    assert top[: len(words) // 3].count("de") > 0.8 * (len(words) // 3) and top[-len(words) // 3 :].count("es") > 0.8 * (len(words) // 3)


def test_edges(spark):
    rows = [(1, "the house is here", "en"), (2, "das haus ist hier", "de"), (3, None, "en"), (4, "", None), (5, "12 -- ²", "de"), (None, "the house", None), (7, "haus " * 30000, None), (7, "haus " * 30000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "2 AS h")
    got = sorted(((r.doc_id, r.lang_pred) for r in langid.identify(df).collect()), key=str)
    assert [x for x in got if x[0] in (3, 4, 5)] == [(3, "und"), (4, "und"), (5, "und")]
    assert got.count((7, "de")) == 2
    assert sorted(r.doc_id or 0 for r in langid.with_language(df).collect()) == [0, 1, 2, 7, 7]
    assert langid.identify(df.limit(0)).count() == 0
    none = langid.identify(df.selectExpr("doc_id", "text", "cast(NULL AS string) AS lang")).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}


def test_even_mix_of_four_languages_stays(spark, monkeypatch):
    words = ["alpha", "bravo", "charlie", "delta"]
    m = langid.Model(["a", "b", "c", "d"], {})
    for k, w in enumerate(words):
        m.emit[langid.features(w, {}), k] += 5
    (lang, score, sure), nothing = m.predict([" ".join(words), None])
    assert score < 0.3 and sure > 0.9 and nothing == ("und", 0.0, 0.0)
    monkeypatch.setattr(langid, "train", lambda *a: m)
    df = spark.createDataFrame([(1, " ".join(words), None), (2, "12", None)], "doc_id long, text string, lang string")
    assert [r.doc_id for r in langid.with_language(df).collect()] == [1]
