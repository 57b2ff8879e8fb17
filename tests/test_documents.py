import math
import re
from collections import Counter

import __spark_entry__ as entry
from webquarry import queries
from webquarry.functions import questions as qf

ROWS = [
    (1, "The heat of the town isn't the naïve sort, and heat-waves andre it.", "en"), (2, "Die Häuser der Straße, the heat und ingly 42 Stationen", "de"), (3, "El café de Andre y la nación; thion, THE heat", "es"),
    (4, "une forêt où the ingly l'été, andre's running", None), (5, "snake_case heat and plain running stations", "en"), (6, "Only plain English stations here, quickly ended", "en"), (7, None, "fr"), (8, "", "en"), (9, "дом the 家 heat", None),
]


def short(w):
    if len(w) > 3:
        for cut in (r"^(..+ion)s$", r"^(..+)ion$", r"^(.{3,}?)(?:ing|ly|ed|es|s)$"):
            w = re.sub(cut, r"\1", w)
    return w


def terms(text):
    out = []
    for w in re.findall(qf.TOKEN, (text or "").lower()):
        if len(w) > 1:
            out += dict.fromkeys([w, short(w)])
    return out


def test_whole_table_equals_brute_force(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: sorted(map(tuple, entry.queries()[name](spark, str(tmp_path)).collect()), key=str)
    docs = {i: terms(t) for i, t, _ in ROWS}
    words = {w for _, t, _ in ROWS for w in re.findall(qf.TOKEN, (t or "").lower()) if len(w) > 1}
    assert {"town", "der", "stationen", "andre's"} <= words and not {"caf", "snake", "na"} & words
    assert run("stem") == sorted(((w, short(w)) for w in words), key=str)
    assert run("tokenize") == sorted(((i, len(t), len(set(t))) for i, t in docs.items() if t), key=str)
    df = Counter(w for t in docs.values() for w in set(t))
    idf = {w: math.log(1 + (len(ROWS) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    assert run("bm25_idf") == sorted(((w, df[w], round(idf[w], 6)) for w in df), key=str)
    avg = sum(map(len, docs.values())) / len(ROWS)
    score = {i: sum(idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.6 + 0.4 * len(t) / avg)) for w in queries._TERMS if w in t) for i, t in docs.items()}
    want = sorted(((i, round(x, 4)) for i, x in score.items() if x > 0), key=lambda r: (-r[1], r[0]))[:10]
    assert [i for i, _ in want] == [r.doc_id for r in entry.queries()["bm25_topk"](spark, str(tmp_path)).collect()]
    assert run("bm25_topk") == sorted(want, key=str)


def test_phones_of_all_patterns(spark, tmp_path):
    rows = [(1, "call 212-555-1234 now"), (2, "98765 43210 or 9123456780"), (3, "+1 (743) 555-3824"), (4, "12345678901 and 555-1234"), (5, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["doc_phones"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(1, "212-555-1234", "2125551234"), (2, "9123456780", "9123456780"), (2, "98765 43210", "9876543210"), (3, "+1 (743) 555-3824", "17435553824")]
    assert {"2125551234", "9876543210", "9123456780", "17435553824"} <= {r.normal for r in entry.queries()["phone_canonical"](spark, str(tmp_path)).collect()}
