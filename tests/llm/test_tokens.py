import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from webquarry.llm import records, token_count

PATH = public_tokenizers.path("byte_bpe_50k.json")
HARD = ["", None, " ", "a", "  two  spaces \n\n x", "x" * 5000, "1234567 it's we'll", "naïve Ünïcode ñ 漢字 한국어 🙂🙂 a‍b", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "\x1c\x1f\x85\xa0 q", "tab\tnew\r\nline  ", "́é", "𝔘𝔫𝔦 ퟿", "<|endof"]


def texts(spark, sf):
    rng = random.Random(3)
    own = ["".join(rng.choice("ab c'\n\tsd1é!ß漢") for _ in range(rng.randrange(60))) for _ in range(300)]
    return HARD + own + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").take(60)]


def test_counts_equal_library(spark, sf):
    lib = Tokenizer.from_file(PATH)
    rows = texts(spark, sf)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").withColumnRenamed("doc_id", "doc_id")
    got = {r.doc_id: r for r in token_count.token_counts(df, PATH, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(rows):
        want = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (want, len((t or "").encode()), want > 1024), t
    assert token_count.token_counts(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_records_round_trip(spark, sf):
    lib = Tokenizer.from_file(PATH)
    rows = texts(spark, sf)
    keyed = [(i * 37 % 1009, t) for i, t in enumerate(rows)]
    df = spark.createDataFrame(keyed, "doc_id long, text string")
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in records.encode_and_read(df, PATH).collect())
    at, want = 0, []
    for d, t in sorted(keyed, key=lambda x: x[0]):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want.append((at, d, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want


def test_shuffled_read_by_index(spark, sf, tmp_path):
    df = spark.read.parquet(f"{sf}/documents.parquet").limit(50)
    path = records.write_records(df, f"{tmp_path}/r", PATH)
    index = records.build_index(spark, path, f"{tmp_path}/i")
    one, two = ([(r.doc_id, r.ids) for r in records.read_shuffled(spark, path, index, seed).collect()] for seed in (1, 2))
    assert one != two and sorted(one) == sorted(two)
    lib = Tokenizer.from_file(PATH)
    assert dict(one) == {r.doc_id: [*lib.encode(r.text, add_special_tokens=False).ids, 0] for r in df.collect()}


def test_records_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "b"), (2, None), (2, None), (1, "a")], "doc_id long, text string").selectExpr("*", "1 AS start", "'x' AS file")
    got = sorted(((r.start, r.doc_id, r.n_tokens) for r in records.encode_and_read(df, PATH).collect()))
    assert got == [(0, None, 2), (2, 1, 2), (4, 2, 1), (5, 2, 1)]
    assert records.encode_and_read(df.limit(0), PATH).count() == 0


def test_many_rows_of_one_id_are_split(spark, monkeypatch):
    monkeypatch.setattr(records, "FILE_BYTES", 2_000)
    monkeypatch.setattr(records, "TASKS", 3)
    rows = [(None if i % 3 else 7, f"text {i} " + "x y " * (i % 11)) for i in range(300)] + [(None, None)] * 40 + [(9, "long " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    path = records.write_records(df, records.new_path(spark, "records"), PATH)
    index = records.build_index(spark, path, records.new_path(spark, "records-index"))
    per = index.groupBy("file").count().collect()
    assert len(per) > 6 and max(r["count"] for r in per) < 50
    got = sorted((r.start, r.n_tokens, -1 if r.doc_id is None else r.doc_id) for r in records.placed(index).collect())
    assert [g[2] for g in got] == sorted(-1 if i is None else i for i, _ in rows)
    assert all(a[0] + a[1] == b[0] for a, b in zip(got, got[1:])) and got[0][0] == 0
    lib = Tokenizer.from_file(PATH)
    assert sorted(g[1] for g in got) == sorted(1 + len(lib.encode(t or "", add_special_tokens=False).ids) for _, t in rows)


def test_files_are_ordered_by_number(spark):
    names = [f"part-{n}.txt" for n in ("99999-c8-c001", "100000-c8-c000", "00002-u-c000", "99999-c8-c000", "99999-c8-c1000")]
    index = spark.createDataFrame([(n, 0, 1, i, 10 ** i, 0, 0) for i, n in enumerate(names)], records.INDEX)
    assert {r.doc_id: r.start for r in records.placed(index).collect()} == {2: 0, 3: 100, 0: 1100, 4: 1101, 1: 11101}


def test_cutting_at_spaces_equals_the_library(monkeypatch):
    lib, rng = Tokenizer.from_file(PATH), random.Random(5)
    some = [*"ab c  \n\t'sé1,9.!\xa0\x85\u3000\x1c\x0b家дᾳ🙂\u0301  ", "<|endoftext|>", "'ll", " ", "  ", "\r\n", " word", " words,"]
    rows = ["".join(rng.choice(some) for _ in range(rng.randrange(14))) for _ in range(8000)]
    want = [lib.encode(t, add_special_tokens=False).ids for t in rows]
    for size in (1, 200, 1 << 20):
        monkeypatch.setattr(token_count, "SLICE", size)
        counter, encoder = token_count.BytePairCounter(PATH, public_tokenizers.PATTERN), records.WordEncoder(PATH, "<u2")
        texts = pa.array([None, *rows]).slice(1)
        assert counter.counts(texts).tolist() == [len(x) for x in want]
        got = [np.frombuffer(b, "<u2").tolist() for cut in token_count.cut_at_spaces(texts, encoder.specials) for b in encoder.ids(cut)]
        assert got == want
    assert counter.counts(pa.array([None, ""])).tolist() == [0, 0] and counter.counts(pa.array([], pa.string())).tolist() == []


def test_damage_is_found():
    data = records.frame(b"payload") + records.END_BYTE
    assert records.unframe(data) == (b"payload", len(data))
    for k in range(len(data)):
        bad = bytearray(data)
        bad[k] ^= 4
        with pytest.raises(records.DamagedRecord):
            records.unframe(bytes(bad))


def test_plain_split_equals_unicode_split():
    import regex

    want, got = regex.compile(public_tokenizers.PATTERN).findall, token_count.plain_splitter(public_tokenizers.PATTERN)
    every = [c for c in map(chr, range(0x10000)) if not 0xD800 <= ord(c) < 0xE000 and not token_count.PLAIN.search(c)]
    assert len(every) > 20000
    rng = random.Random(8)
    few = every[:700]
    for _ in range(3000):
        t = "".join(rng.choice(rng.choice([few, every, "a 1 '_\n"])) for _ in range(40))
        assert got(t) == want(t)


def test_word_table_is_bounded_and_exact():
    asked, table = [], token_count.WordTable(8, pa.string())
    for i in range(50):
        words = ["hot", *[f"w{i + j}" for j in range(3)], "x" * (60 + i % 9)]
        got = table.of(pa.array(words), lambda ws: asked.extend(ws) or pa.array([w + "!" for w in ws], pa.string()))
        assert got.to_pylist() == [w + "!" for w in words] and len(table.words) <= 8
    assert asked.count("hot") == 1 and asked.count("w20") <= 2


def test_memo_keeps_what_is_in_use():
    asked = []
    m = token_count.Memo(20, lambda w: asked.append(w) or len(w))
    for i in range(1000):
        assert m["hot"] == 3 and m[f"word{i}"] == len(f"word{i}")
        assert len(m) + len(m.old) <= 20
    assert asked.count("hot") == 1 and m["x" * 100] == 100 and "x" * 100 not in m
