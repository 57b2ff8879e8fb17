import __spark_entry__ as entry


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 40


def test_entry_and_oracles_on_the_small_table(spark, sf):
    import duckdb

    db = duckdb.connect()
    for t in ("pages", "documents", "orders", "supplier", "customer"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name in ("url_normalize", "visible_word_counts", "doc_phones", "tokenize", "bm25_idf", "full_audit", "rule_findings", "chunks", "title_brand", "phone_normalize"):
        got = entry.queries()[name](spark, sf)
        want = db.execute(entry.oracle_sql()[name])
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(got.columns)
        assert sorted(map(tuple, got.select(columns).collect()), key=str) == sorted(want.fetchall(), key=str)
    assert entry.entry(spark).limit(1).count() == 1


def test_pages_are_parsed_once(spark, sf, monkeypatch):
    """Parsed pages are a written table before rules, reports and answers branch: no plan parses twice."""
    for name in ("full_audit", "duplicate_titles", "page_identity", "qa_answer"):
        plan = entry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "run(" not in plan, name  # the parser's function
