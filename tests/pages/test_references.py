import pytest

import __spark_entry__ as entry
from webquarry.functions.dom import Page, parsed, text_of

#: Titles whose last reference was cut off, as where escaped text was shortened; complete ones beside them.
CUT = ["Cats &amp; dogs &amp", "Short&amp;&amp;&amp", "Said &quot;so&quot", "Cut &am", "Cut &a", "Cut &", "Of 2024 &copy", "An &ampere of 5 &middot 6", "A &notit; mark", "Whole &amp;copy; &copy; &middot; &quot;x&quot;",
       "Nearly thirty characters &amp", "Same &amp", "same &amp", "A title of nearly sixty characters, so that four more do &amp"]


def page(i, title):
    text = f"{title} and the words of paragraph {i}. " + "word " * (194 if i == 10 else 20)
    return (
        i, f"https://{'www.' * (i % 2)}s.example/en/{i}", f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{title}</title><style>p{{margin:0}}</style><script>var t="</p>&amp";</script></head>'
        f'<body><nav><ul><li><a href="/x{i}">x</a></li></ul></nav><!-- ad &amp --><div class="ad">An ad of five words.</div><article><h1>{title}</h1><p><b>{text}</b><br>more</p></article><footer>&copy; s.example &middot; Foot</footer></body></html>',
    )


@pytest.fixture(scope="module")
def cut(tmp_path_factory, spark):
    d = str(tmp_path_factory.mktemp("cut"))
    spark.createDataFrame([page(i, t) for i, t in enumerate(CUT)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{d}/pages.parquet")
    return d


def equal(spark, d, name):
    import duckdb

    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{d}/pages.parquet/*.parquet'")
    want = db.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(tuple, entry.queries()[name](spark, d).select(columns).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_only_complete_references_are_decoded():
    title = lambda t: parsed(f"<title>{t}</title>", None, ("seo",))["seo"]["title"]
    assert [title(t) for t in ("a &amp", "a &ampb;", "&notit;", "&amp;copy;", "&copy; &lt;b&gt; &#38; &#x26;", "R&D", "\ue000 &amp")] == ["a &amp", "a &ampb;", "&notit;", "&copy;", "© <b> & &", "R&D", "\ue000 &amp"]
    html = '<a href="/x?a=1&copy=2&amp;b=3" &lt="&quot">t</a><script>u = "&amp;&copy=1"</script><p>x &amp'
    a, script, p = Page(html).order
    assert a.attrs == {"href": "/x?a=1&copy=2&b=3", "&lt": "&quot"} and script.inside == ['u = "&amp;&copy=1"'] and text_of(p) == "x &amp"


@pytest.mark.parametrize("name", ["full_audit", "chunks", "headings", "page_titles", "title_brand", "title_length_findings", "visible_word_counts", "metric_breakdown", "severity_breakdown", "top_metrics"])
def test_cut_references_as_in_sql(spark, cut, name):
    equal(spark, cut, name)


@pytest.mark.parametrize("name", ["headings", "page_titles"])
def test_pages_without_title_or_h1_as_in_sql(spark, tmp_path, name):
    rows = [(1, "<html><head></head><body><p>Neither title nor heading</p></body></html>"), (2, "<html><head><title></title></head><body><h2>Before</h2><h1>After</h1></body></html>"), (3, "<title>Only h2</title><h2>x</h2>")]
    spark.createDataFrame([(i, f"https://a.example/{i}", h) for i, h in rows], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    equal(spark, str(tmp_path), name)
