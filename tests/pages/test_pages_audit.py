import json

from webquarry.functions.dom import Page, parsed, text_of
from webquarry.operators import audit
from webquarry.sinks import reports
from webquarry.streaming import pages as stream

from .conftest import response

FULL = """<!doctype html><html lang=" en "><head><title> A title &amp; more </title><meta name="description" content="first"><meta name="description" content="second">
<meta name="viewport" content="x"><meta name="Viewport" content="width=device-width"><meta name="robots" content="noindex, follow"><meta property="og:title" content="O"><meta property="og:title" content="P">
<meta name="twitter:card" content="c"><link rel="Canonical" href="/home"></head>
<body><header><h1>Head</h1></header><p>One two <b>three<p>four five six<h3>Jump</h3><img src="/i.png"><img src="data:x" alt=""><a href="/in?utm_source=q">In</a><a href="https://o.example/">Out</a><a href="#f">F</a><a>none</a>
<script src="http://a.example/s.js">var hidden</script><ul><li>a<li>b</ul></body></html>"""


def metrics(found):
    return sorted((r.metric, r.page) for r in found.collect())


def test_projections(parse):
    r = parse(response(0, "https://s.example/", FULL, headers={"X-Robots-Tag": "NoIndex"}), response(1, "https://s.example/e", FULL, 500), response(2, "https://s.example/n", "")).orderBy("page_ord").collect()
    p = r[0]
    assert (p.html_lang, p.title, p.meta_description, p.viewport, p.robots_meta) == ("en", "A title & more", "first", "width=device-width", ["noindex, follow"])
    assert p.open_graph == {"og:title": "P"} and p.twitter_cards == {"twitter:card": "c"} and p.x_robots_tag == ["NoIndex"]
    assert p.canonicals == ["https://s.example/home"] and [(h.level, h.text) for h in p.headings] == [(1, "Head"), (3, "Jump")]
    assert [(i.src, i.alt, i.has_alt, i.is_data_uri) for i in p.images] == [("/i.png", None, False, False), ("data:x", "", True, True)]
    assert [(x.href, x.is_internal, x.is_fragment) for x in p.links] == [("/in?utm_source=q", True, False), ("https://o.example/", False, False), ("#f", False, True), ("", False, False)]
    assert p.insecure == ['<script src="http://a.example/s.js">var hidden</script>']
    assert p.visible_snippet == "One two three four five six Jump In Out none" and p.visible_words == 10
    assert [x.title for x in r[1:]] == [None, None] and [x.links for x in r[1:]] == [[], []]


def texts(html, tag):
    return [text_of(e) for e in Page(html).order if e.tag == tag]


def test_tree():
    assert texts(FULL, "p") == ["One two three", "four five six"] and texts(FULL, "li") == ["a", "b"]
    li = next(e for e in Page(FULL).order if e.tag == "li")
    assert [li.parent.tag, li.parent.parent.tag, li.parent.parent.parent.tag] == ["ul", "body", "html"]
    assert parsed("") is None and parsed(None) is None and parsed("just text")["seo"]["visible"] == "just text"
    assert parsed("<p>" * 3000 + "x" + "</b></i>")["passages"]["body"] == "x"
    assert parsed("<table><tr><td>1<td>2<tr><td>3</table>")["contacts"]["strings"] == ["1", "2", "3"]


def test_projections_stay_slim():
    """Deep nesting makes no more output than the page has text, and takes time in proportion."""
    def size(x):
        return len(x) if isinstance(x, str) else sum(map(size, x.values() if isinstance(x, dict) else x)) if isinstance(x, dict | list | tuple) else 0

    for depth in (10, 400):
        html = "<div class='c'>" * depth + "".join(f"<p>word {i} of the text</p>" for i in range(200)) + "</div>" * depth
        for family in ("seo", "passages", "contacts"):
            assert size(parsed(html, "https://a.example/", (family,))) <= 2 * 200 * 24


def test_rules(parse):
    words = "<p>" + "word " * 250 + "</p>"
    title = "<title>A title that is long enough to pass</title>"
    base = f'<html lang="en"><head>{title}<meta name="description" content="{"d" * 100}"><meta name="viewport" content="width=device-width"><link rel="canonical" href="https://s.example/x">' + "".join(f'<meta property="og:{k}" content="v">' for k in ("title", "description", "image", "url")) + "</head><body><h1>H</h1>"
    f = audit.findings(parse(
        response(0, "https://s.example/ok", base + words + '<a href="/gone">g</a><a href="/gone">g</a><a href="/ok"></a></body></html>'),
        response(1, "https://s.example/gone", "", 404),
        response(2, "https://s.example/down", "", 0, error="timed out"),
        response(3, "https://s.example/err", "", 503),
        response(4, "https://s.example/moved", base.replace(title, "<title>Another title that is long enough</title>") + words, redirect_chain=["https://s.example/1", "https://s.example/2"]),
        response(5, "http://s.example/full", FULL, robots_disallowed=True),
        response(6, "https://s.example/bare", "<html lang=''><body></body></html>"),
        response(7, "https://s.example/twin", base.replace("A title", "a TITLE ").replace('content="dddd', 'content="Dddd').replace("TITLE  ", "TITLE ") + "<h1>Two</h1><h2> </h2><h4>x</h4>" + words),
    ))
    got = metrics(f)
    of = lambda page: [m for m, p in got if p == "https://s.example/" + page]
    assert of("ok") == ["broken_internal_link", "duplicate_meta_description", "duplicate_title", "empty_anchor_text"]
    assert of("gone") == ["http_client_error"] and of("down") == ["network_connection_error"] and of("err") == ["http_server_error"]
    assert of("moved") == ["duplicate_meta_description", "redirect_chain_excessive"]
    assert of("bare") == ["empty_content", "invalid_html_lang", "missing_canonical", "missing_h1", "missing_meta_description", "missing_open_graph", "missing_title", "missing_viewport"]
    assert of("twin") == ["duplicate_meta_description", "duplicate_title", "empty_heading", "heading_hierarchy_skipped", "multiple_h1"]
    full = [m for m, p in got if p == "http://s.example/full"]
    assert {"title_too_short", "meta_description_too_short", "robots_noindex", "robots_txt_disallowed", "heading_hierarchy_skipped", "missing_image_alt", "relative_canonical", "missing_href", "insecure_http", "missing_open_graph", "thin_content"} <= set(full)
    assert len(got) == len(set(got))
    ranks = [audit.RANKS.index(r.severity) for r in f.collect()]
    assert ranks == sorted(ranks)
    assert {m for m, _ in got} <= set(audit.SEVERITY)


def test_images_and_extra_rules(parse, spark):
    page = parse(response(0, "https://s.example/", "<html><body><h1>x</h1>" + "".join(f'<img alt="" src="/{i}.png">' for i in range(20))))
    assets = spark.createDataFrame([("https://s.example/3.png", 404), ("https://s.example/18.png", 500), ("https://s.example/1.png", 200)], "url string, status int")
    assert [r.evidence.split()[-1] for r in audit.findings(page, assets=assets).where("metric = 'broken_image'").collect()] == ["https://s.example/3.png"]
    rule = lambda p, cfg: p.selectExpr("page_ord", "9 AS rule", "named_struct('metric', 'own', 'page', final_url, 'severity', 'info', 'evidence', 'e', 'suggested_fix', 'f') AS f")
    assert audit.findings(page, rules=[rule]).where("metric = 'own'").count() == 1


def test_reports(parse, tmp_path):
    page = parse(response(0, "http://s.example/", FULL))
    f = audit.findings(page)
    n = reports.audit_report(f, f"{tmp_path}/a/audit.json")
    rows = json.loads((tmp_path / "a" / "audit.json").read_text())
    assert len(rows) == n == f.count() and set(rows[0]) == set(reports.FINDING)
    s = reports.audit_summary(f, page, 1.234, f"{tmp_path}/s.json")
    assert list(s["severity_counts"]) == list(audit.RANKS) and sum(s["severity_counts"].values()) == n == sum(s["metric_counts"].values())
    assert json.loads((tmp_path / "s.json").read_text())["urls"] == ["http://s.example/"]
    assert reports.audit_report(f.limit(0), f"{tmp_path}/e.json") == 0 and json.loads((tmp_path / "e.json").read_text()) == []


def test_stream(spark, tmp_path, sf):
    spark.read.parquet(f"{sf}/pages.parquet").limit(5).write.parquet(f"{tmp_path}/in")
    q = stream.stream_findings(stream.read_stream(spark, f"{tmp_path}/in")).writeStream.format("memory").queryName("stream_findings").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("stream_findings").where("metric = 'missing_viewport'").count() == 5
