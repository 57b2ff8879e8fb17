import http.server
import json
import threading
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from webquarry import cli
from webquarry.functions import identity as fn
from webquarry.functions import questions as qf
from webquarry.operators import audit, crawl, identity, qa
from webquarry.operators import pages as p
from webquarry.sources import web

from .conftest import response

CLINIC = """<html><head><title>Best Dental | ABC Dental</title><meta property="og:site_name" content="ABC Dental Pvt. Ltd.">
<script type="application/ld+json">{"@graph": [{"@type": "Dentist", "name": "no"}, {"@type": "LocalBusiness", "name": "ABC Dental", "telephone": "+91 98765 43210", "address": {"streetAddress": "12 MG Rd.", "addressLocality": "Hyderabad", "postalCode": "500001"}}]}</script>
<script type="application/ld+json">broken {</script></head>
<body><header><a class="navbar-brand" href="/">ABC Dental Care</a><img alt="ABC Clinic" src="l.png"><img alt="logo" src="m.png"></header>
<div class="card"><a class="site-title">Other Corp</a></div><h1>Contact</h1><p>Phone: 098765 43210 or call 99999 88888</p><a href="tel:+919876543210">ring</a><a href="https://wa.me/919876543210">WA</a>
<address>12 MG Road, Hyderabad, 500001</address><p>Office: 44 Lake View, Secunderabad</p>
<div itemscope itemtype="https://schema.org/Organization"><span itemprop="name">First</span><span itemprop="name">Last LLC</span><span itemprop="">x</span><meta itemprop="telephone" content="+1 212"></div></body></html>"""


def test_occurrences(parse):
    rows = identity.occurrences(parse(response(0, "https://abc.example.in/contact", CLINIC))).orderBy("ord").collect()
    got = [(r.field, r.raw, r.normal, r.source_type) for r in rows]
    assert got == [
        ("name", "ABC Dental", "abc dental", "json_ld"), ("phone", "+91 98765 43210", "919876543210", "json_ld"), ("address", "12 MG Rd., Hyderabad, 500001", "12 mg road, hyderabad, 500001", "json_ld"),
        ("name", "Last LLC", "last", "microdata"), ("phone", "+1 212", "1212", "microdata"),
        ("phone", "+919876543210", "919876543210", "html_tel_link"), ("phone", "99999 88888", "919999988888", "html_labeled_phone"),
        ("address", "12 MG Road, Hyderabad, 500001", "12 mg road, hyderabad, 500001", "html_address_tag"), ("address", "44 Lake View, Secunderabad", "44 lake view, secunderabad", "html_labeled_address"),
        ("name", "ABC Dental Pvt. Ltd.", "abc dental", "html_og_site_name"), ("name", "ABC Dental Care", "abc dental care", "html_brand_element"), ("name", "ABC Clinic", "abc clinic", "html_logo_alt"),
    ]


def test_reports_without_groups(spark, parse):
    rows = {r.field: r for r in identity.reports(identity.occurrences(parse(response(0, "https://abc.example.in/", CLINIC)))).collect()}
    assert rows["phone"].verdict == "genuine_mismatch" and rows["name"].verdict == "genuine_mismatch" and rows["address"].verdict == "genuine_mismatch"
    none = {r.field: (r.verdict, r.confidence) for r in identity.reports(identity.occurrences(parse(response(0, "https://a.example/", "<p>x</p>")))).collect()}
    assert none == {f: ("not_found", 0.0) for f in ("name", "address", "phone")}


def test_canonical_phones_are_not_suffixes(spark):
    v = ["919876543210", "9876543210", "543210", "12125551234", "2125551234", "7", "70"]
    df = spark.createDataFrame([(x,) for x in v], "normal string")
    assert {r.normal for r in identity.canonical_phones(df, []).collect()} == {x for x in v if not any(y != x and y.endswith(x) for y in v)}


def test_likeness_is_the_matching_block_ratio(spark):
    pairs = [("12 mg road", "12 mg rd"), ("", ""), ("abc", "xyz"), ("a" * 250 + "b", "b" + "a" * 250)]
    got = [r.x for r in spark.createDataFrame(pairs, "a string, b string").select(fn.likeness("a", "b").alias("x")).collect()]
    assert got == [SequenceMatcher(None, a, b).ratio() for a, b in pairs]


SITE = [
    (0, "https://acme.example/", "<body><header><p>Acme Vault top banner text</p></header><h1>Acme Vault</h1><h2>What we do</h2><p>Acme Vault is a tool that encrypts backups for small teams. It works offline.</p><p>People love working in Acme Vault every day.</p><p>Many of our users keep photos there.</p></body>", 0),
    (1, "https://acme.example/pricing", "<body><h1>Pricing</h1><p>The team plan costs 12 dollars per month and the pro plan costs 30 dollars.</p><div><div><p>Backups are stored in two regions.</p></div></div></body>", 1),
    (2, "https://acme.example/contact", "<body><h1>Contact us</h1><p>Our office is located at 12 Main Street, Springfield 50001.</p></body>", 1),
    (3, "https://acme.example/terms", "<body><h1>Terms</h1><p>Any dispute is subject to the exclusive jurisdiction of courts located in Paris office.</p></body>", 1),
]


def test_chunks(responses):
    rows = qa.chunks(responses(*[response(i, u, h, depth=d) for i, u, h, d in SITE])).orderBy("page_ord", "chunk_id").collect()
    first = [r for r in rows if r.page_ord == 0]
    assert [(r.tag, r.is_boilerplate, len(r.headings)) for r in first] == [("p", True, 0), ("h1", False, 1), ("h2", False, 2), ("p", False, 2), ("p", False, 2), ("p", False, 2)]
    assert [r.text for r in rows if r.page_ord == 1 and r.tag != "h1"][1] == "Backups are stored in two regions."


def test_answers(spark, responses):
    qs = ["What is Acme Vault?", "How much does the team plan cost?", "Where is the office located?", "What is quantum gravity?", "what is it", "Tell me about dragons and wizards"]
    df = spark.createDataFrame(list(enumerate(qs)), "qid long, question string")
    got = [r for r in qa.answers(responses(*[response(i, u, h, depth=d) for i, u, h, d in SITE]), df).orderBy("qid").collect()]
    assert [r.url and r.url.rsplit("/", 1)[1] for r in got] == ["", "pricing", "contact", None, None, None]
    assert got[0].excerpt.startswith("Acme Vault is a tool") and got[3].confidence == 0.0 and 0 < got[0].confidence <= 1


def analysed(spark, *questions):
    df = spark.createDataFrame([(x,) for x in questions], "question string").select(qf.analyse(F.col("question")).alias("q"))
    return [r.q for r in df.collect()]


def test_question_analysis(spark):
    q, many, none = analysed(spark, 'What is the "blue whale" used for?', "red engine trains run", "can you tell me about the it?")
    assert (q.intent, q.subject) == ("DEFINITION", '"blue whale"') and q.phrases[0] == '"blue whale"' and "blue whale" in q.phrases
    assert many.phrases == ["red engine", "red engine trains", "engine trains", "engine trains run", "trains run"] and many.subject_pattern == ""
    assert many.search == ["red", "engine", "trains", "run", "train"] and many.stems == ["red", "engine", "train", "run"]
    assert [x.intent for x in analysed(spark, "how much is it", "where is the lab", "how do i apply", "our founder", "eligibility rules", "red cars")] == ["PRICE_COST", "LOCATION", "PROCEDURAL", "LEADERSHIP_ABOUT", "REQUIREMENTS", "GENERAL"]
    empty, = analysed(spark, None)
    assert none.terms == [] and none.pronouns == ["it"] and empty.terms == [] and empty.phrases == [] and empty.intent == "GENERAL"
    what, = analysed(spark, "What is a c++ .net runtime?")
    assert what.subject == "c++ .net runtime" and what.subject_pattern == r"\Qc++ .net runtime\E|\Q.net runtime\E|\Qc++ .net\E"


def test_excerpt(spark):
    first, best, after = "Nothing is here. " * 6, "The red engine pulls heavy trains over the hills. ", "It never stops. "
    rows = spark.createDataFrame([(first + best + after + "Filler text goes on and on. " * 9, "red engine trains"), ("short one", "x")], "text string, question string").withColumn("q", qf.analyse(F.col("question")))
    got = [r.e for r in rows.select(qa.excerpt(F.col("text"), F.col("q")).alias("e")).collect()]
    assert got == [(best + after).strip(), "short one"]


def test_crawl(spark):
    def page(u, *links, status=200):
        return (u, u, status, {}, "".join(f"<a href='{x}'>l</a>" for x in links), [], None)

    schema = "requested_url string, final_url string, status int, headers map<string,string>, content string, redirect_chain array<string>, error string"
    web_ = spark.createDataFrame([page("https://s.example/", "/a", "/b", "/private/x", "/missing", "https://o.example/"), page("https://s.example/a", "/", "/c"), page("https://s.example/b"), page("https://s.example/c", "/d"), page("https://s.example/d"), page("https://s.example/private/x")], schema)
    robots = spark.createDataFrame([("https://s.example", "User-agent: *\nDisallow: /private/")], "origin string, body string")
    why: list = []
    got = crawl.crawl(web_, "s.example", audit.AuditConfig(max_depth=2), robots, why).orderBy("page_ord").collect()
    assert [(r.final_url[17:], r.depth, r.status) for r in got] == [("/", 0, 200), ("/a", 1, 200), ("/b", 1, 200), ("/missing", 1, 0), ("/c", 2, 200)]
    assert {r.reason: r.links for r in why[0].collect()} == {"candidate": 3, "robots": 1, "external": 1}
    few = crawl.crawl(web_, "https://s.example", audit.AuditConfig(max_pages=2)).orderBy("page_ord").collect()
    assert [r.final_url for r in few] == ["https://s.example/", "https://s.example/a"]
    flagged = crawl.crawl(web_, "https://s.example/private/x", audit.AuditConfig(max_depth=0), robots).first()
    assert flagged.robots_disallowed


class Site(http.server.BaseHTTPRequestHandler):
    """A small site; ``asked`` collects (method, path)."""

    asked: list = []
    answers = {
        "/": (200, '<title>é</title><a href="/a">a</a><a href="/private/x">p</a><a href="/moved">m</a><img src="/i.png" alt="x"><img src="/gone.png" alt="y"><img src="/odd.png" alt="z">'),
        "/a": (200, "<title>a</title><p>The office is located at 12 Main Street, Springfield 50001.</p>"), "/private/x": (200, "<title>x</title>"),
        "/robots.txt": (200, "User-agent: *\nDisallow: /private/"), "/i.png": (200, ""), "/odd.png": (200, ""),
    }

    def do_GET(self):
        self.asked.append((self.command, self.path))
        status, body = self.answers.get(self.path, (404, ""))
        if self.path == "/moved":
            self.send_response(301)
            self.send_header("Location", "/")
        elif self.path == "/odd.png" and self.command == "HEAD":
            self.send_response(405)
        else:
            self.send_response(status)
            self.send_header("Content-Type", "text/html; charset=utf-8")
        self.end_headers()
        if self.command == "GET":
            self.wfile.write(body.encode())

    do_HEAD = do_GET

    def log_message(self, *a):
        pass


@pytest.fixture()
def site():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Site.asked.clear()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_live_fetch(spark, site):
    targets = spark.createDataFrame([(0, site + "/", 0, False), (1, site + "/moved", 1, True), (2, site + "/none", 1, False), (3, "http://127.0.0.1:9/", 1, False)], "page_ord long, url string, depth int, robots_disallowed boolean")
    got = web.fetch_all(targets, web.Client(timeout=3, delay=0)).orderBy("page_ord").collect()
    assert [r.title for r in p.parsed_pages(web.fetch_all(targets.limit(1), web.Client(delay=0))).collect()] == ["é"]
    assert [r.status for r in got] == [200, 200, 404, 0] and got[0].content.startswith("<title>é</title>") and got[1].redirect_chain == [site + "/moved"] and got[1].robots_disallowed and got[3].error


def test_robots_files_by_status(spark, site, monkeypatch):
    client = web.Client(timeout=3, delay=0)
    rows = lambda *o: {r.origin: r.body for r in web.fetch_robots(spark.createDataFrame([(x,) for x in o], "origin string"), client).collect()}
    assert rows(site, site, "http://127.0.0.1:9") == {site: Site.answers["/robots.txt"][1], "http://127.0.0.1:9": None}
    for status, tries in ((404, 1), (410, 1), (503, 2), (401, 2)):
        monkeypatch.setitem(Site.answers, "/robots.txt", (status, "User-agent: *\nDisallow: /"))
        Site.asked.clear()
        assert rows(site) == {site: None} and len(Site.asked) == tries


def test_live_command_line(spark, site, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    live = ["--url", site, "--delay", "0", "--timeout", "3"]
    assert cli.main(live, spark) == 0
    found = {(r["metric"], r["page"].removeprefix(site)) for r in json.loads((tmp_path / "outputs/audit.json").read_text())}
    summary = json.loads((tmp_path / "outputs/audit_summary.json").read_text())
    assert [u.removeprefix(site) for u in summary["urls"]] == ["", "/a", "/"] and ("GET", "/private/x") not in Site.asked
    assert ("broken_image", "") in found and ("HEAD", "/gone.png") in Site.asked and ("GET", "/odd.png") in Site.asked
    assert len([r for r in json.loads((tmp_path / "outputs/audit.json").read_text()) if r["metric"] == "broken_image" and r["page"] == site]) == 1
    assert cli.main([*live, "--ignore-robots", "--no-ssl-verify", "--verbose", "--query", "Where is the office located?", "--answer-file", "own/answer.json"], spark) == 0
    assert ("GET", "/private/x") in Site.asked and json.loads((tmp_path / "own/answer.json").read_text())["url"] == site + "/a"
    assert "12 Main Street" in capsys.readouterr().out
    assert cli.main([*live, "--nap"], spark) == 0 and "address" in capsys.readouterr().out


def test_script_only_pages_are_rendered(spark):
    schema = "requested_url string, final_url string, status int, headers map<string,string>, content string, redirect_chain array<string>, error string"
    shell = '<body><div id="root"></div></body>'
    rows = [("https://s.example/", "https://s.example/", 200, {}, shell, [], None), ("https://s.example/b", "https://s.example/b", 200, {}, "<title>b</title>" + shell.replace("root", "main"), [], None)]
    asked: list = []

    def render(shells):
        asked.extend(r.url for r in shells.collect())
        return shells.withColumn("rendered_html", F.lit('<title>made</title><a href="/b">b</a>'))

    got = crawl.crawl(spark.createDataFrame(rows, schema), "https://s.example", render=render, spark=spark).orderBy("page_ord").collect()
    assert [r.title for r in got] == ["made", "b"] and asked == ["https://s.example/"]


def test_command_line(spark, sf, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    spark.read.parquet(f"{sf}/pages.parquet").limit(4).write.parquet(f"{tmp_path}/pages")
    assert cli.main(["--pages", f"{tmp_path}/pages"], spark) == 0
    assert len(json.loads((tmp_path / "outputs/audit.json").read_text())) >= 16
    assert cli.main(["--pages", f"{tmp_path}/pages", "--nap", "--query", "x"], spark) == 0
    assert [r["field"] for r in json.loads((tmp_path / "outputs/nap_report.json").read_text())] == ["name", "address", "phone"]
    assert cli.main(["--pages", f"{tmp_path}/pages", "--query", "What is zyzzyva quux?"], spark) == 0
    assert json.loads((tmp_path / "outputs/answer.json").read_text()) == {"query": "What is zyzzyva quux?", "url": None, "excerpt": None}
    spark.read.parquet(f"{sf}/pages.parquet").limit(0).write.parquet(f"{tmp_path}/none")
    assert cli.main(["--pages", f"{tmp_path}/none"], spark) == 1
