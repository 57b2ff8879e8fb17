import pytest

from webquarry.operators import pages as p

SCHEMA = "page_ord long, requested_url string, final_url string, status int, headers map<string,string>, content string, redirect_chain array<string>, depth int, error string, robots_disallowed boolean"


def response(ord_, url, html="", status=200, **kw):
    row = {"requested_url": url, "final_url": url, "status": status, "headers": {}, "content": html, "redirect_chain": [], "depth": 0, "error": None, "robots_disallowed": False} | kw
    return (ord_, *[row[c.split()[0]] for c in SCHEMA.split(", ")[1:]])


@pytest.fixture()
def parse(spark):
    return lambda *rows: p.parsed_pages(spark.createDataFrame(list(rows), SCHEMA), "contacts")


@pytest.fixture()
def responses(spark):
    return lambda *rows: spark.createDataFrame(list(rows), SCHEMA)
