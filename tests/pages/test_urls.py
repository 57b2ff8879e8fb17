import random
from urllib.parse import parse_qsl, urlencode, urlsplit

from pyspark.sql import functions as F

from webquarry.functions import urls

LINKS = ["HTTPS://WWW.Example.COM:443//a///b/?b=2&utm_source=x&a=1&a=0&c#frag", "example.com/x", "http://example.com:80", "https://e.com/p;v=1?x=%20y", "https://e.com/?", "https://e.com?REF=1&q=", "https://e.com/a?b=+c&b=~*", ""]


def test_normalize(spark):
    df = spark.createDataFrame([(x,) for x in LINKS], "u string")
    got = [r.n for r in df.select(urls.normalize(F.col("u")).alias("n")).collect()]
    assert got == ["https://www.example.com/a/b/?a=1&a=0&b=2&c=", "https://example.com/x", "http://example.com/", "https://e.com/p;v=1?x=+y", "https://e.com/", "https://e.com/?q=", "https://e.com/a?b=+c&b=~%2A", ""]
    again = [r.n for r in spark.createDataFrame([(x,) for x in got], "u string").select(urls.normalize(F.col("u")).alias("n")).collect()]
    assert again == got


def test_query_matches_standard_library(spark):
    rng = random.Random(0)
    qs = ["&".join(f"{rng.choice(['a', 'b', 'utm_term', 'é', 'x y', '%zz'])}={rng.choice(['1', '', '%2F', 'ü', 'a b', '~*'])}" for _ in range(rng.randrange(6))) for _ in range(60)]
    want = [urlencode(sorted((p for p in parse_qsl(x, keep_blank_values=True) if p[0].lower() not in urls.TRACKING), key=lambda p: p[0])) for x in qs]
    got = spark.createDataFrame(list(enumerate(qs)), "i int, q string").select("i", urls.normal_query(F.col("q")).alias("n")).orderBy("i").collect()
    assert [r.n for r in got] == want


def test_sites_pages_loops(spark):
    rows = [("https://www.a.com/x", "http://a.com:8080/y", True), ("https://a.com", "https://b.a.com", False), ("", "https://a.com", False), (None, "https://a.com", False)]
    df = spark.createDataFrame(rows, "a string, b string, same boolean")
    assert [r.s for r in df.select(urls.same_site(F.col("a"), F.col("b")).alias("s")).collect()] == [x[2] for x in rows]
    assert urls.joined("https://a.com/x/", "../b") == "https://a.com/b" and urls.joined("https://a.com", "tel:1") is None
    assert urlsplit(urls.joined("http://a.com", "//c.com/d")).netloc == "c.com"
