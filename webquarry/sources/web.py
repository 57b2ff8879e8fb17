"""Sources of responses: tables of raw pages, and live http fetches for those who have a network."""

from __future__ import annotations

import ssl
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..operators.pages import RESPONSE, image_targets, responses_from_pages


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table page_id, url, html as responses; only these columns are read."""
    return responses_from_pages(spark.read.parquet(path).select("page_id", "url", "html"))


class _Hops(urllib.request.HTTPRedirectHandler):
    def __init__(self):
        self.chain: list[str] = []

    def redirect_request(self, req, fp, code, msg, headers, newurl):
        self.chain.append(req.full_url)
        return super().redirect_request(req, fp, code, msg, headers, newurl)


@dataclass(frozen=True)
class Client:
    """How addresses are fetched."""

    timeout: float = 10.0
    delay: float = 0.1
    agent: str = "webquarry"
    verify: bool = True

    def open(self, url: str, method: str = "GET", timeout: float | None = None):
        """(answer, redirect chain); error statuses are answers too, other failures raise."""
        hops, context = _Hops(), ssl.create_default_context()
        if not self.verify:
            context.check_hostname, context.verify_mode = False, ssl.CERT_NONE
        ask = urllib.request.Request(url, headers={"User-Agent": self.agent}, method=method)
        try:
            return urllib.request.build_opener(hops, urllib.request.HTTPSHandler(context=context)).open(ask, timeout=timeout or self.timeout), hops.chain
        except urllib.error.HTTPError as e:
            return e, hops.chain


def fetch(url: str, client: Client) -> dict:
    """One GET with redirects; the body only of html answers; failures have status 0 and the error's text."""
    row = {"requested_url": url, "final_url": url, "status": 0, "headers": {}, "content": "", "redirect_chain": [], "error": None}
    try:
        answer, chain = client.open(url)
        with answer as r:
            return row | _answer(r) | {"redirect_chain": chain}
    except Exception as e:
        return row | {"error": str(e) or type(e).__name__}


def _answer(r) -> dict:
    headers = {k.lower(): v for k, v in r.headers.items()}
    kind = headers.get("content-type", "").lower()
    html = not kind or "html" in kind
    return {"final_url": r.geturl(), "status": r.status, "headers": headers, "content": r.read().decode(r.headers.get_content_charset() or "utf-8", "replace") if html else ""}


def by_host(targets: DataFrame, make: Callable[[str], dict | None], schema: str, delay: float, keep: tuple[str, ...] = ()) -> DataFrame:
    """``make(url)`` for every ``url``, with the columns ``keep``; a host's addresses share a task, with a pause between. No row for None."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for i, r in enumerate(f.itertuples()):
                if i:
                    time.sleep(delay)
                if got := make(r.url):
                    rows.append(got | {k: getattr(r, k) for k in keep})
            yield pd.DataFrame(rows, columns=names)

    return targets.select("url", *keep).repartition(urls.host(F.col("url"))).mapInPandas(run, schema)


def fetch_all(targets: DataFrame, client: Client = Client()) -> DataFrame:
    """Fetch the addresses of ``targets`` (page_ord, url, depth, robots_disallowed)."""
    return by_host(targets, lambda url: fetch(url, client), RESPONSE, client.delay, ("page_ord", "depth", "robots_disallowed"))


def robots_body(origin: str, client: Client) -> str | None:
    """An origin's robots.txt; None where there is none (404, 410), or none to be had in two tries: all is allowed then."""
    for timeout in (client.timeout, max(client.timeout, 10.0)):
        try:
            answer, _ = client.open(origin + "/robots.txt", timeout=timeout)
            with answer as r:
                if r.status == 200:
                    return r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")
                if r.status in (404, 410):
                    return None
        except Exception:  # unreachable: the second try decides
            continue
    return None


def fetch_robots(origins: DataFrame, client: Client = Client()) -> DataFrame:
    """``origin``, ``body`` (null: all allowed) for each distinct ``origin``."""
    targets = origins.select(F.col("origin").alias("url")).where("url IS NOT NULL").distinct()
    return by_host(targets, lambda url: {"origin": url, "body": robots_body(url, client)}, "origin string, body string", client.delay)


def image_status(url: str, client: Client) -> int | None:
    """Status of a HEAD, or of a GET where HEAD isn't allowed; None if nothing answers."""
    try:
        for method in ("HEAD", "GET"):
            answer, _ = client.open(url, method, timeout=5.0)
            with answer as r:
                if method == "GET" or r.status != 405:
                    return r.status
    except Exception:
        return None


def probe_images(pages: DataFrame, client: Client = Client(), per_page: int = 15) -> DataFrame:
    """``url``, ``status`` of the images that the audit looks at, each asked for once; none for those that don't answer."""
    targets = image_targets(pages, per_page).select("url").distinct()
    return by_host(targets, lambda url: (n := image_status(url, client)) and {"url": url, "status": n}, "url string, status int", client.delay)
