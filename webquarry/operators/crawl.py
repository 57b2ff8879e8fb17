"""Breadth-first crawl over a relation of responses, level by level.

A level is one join of the frontier with the responses, one narrow parse, one explode of links and one
anti-join with the addresses seen; order inside a level is (parent's place, link's place), which makes
it equal to a first-in-first-out queue. Redirects to one final page are all kept.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from urllib.robotparser import RobotFileParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import urls
from ..plans.work import settled
from .audit import AuditConfig
from .pages import RESPONSE, link_edges, parsed_pages, spa_shell, success

AGENT = "Mozilla/5.0 (compatible; webquarry)"


@lru_cache(maxsize=256)
def rules_of(body: str) -> RobotFileParser | None:
    """The rules of a robots.txt, parsed once in a worker; None if it can't be read."""
    rules = RobotFileParser()
    try:
        rules.parse(body.splitlines())
    except Exception:
        return None
    return rules


def may_fetch(body: str | None, url: str | None, agent: str = AGENT) -> bool:
    """The robots.txt rule of ``body`` for url; no file, or one that can't be read, allows all."""
    rules = rules_of(body) if body and url else None
    return rules is None or rules.can_fetch(agent, url)


def allowed(body, url, agent: str = AGENT):
    @F.arrow_udf(T.BooleanType())
    def run(bodies: pa.Array, us: pa.Array) -> pa.Array:
        return pa.array([may_fetch(b, u, agent) for b, u in zip(bodies.to_pylist(), us.to_pylist())])

    return run(body, url)


def origin(url):
    return F.concat(urls.scheme(url), F.lit("://"), F.lower(urls.part(url, 2)))


def with_robots(df: DataFrame, robots: DataFrame | None, col: str = "final_url", out: str = "robots_ok") -> DataFrame:
    """Adds whether robots.txt allows ``col``; robots has origin and body, one row for each origin."""
    if robots is None:
        return df.withColumn(out, F.lit(True))
    rows = df.withColumn("_origin", origin(F.col(col)))
    dim = robots.groupBy(F.col("origin").alias("_origin")).agg(F.max("body").alias("_body"))
    return rows.join(dim, "_origin", "left").withColumn(out, allowed("_body", col)).drop("_origin", "_body")


#: Fetches (page_ord, url, depth, robots_disallowed) as responses; robots files of (origin) as (origin, body); final pages of (url) as (url, rendered_html).
Fetcher = Callable[[DataFrame], DataFrame]


class Robots:
    """The robots files met so far: a table, or fetched for each origin when it is first met."""

    def __init__(self, source: DataFrame | Fetcher | None):
        self.fetch, self.table = (source, None) if callable(source) else (None, source)

    def judge(self, df: DataFrame, col: str) -> DataFrame:
        if self.fetch is not None:
            new = df.select(origin(F.col(col)).alias("origin")).where("origin RLIKE '^https?://.'").distinct()
            if self.table is not None:
                new = new.join(self.table, "origin", "left_anti")
            got = self.fetch(new)
            self.table = settled(got if self.table is None else self.table.unionByName(got), "robots")
        return with_robots(df, self.table, col)


def crawl(
    responses: DataFrame | Fetcher, start_url: str, cfg: AuditConfig = AuditConfig(), robots: DataFrame | Fetcher | None = None, diagnostics: list | None = None,
    more: tuple[str, ...] = (), render: Fetcher | None = None, spark: SparkSession | None = None,
) -> DataFrame:
    """Parsed pages in crawl order (``page_ord`` from 0, ``depth``), at most ``max_pages``.

    responses stand for the web: one row for each requested address, addresses without a row are failures with
    status 0; or a function that fetches a level's addresses. robots likewise is a table of origins, or a function that fetches
    the files of origins not met before. The start page is fetched and flagged even where robots.txt disallows it. Links count if
    internal, pages by their ending, without path loops, allowed, and not seen before. ``diagnostics``
    collects, for each level, a table of links by reason. Script-only pages (``spa_shell``) are parsed as ``render`` gives them.
    ``more`` are further families of the parser.
    """
    spark = spark or SparkSession.active()
    live = callable(responses)
    known = Robots(robots)
    norm = lambda c: urls.normalize(c, cfg.tracking)
    web = None if live else responses.drop("page_ord", "depth", "robots_disallowed").withColumn("norm", norm(F.col("requested_url"))).dropDuplicates(["norm"])
    frontier = spark.createDataFrame([(start_url, 0)], "url string, place long").select(urls.ensure_scheme(F.col("url")).alias("url"), norm(F.col("url")).alias("norm"), "place")
    frontier = known.judge(frontier, "url")
    seen, pages, count = frontier.select("norm"), None, 0
    for depth in range(cfg.max_depth + 1):
        room = cfg.max_pages - count
        if room <= 0:
            break
        level = frontier.orderBy("place").limit(room).withColumn("page_ord", (F.row_number().over(Window.orderBy("place")) - 1 + count).cast("long"))
        if live:
            fetched = responses(level.select("page_ord", "url", F.lit(depth).alias("depth"), (~F.col("robots_ok")).alias("robots_disallowed")))
        rows = fetched if live else level.join(web, "norm", "left").select(
            "page_ord", F.coalesce("requested_url", "url").alias("requested_url"), F.coalesce("final_url", "url").alias("final_url"),
            F.coalesce("status", F.lit(0)).alias("status"), F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"), F.coalesce("content", F.lit("")).alias("content"),
            F.coalesce("redirect_chain", F.array().cast("array<string>")).alias("redirect_chain"), F.lit(depth).alias("depth"),
            F.when(F.col("status").isNull(), "no response").otherwise(F.col("error")).alias("error"), (~F.col("robots_ok")).alias("robots_disallowed"),
        )
        if render is not None:
            rows = settled(rows, "crawl-fetched")
            shells = rows.where(success() & spa_shell(F.col("content"))).select(F.col("final_url").alias("url")).distinct()
            rows = rows.join(render(shells).withColumnRenamed("url", "final_url"), "final_url", "left").select(*rows.columns, "rendered_html")
        got = settled(parsed_pages(rows, *more), "crawl")
        n = got.count()
        if not n:
            break
        count += n
        pages = got if pages is None else pages.unionByName(got)
        seen = settled(seen.unionByName(got.select(norm(F.col("final_url")).alias("norm"))).distinct(), "crawl-seen")
        if depth == cfg.max_depth:
            break
        links = link_edges(got.where(success())).withColumn("norm", norm(F.col("resolved")))
        links = known.judge(links, "resolved")
        reason = (
            F.when(F.coalesce("resolved", F.lit("")) == "", "not a link").when(~F.col("is_internal"), "external").when(~urls.is_page(F.col("resolved")), "asset")
            .when(urls.loops(F.col("resolved")), "loop").when(~F.col("robots_ok"), "robots").otherwise("candidate")
        )
        links = links.withColumn("reason", reason)
        if diagnostics is not None:
            diagnostics.append(links.groupBy("src", "reason").agg(F.count("*").alias("links")))
        new = links.where("reason = 'candidate'").join(seen, "norm", "left_anti")
        # A shorter path to the frontier than all its links: the first link of each address, in order.
        new = new.groupBy("norm").agg(F.min(F.struct("page_ord", "link_pos", "resolved")).alias("m"))
        new = new.orderBy("m").limit(max(0, cfg.max_pages - count))
        frontier = settled(new.select(F.col("m.resolved").alias("url"), "norm", (F.row_number().over(Window.orderBy("m")) - 1).cast("long").alias("place"), F.lit(True).alias("robots_ok")), "crawl-frontier")
        seen = settled(seen.unionByName(frontier.select("norm")).distinct(), "crawl-seen")
    return pages if pages is not None else parsed_pages(spark.createDataFrame([], RESPONSE), *more)
