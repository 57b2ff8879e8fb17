"""Command line: audit (default), --nap, or --query over a live site, a table of pages, or a crawl of that table's links."""

from __future__ import annotations

import argparse
import logging
import time

from pyspark.sql import DataFrame, SparkSession

from .operators import audit, crawl, identity, pages, qa
from .operators.audit import AuditConfig
from .plans.work import settled
from .sinks import reports
from .sources import web


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="webquarry", description=__doc__)
    p.add_argument("--url", help="start address; without --pages, of a live site")
    p.add_argument("--pages", help="Parquet table page_id, url, html; with --url, its link graph is crawled from there")
    p.add_argument("--max-pages", type=int, default=25)
    p.add_argument("--max-depth", type=int, default=3)
    p.add_argument("--timeout", type=float, default=10.0, help="seconds for a live answer")
    p.add_argument("--delay", type=float, default=0.1, help="seconds between live requests to a host")
    p.add_argument("--ignore-robots", action="store_true")
    p.add_argument("--no-ssl-verify", action="store_true")
    p.add_argument("--verbose", "-v", action="store_true", help="log what each level of the crawl left out, and why")
    p.add_argument("--output", default="outputs/audit.json")
    p.add_argument("--answer-file", default="outputs/answer.json")
    p.add_argument("--nap", action="store_true", help="name, address and phone consistency (wins over --query)")
    p.add_argument("--query", "-q", help="answer a question from the pages")
    a = p.parse_args(argv)
    if not a.url and not a.pages:
        p.error("--url or --pages is needed")
    return a


def collected(spark: SparkSession, a: argparse.Namespace, cfg: AuditConfig, client: web.Client) -> DataFrame:
    """The parsed pages that the arguments name."""
    more = ("contacts",) if a.nap else ("passages",) if a.query else ()
    if not a.url:
        return settled(pages.parsed_pages(web.read_pages(spark, a.pages), *more), "pages")
    left_out: list[DataFrame] | None = [] if a.verbose else None
    if a.pages:
        got = crawl.crawl(web.read_pages(spark, a.pages), a.url, cfg, None, left_out, more)
    else:
        robots = None if a.ignore_robots else lambda origins: web.fetch_robots(origins, client)
        got = crawl.crawl(lambda level: web.fetch_all(level, client), a.url, cfg, robots, left_out, more, spark=spark)
    for depth, links in enumerate(left_out or []):
        for r in links.groupBy("reason").sum("links").collect():
            logging.getLogger("webquarry").info("depth %d: %d links: %s", depth, r[1], r["reason"])
    return settled(got, "pages")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0, or 1 where there are no pages."""
    a = arguments(argv)
    logging.basicConfig(level=logging.INFO if a.verbose else logging.WARNING)
    spark = spark or SparkSession.builder.appName("webquarry").getOrCreate()
    began = time.time()
    cfg = AuditConfig(max_pages=a.max_pages, max_depth=a.max_depth)
    client = web.Client(a.timeout, a.delay, crawl.AGENT, not a.no_ssl_verify)
    got = collected(spark, a, cfg, client)
    if not got.take(1):
        return 1
    if a.nap:
        path = "outputs/nap_report.json" if a.output == "outputs/audit.json" else a.output
        found = settled(identity.reports(identity.occurrences(got)), "reports")
        reports.identity_report(found, path)
        reports.print_identity(found, got.count(), time.time() - began, path)
    elif a.query:
        path = a.answer_file if a.output == "outputs/audit.json" else a.output
        said = qa.answer(spark, got, a.query, a.url)
        reports.answer_report(said, path)
        reports.print_answer(said, got.count(), time.time() - began, path)
    else:
        assets = None if a.pages else settled(web.probe_images(got, client, cfg.assets_per_page), "assets")
        found = settled(audit.findings(got, cfg, assets), "findings")
        found = found.orderBy(audit.severity_rank(found["severity"]), "page", "metric", "evidence")
        reports.audit_report(found, a.output)
        reports.print_summary(reports.audit_summary(found, got, time.time() - began, a.output.replace(".json", "_summary.json")), found)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
