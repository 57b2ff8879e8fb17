"""On-page quality audit: rules as filtered projections, site checks as aggregates, one findings table.

Page rules are an array of optional findings built in one projection over the parsed page, so all of them
run in a single narrow pass; parsed pages are written once, as site rules read them too. Site rules group by their key; a popular key is aggregated before it shuffles
and its findings come from a join on the key, so that no task holds a whole group.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.text import and_more, samples, snippet, strip
from ..plans.work import once
from .pages import image_targets, link_edges, success

# How severe each metric is; unknown metrics are medium.
SEVERITY = {
    "http_server_error": "critical", "http_client_error": "critical", "network_connection_error": "critical", "redirect_chain_excessive": "medium",
    "redirect_temporary": "low", "redirect_loop": "critical", "robots_txt_disallowed": "high",
    "missing_title": "critical", "title_too_short": "medium", "title_too_long": "medium", "duplicate_title": "high",
    "missing_meta_description": "high", "meta_description_too_short": "medium", "meta_description_too_long": "medium", "duplicate_meta_description": "medium",
    "missing_h1": "high", "multiple_h1": "high", "heading_hierarchy_skipped": "medium", "empty_heading": "low",
    "missing_image_alt": "medium", "broken_image": "high",
    "missing_canonical": "medium", "multiple_canonical": "high", "relative_canonical": "low", "canonical_mismatch": "high",
    "robots_noindex": "critical", "robots_conflicting": "high", "x_robots_noindex": "critical",
    "missing_viewport": "high", "missing_html_lang": "low", "invalid_html_lang": "low",
    "broken_internal_link": "high", "empty_anchor_text": "low", "missing_href": "low",
    "insecure_http": "high", "mixed_content": "high", "missing_open_graph": "low", "thin_content": "medium", "empty_content": "high",
}
RANKS = ("critical", "high", "medium", "low", "info")


@dataclass(frozen=True)
class AuditConfig:
    """Limits of the rules and of the crawl."""

    max_pages: int = 25
    max_depth: int = 3
    title_length: tuple[int, int] = (30, 60)
    description_length: tuple[int, int] = (70, 160)
    min_words: int = 200
    assets_per_page: int = 15
    tracking: tuple[str, ...] = field(default=urls.TRACKING)


def severity(metric: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    return F.coalesce(F.try_element_at(table, metric), F.lit("medium"))


def severity_rank(s: Column) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, RANKS)), s), F.lit(0)) - 1, F.lit(len(RANKS))).cast("int")


def finding(when: Column, metric: str, evidence: Column | str, fix: str, page: Column | None = None) -> Column:
    """A finding where ``when`` holds, else null."""
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    body = F.struct(F.lit(metric).alias("metric"), (F.col("final_url") if page is None else page).alias("page"), F.lit(SEVERITY.get(metric, "medium")).alias("severity"), as_col(evidence).alias("evidence"), F.lit(fix).alias("suggested_fix"))
    return F.when(when, body)


def _say(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def page_findings(cfg: AuditConfig) -> list[Column]:
    """Every page rule as a nullable finding; order is that of the rule set."""
    c = F.col
    good = success()
    has = good & (c("content") != "")
    status, asked = c("status"), c("requested_url")
    client, server = status.between(400, 499), status.between(500, 599)
    broken = (status == 0) | ((F.coalesce(c("error"), F.lit("")) != "") & ~client & ~server)
    chain = c("redirect_chain")
    hops = F.array_join(F.concat(chain, F.array("final_url")), " -> ")
    title, desc = c("title"), c("meta_description")
    no_title, no_desc = F.coalesce(title, F.lit("")) == "", F.coalesce(desc, F.lit("")) == ""
    view = F.coalesce(c("viewport"), F.lit(""))
    tokens = lambda d: F.transform(F.split(F.lower(d), ","), lambda t: strip(t))
    robots = F.coalesce("robots_meta", F.array().cast("array<string>"))
    clash = F.filter(robots, lambda d: F.array_contains(tokens(d), "index") & F.array_contains(tokens(d), "noindex"))
    noindex = F.filter(robots, lambda d: F.array_contains(tokens(d), "noindex"))
    x_robots = F.filter(F.coalesce("x_robots_tag", F.array().cast("array<string>")), lambda d: F.lower(d).contains("noindex"))
    heads = c("headings")
    h1 = F.filter(heads, lambda h: h["level"] == 1)
    blank = F.filter(heads, lambda h: strip(h["text"]) == "")
    jump = F.get(F.filter(F.transform(heads, lambda h, i: F.struct(F.get(heads, i - 1)["level"].alias("a"), h["level"].alias("b"), h["text"].alias("t"))), lambda p: p["b"] > p["a"] + 1), F.lit(0))
    no_alt = F.transform(F.filter("images", lambda i: ~i["has_alt"]), lambda i: i["raw"])
    canon, canon_raw = c("canonicals"), c("canonical_raw")
    raw0, href0 = F.get(canon_raw, F.lit(0)), F.get("canonical_hrefs", F.lit(0))
    relative = raw0.contains('href="/') | ~href0.rlike("^(?i)https?:")
    no_text = F.filter("links", lambda x: x["is_internal"] & ~x["is_fragment"] & (strip(x["text"]) == ""))
    og = F.filter(F.array(*map(F.lit, ("og:title", "og:description", "og:image", "og:url"))), lambda k: ~F.map_contains_key("open_graph", k))
    words = c("visible_words")
    lo, hi = cfg.title_length
    dlo, dhi = cfg.description_length
    title_said = _say("Title of ", F.length(title), " characters: '", snippet(c("title_raw")), "'.")
    desc_said = _say("Description of ", F.length(desc), " characters: '", snippet(c("meta_description_raw")), "'.")
    return [
        finding(broken, "network_connection_error", _say("No response from ", asked, ": ", F.coalesce("error", F.lit("unknown error"))), "Check DNS, TLS and that the server answers.", asked),
        finding(~broken & server, "http_server_error", _say("HTTP ", status, " for ", asked, ": ", F.coalesce("error", F.lit("Internal Server Error"))), "Repair the server's error.", asked),
        finding(~broken & client, "http_client_error", _say("HTTP ", status, " for ", asked, ": ", F.coalesce("error", F.lit("Not Found"))), "Restore the page, or redirect or drop links to it.", asked),
        finding(F.size(chain) > 1, "redirect_chain_excessive", _say(F.size(chain), " redirects: ", hops), "Redirect straight to the last address.", asked),
        finding((F.size(chain) > 0) & status.isin(302, 307), "redirect_temporary", _say("Temporary redirect (", status, "): ", hops), "Use a permanent redirect for permanent moves.", asked),
        finding(has & no_title, "missing_title", F.when(c("title_raw").isNull(), "The page has no title element.").otherwise(_say("Empty title: '", snippet(c("title_raw")), "'.")), "Add a descriptive title."),
        finding(has & ~no_title & (F.length(title) < lo), "title_too_short", title_said, f"Write at least {lo} characters."),
        finding(has & ~no_title & (F.length(title) > hi), "title_too_long", title_said, f"Write at most {hi} characters."),
        finding(has & no_desc, "missing_meta_description", F.when(c("meta_description_raw").isNull(), "The page has no meta description.").otherwise(_say("Empty description: '", snippet(c("meta_description_raw")), "'.")), "Describe the page in a meta description."),
        finding(has & ~no_desc & (F.length(desc) < dlo), "meta_description_too_short", desc_said, f"Write at least {dlo} characters."),
        finding(has & ~no_desc & (F.length(desc) > dhi), "meta_description_too_long", desc_said, f"Write at most {dhi} characters."),
        finding(has & ~F.lower(view).contains("width=device-width"), "missing_viewport", F.when(view == "", "The page has no viewport meta tag.").otherwise(_say("Viewport without width=device-width: '", view, "'.")), "Set width=device-width in a viewport tag."),
        finding(good & (F.size(clash) > 0), "robots_conflicting", _say("Robots directives contradict each other: '", F.get(clash, F.lit(0)), "'."), "Keep one of index and noindex."),
        finding(good & (F.size(noindex) > 0), "robots_noindex", _say("Robots meta forbids indexing: '", F.get(noindex, F.lit(0)), "'."), "Drop noindex if the page should be found."),
        finding(good & (F.size(x_robots) > 0), "x_robots_noindex", _say("X-Robots-Tag forbids indexing: '", F.get(x_robots, F.lit(0)), "'."), "Drop the header if the page should be found."),
        finding(good & c("robots_disallowed"), "robots_txt_disallowed", _say("robots.txt disallows ", c("final_url"), "."), "Allow the path in robots.txt."),
        finding(has & (F.size(h1) == 0), "missing_h1", "0 h1 elements.", "Add one h1."),
        finding(has & (F.size(h1) > 1), "multiple_h1", _say(F.size(h1), " h1 elements: ", samples(F.transform(h1, lambda h: h["text"]), 60), "."), "Keep one h1."),
        finding(has & (F.size(blank) > 0), "empty_heading", _say(F.size(blank), " headings without text: ", samples(F.transform(blank, lambda h: h["raw"]), 60), "."), "Fill or remove empty headings."),
        finding(has & jump.isNotNull(), "heading_hierarchy_skipped", _say("h", jump["a"], " is followed by h", jump["b"], ": '", snippet(jump["t"], 60), "'."), "Don't skip heading levels."),
        finding(has & (F.size(no_alt) > 0), "missing_image_alt", _say(F.size(no_alt), " images without alt: ", samples(no_alt, 70), and_more(no_alt, 3), "."), "Describe images in alt attributes."),
        finding(has & (F.size(canon) == 0), "missing_canonical", "The page has no canonical link.", "Add a canonical link."),
        finding(has & (F.size(canon) > 1), "multiple_canonical", _say(F.size(canon), " canonical links: ", samples(canon_raw, 80), "."), "Keep one canonical link."),
        finding(has & (F.size(canon) > 0) & relative, "relative_canonical", _say("Relative canonical: '", snippet(raw0, 100), "'."), "Use an absolute address."),
        finding(has & (F.size(canon) > 0) & ~urls.same_site(c("final_url"), F.get(canon, F.lit(0))), "canonical_mismatch", _say("Canonical leads to another site: '", snippet(raw0, 100), "'."), "Point the canonical link to this site."),
        finding(has & (F.size(no_text) > 0), "empty_anchor_text", _say(F.size(no_text), " internal links without text: ", samples(F.transform(no_text, lambda x: x["raw"]), 80), "."), "Give links a text."),
        finding(urls.scheme(c("final_url")) == "http", "insecure_http", _say("Served without TLS: ", c("final_url")), "Serve the page over https."),
        finding((urls.scheme(c("final_url")) == "https") & (F.size("insecure") > 0), "mixed_content", _say(F.size("insecure"), " insecure resources: ", samples(c("insecure"), 80), and_more(c("insecure"), 3), "."), "Load resources over https."),
        finding(has & (F.size(og) > 0), "missing_open_graph", _say("Missing: ", F.array_join(og, ", "), "."), "Add the Open Graph tags."),
        finding(has & (words == 0), "empty_content", "0 visible words.", "Add content to the page's body."),
        finding(has & (words > 0) & (words < cfg.min_words), "thin_content", _say(words, " visible words: '", snippet(c("visible_snippet"), 100), "'."), f"Write at least {cfg.min_words} words."),
        finding(has & c("html_lang").isNull(), "missing_html_lang", "The html element has no lang.", "Set the language."),
        finding(has & (strip(c("html_lang")) == ""), "invalid_html_lang", "The html element's lang is blank.", "Set a valid language."),
    ]


def _missing_href(pages: DataFrame) -> DataFrame:
    edges = pages.where(success() & (F.col("content") != "")).select("page_ord", "final_url", F.posexplode("links").alias("pos", "l")).where("l.href = ''")
    return edges.select("page_ord", (F.col("pos") + 100).alias("rule"), finding(F.lit(True), "missing_href", _say("Link without href: '", snippet(F.col("l.raw"), 80), "'."), "Give the link a target.").alias("f"))


def duplicates(pages: DataFrame, column: str, metric: str, what: str) -> DataFrame:
    """A finding for each successful page that shares its value (trimmed, lower case) with another."""
    value = F.lower(strip(F.col(column)))
    rows = once(pages, "parsed").where(success() & (F.coalesce(F.col(column), F.lit("")) != "")).select("page_ord", "final_url", F.col(column).alias("shown"), value.alias("k")).where("k <> ''")
    # The first pages of each group by order: min-based, so partial sums shrink popular groups before the shuffle.
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.min(F.struct("page_ord", "shown")).alias("first")).where("n > 1")
    ranked = rows.join(groups.select("k"), "k", "left_semi").withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("page_ord", "final_url"))).where("r <= 4")
    shown = ranked.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("page_ord", "final_url"))).alias("pages"))
    said = groups.join(shown, "k").select("k", _say(f"Duplicate {what} '", snippet(F.col("first.shown"), 80), "' on ", F.col("n"), " pages: ", F.array_join(F.transform("pages", lambda p: p["final_url"]), ", "), F.when(F.col("n") > 4, _say(" (and ", F.col("n") - 4, " more)")).otherwise(""), ".").alias("said"))
    return rows.join(said, "k").select("page_ord", F.lit(1000).alias("rule"), finding(F.lit(True), metric, F.col("said"), f"Give each page its own {what}.").alias("f"))


def broken_links(pages: DataFrame, tracking=urls.TRACKING) -> DataFrame:
    """Internal links to pages that answered with an error: an equi-join of edges with a status table.

    The status table is keyed by the normalised final and requested addresses; the last fetch wins.
    """
    n = lambda c: urls.normalize(c, tracking)
    pages = once(pages, "parsed")
    rows = pages.select("page_ord", "status", n(F.col("final_url")).alias("a"), n(F.col("requested_url")).alias("b"))
    keyed = rows.select("page_ord", "status", F.posexplode(F.array("a", "b")).alias("i", "target"))
    known = keyed.groupBy("target").agg(F.max_by("status", F.struct("page_ord", "i")).alias("target_status")).where("target_status >= 400")
    edges = link_edges(pages.where(success())).where(F.col("is_internal") & ~F.col("is_fragment") & (F.col("resolved") != "")).withColumn("target", n(F.col("resolved")))
    hit = edges.join(known, "target").withColumnRenamed("src", "final_url")
    said = _say("Link '", snippet(F.col("raw"), 80), "' to '", F.col("resolved"), "' (href '", F.col("href"), "') answers HTTP ", F.col("target_status"), ".")
    return hit.select("page_ord", (F.col("link_pos") + 2000).alias("rule"), finding(F.lit(True), "broken_internal_link", said, "Correct or remove the link.").alias("f"))


def broken_images(pages: DataFrame, assets: DataFrame, cfg: AuditConfig = AuditConfig()) -> DataFrame:
    """Images among the first ``assets_per_page`` of a page whose status in ``assets`` (url, status) is an error."""
    rows = image_targets(pages, cfg.assets_per_page)
    bad = assets.groupBy("url").agg(F.max("status").alias("asset_status")).where("asset_status >= 400")
    said = _say("Image '", snippet(F.col("i.raw"), 80), "' answers HTTP ", F.col("asset_status"), ": ", F.col("url"))
    return rows.join(bad, "url").select("page_ord", (F.col("pos") + 50).alias("rule"), finding(F.lit(True), "broken_image", said, "Replace or remove the image.").alias("f"))


Rule = Callable[[DataFrame, AuditConfig], DataFrame]
#: Further rules: functions of (parsed pages, config) that return (page_ord, rule, f).
EXTRA_RULES: list[Rule] = []


def findings(pages: DataFrame, cfg: AuditConfig = AuditConfig(), assets: DataFrame | None = None, rules: list[Rule] | None = None) -> DataFrame:
    """All findings of parsed pages: ``metric``, ``page``, ``severity``, ``evidence``, ``suggested_fix``.

    Equal (metric, page, evidence) count once; the first by rule order stays. Rows come sorted by severity, page, metric.
    """
    pages = once(pages, "parsed")
    own = pages.select("page_ord", F.posexplode(F.array(*page_findings(cfg))).alias("rule", "f")).where("f IS NOT NULL")
    parts = [own, _missing_href(pages), duplicates(pages, "title", "duplicate_title", "title"), duplicates(pages, "meta_description", "duplicate_meta_description", "meta description"), broken_links(pages, cfg.tracking)]
    if assets is not None:
        parts.append(broken_images(pages, assets, cfg))
    parts += [r(pages, cfg) for r in [*EXTRA_RULES, *(rules or [])]]
    rows = reduce(DataFrame.unionByName, parts)
    one = rows.groupBy("f.metric", "f.page", "f.evidence").agg(F.min(F.struct("rule", "page_ord", "f.severity", "f.suggested_fix")).alias("m"))
    out = one.select("metric", "page", "m.severity", "evidence", "m.suggested_fix")
    return out.orderBy(severity_rank(F.col("severity")), "page", "metric", "evidence")


def severity_summary(found: DataFrame) -> DataFrame:
    """Counts of the five severities, zero where there are none."""
    spark = SparkSession.active()
    dim = spark.createDataFrame([(s, i) for i, s in enumerate(RANKS)], "severity string, rank int")
    counts = found.groupBy("severity").agg(F.count("*").alias("n"))
    return F.broadcast(dim).join(counts, "severity", "left").select("severity", "rank", F.coalesce("n", F.lit(0)).alias("n"))


def metric_summary(found: DataFrame) -> DataFrame:
    return found.groupBy("metric").agg(F.count("*").alias("n"), F.countDistinct("page").alias("pages"))


def top_metrics(found: DataFrame, k: int = 8) -> DataFrame:
    return metric_summary(found).orderBy(F.desc("n"), "metric").limit(k)
