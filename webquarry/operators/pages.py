"""Responses and parsed pages: one parse for each page, and its projections as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.dom import parse_dom
from ..functions.text import words_of

#: Schema of a fetched page; see ``responses_from_pages`` for the defaults.
RESPONSE = (
    "page_ord long, requested_url string, final_url string, status int, headers map<string,string>, content string, "
    "redirect_chain array<string>, depth int, error string, robots_disallowed boolean"
)


def responses_from_pages(pages: DataFrame) -> DataFrame:
    """Raw pages (page_id, url, html) as successful fetches in page_id order."""
    return pages.select(
        F.col("page_id").alias("page_ord"), F.col("url").alias("requested_url"), F.col("url").alias("final_url"), F.lit(200).alias("status"),
        F.create_map().cast("map<string,string>").alias("headers"), F.coalesce("html", F.lit("")).alias("content"), F.array().cast("array<string>").alias("redirect_chain"),
        F.lit(0).alias("depth"), F.lit(None).cast("string").alias("error"), F.lit(False).alias("robots_disallowed"),
    )


def success() -> Column:
    return F.col("status").between(200, 299)


def with_dom(responses: DataFrame, *families: str) -> DataFrame:
    """Adds ``dom`` with the families asked for; the parser only sees successful pages with content."""
    html = F.when(success() & (F.col("content") != ""), F.coalesce("rendered_html", "content") if "rendered_html" in responses.columns else F.col("content"))
    return spread(responses).withColumn("dom", parse_dom(html, F.col("final_url"), families))


def spread(responses: DataFrame) -> DataFrame:
    """The rows over all cores where there are fewer files than cores: parsing costs more than moving the pages then."""
    if responses.isStreaming:
        return responses
    files, cores = len(responses.inputFiles()), responses.sparkSession.sparkContext.defaultParallelism
    return responses.repartition(cores) if 0 < files < cores else responses


def parsed_pages(responses: DataFrame, *more: str) -> DataFrame:
    """One row per response with all projections; narrow, so pages of any number stay where they are.

    Pages that failed or are empty have null scalars and empty arrays. ``more`` are further families of the
    parser (``contacts``, ``passages``) as columns of these names, from the same parse.
    """
    df = with_dom(responses, "seo", *more)
    seo = lambda name: F.col(f"dom.seo.{name}")
    kinds = {f.name: f.dataType for f in df.schema["dom"].dataType["seo"].dataType.fields}
    listed = lambda name: F.coalesce(seo(name), F.array().cast(kinds[name]))
    meta = listed("meta")
    named = lambda name: F.filter(meta, lambda m: m["name"] == name)
    last = lambda a: F.try_element_at(a, F.lit(-1))
    first = lambda a: F.get(a, F.lit(0))

    def last_wins(pairs: Column) -> Column:
        """Map of (key, value) pairs in which later ones win."""
        keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
        return F.map_from_arrays(keys, F.transform(keys, lambda k: last(F.filter(pairs, lambda p: p["k"] == k))["v"]))

    og = F.transform(F.filter(meta, lambda m: m["prop"].startswith("og:") & (m["content"] != "")), lambda m: F.struct(m["prop"].alias("k"), m["content"].alias("v")))
    tw = F.filter(meta, lambda m: (m["name"].startswith("twitter:") | m["prop"].startswith("twitter:")) & (m["content"] != ""))
    tw = F.transform(tw, lambda m: F.struct(F.when(m["name"].startswith("twitter:"), m["name"]).otherwise(m["prop"]).alias("k"), m["content"].alias("v")))
    words, base = words_of(seo("visible")), F.col("final_url")
    links = F.transform(listed("links"), lambda x: x.withField("is_internal", F.coalesce(urls.same_site(base, x["resolved"]), F.lit(False))))
    return df.select(
        *responses.columns, *[F.col(f"dom.{f}").alias(f) for f in more],
        seo("lang").alias("html_lang"), seo("title").alias("title"), seo("title_raw").alias("title_raw"),
        first(named("description"))["content"].alias("meta_description"), first(named("description"))["raw"].alias("meta_description_raw"),
        last(named("viewport"))["content"].alias("viewport"),
        F.filter(F.transform(named("robots"), lambda m: m["content"]), lambda c: c != "").alias("robots_meta"),
        last_wins(og).alias("open_graph"), last_wins(tw).alias("twitter_cards"),
        F.when(F.col("dom").isNotNull(), F.map_values(F.map_filter("headers", lambda k, v: F.lower(k) == "x-robots-tag"))).alias("x_robots_tag"),
        F.transform(listed("canonical"), lambda x: x["href"]).alias("canonical_hrefs"), F.transform(listed("canonical"), lambda x: x["raw"]).alias("canonical_raw"), F.transform(listed("canonical"), lambda x: x["resolved"]).alias("canonicals"),
        F.transform(listed("headings"), lambda h, i: h.withField("ord", i)).alias("headings"), listed("images").alias("images"), links.alias("links"),
        F.when(urls.scheme(base) == "https", listed("insecure")).otherwise(F.array().cast("array<string>")).alias("insecure"),
        F.coalesce(F.size(words), F.lit(0)).alias("visible_words"), F.array_join(F.slice(words, 1, 40), " ").alias("visible_snippet"),
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """The links of parsed pages as rows with their place."""
    return pages.select("page_ord", F.col("final_url").alias("src"), F.posexplode("links").alias("link_pos", "l")).select("page_ord", "src", "link_pos", "l.*")


def image_targets(pages: DataFrame, per_page: int) -> DataFrame:
    """Of each good page, the first ``per_page`` images with an address, where it is http(s): page_ord, final_url, pos, i (the image), url."""
    seen = F.filter("images", lambda i: ~i["is_data_uri"] & (i["src"] != ""))
    rows = pages.where(success() & (F.col("content") != "")).select("page_ord", "final_url", F.posexplode(F.slice(seen, 1, per_page)).alias("pos", "i"))
    return rows.where(F.col("i.resolved").rlike("^(?i)https?://")).withColumn("url", F.col("i.resolved"))


def spa_shell(html: Column) -> Column:
    """A script-only page: a known root container, under five links, under 50 words in the body."""
    root = html.rlike(r"""(?i)<div\s+id\s*=\s*["'](?:root|app|__next|__nuxt|main-app)["']""")
    links = F.regexp_count(html, F.lit(r"(?i)<a\s[^>]*href\s*="))
    body = F.regexp_extract(html, r"(?is)<body[^>]*>(.*)</body>", 1)
    text = F.regexp_replace(F.regexp_replace(body, r"(?is)<(script|style|noscript)[^>]*>.*?</\1>", ""), r"(?s)<[^>]+>", " ")
    words = F.size(F.filter(F.split(text, "(?U)\\s+"), lambda w: w != ""))
    return F.coalesce(root & (links < 5) & html.rlike(r"(?is)<body[^>]*>.*</body>") & (words < 50), F.lit(False))
