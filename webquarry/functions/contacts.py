"""Candidates of a business's name, address and phone, picked from a page's tree."""

from __future__ import annotations

from collections.abc import Iterator

from .dom import Element, Page, attr, joined, strings, text_of
from .identity import ADDRESS_FIELDS, business_entities, names_business

# What isn't a site's brand.
NOISE = (
    "question", "questions", "interview", "premium", "free", "intern", "engineer", "campus", "test", "tests", "available", "rating", "reviews", "review", "learn more", "read more", "view all",
    "explore", "sign in", "login", "register", "home", "about us", "contact us", "privacy policy", "terms of service", "menu", "search", "navigation", "categories", "category", "tags", "tag", "blog",
    "pricing", "pricing plan", "monthly", "yearly", "dashboard", "subscribe", "cart", "checkout", "all rights reserved", "all rights", "copyright", "solved", "solutions", "contribute", "practice",
    "company", "companies", "problems", "topics", "experience", "experiences", "assessment", "assessments",
)
# Class and id parts of lists, tags of content, alt texts that name nothing.
LISTS = ("card", "item", "list", "grid", "table", "directory", "question", "article", "post", "entry", "catalog", "row", "col", "badge", "category", "topic", "testimonial", "review", "partner", "sponsor", "client", "problem", "snippet", "dropdown", "modal", "tab")
CONTENT_TAGS = ("article", "section", "table", "tbody", "tr", "td")
GENERIC_ALT = ("logo", "icon", "brand", "image", "search", "menu", "arrow", "close", "banner", "avatar")


def up(e: Element) -> Iterator[Element]:
    """The element's ancestors, nearest first."""
    while (e := e.parent) is not None and e.tag:
        yield e


def marks(e: Element) -> tuple[str, str]:
    return e.attrs.get("class", "").lower(), e.attrs.get("id", "").lower()


def in_bar(e: Element) -> bool:
    return any(x.tag in ("header", "nav") for x in up(e))


def can_be_brand(e: Element, text: str) -> bool:
    """Short, no noise, not within content or lists."""
    low = text.lower()
    if not 2 <= len(text) <= 50 or len(text.split()) > 5 or "\n" in text or ";" in text or any(n in low for n in NOISE):
        return False
    for x in (e, *up(e)):
        if x.tag in ("body", "html"):
            return True
        classes, name = marks(x)
        listed = any(w in classes or w in name for w in LISTS) and "navbar-brand" not in classes and "site-branding" not in classes
        if x.tag in CONTENT_TAGS or listed:
            return False
    return True


#: Selectors of brand elements, in order; one that fits over three elements tells nothing.
BRAND_SELECTORS = (
    lambda e: "navbar-brand" in e.attrs.get("class", "").split(),
    lambda e: "site-title" in e.attrs.get("class", ""),
    lambda e: "site-name" in e.attrs.get("class", ""),
    lambda e: "site-branding" in e.attrs.get("class", "").split(),
    lambda e: e.tag == "a" and e.attrs.get("href") == "/" and in_bar(e),
)


def brands(page: Page) -> Iterator[str]:
    for fits in BRAND_SELECTORS:
        hits = [e for e in page.order if fits(e)]
        if len(hits) <= 3:
            for e in hits:
                if can_be_brand(e, text := text_of(e)):
                    yield text


def logo_texts(page: Page) -> Iterator[str]:
    """Alt texts of images in a bar or within a brand's mark."""
    for e in page.order:
        if e.tag == "img" and "alt" in e.attrs:
            alt = attr(e, "alt")
            if 1 <= len(alt) <= 60 and len(alt.split()) <= 5 and alt.lower() not in GENERIC_ALT:
                if in_bar(e) or any({"navbar-brand", "site-logo"} & set(marks(x)[0].split()) for x in up(e)):
                    yield alt


def site_name(page: Page) -> str:
    """og:site_name by property, else by name."""
    metas = [e for e in page.order if e.tag == "meta"]
    for key in ("property", "name"):
        for e in metas:
            if e.attrs.get(key) == "og:site_name":
                return attr(e, "content")
    return ""


def microdata(page: Page) -> Iterator[dict]:
    """Business items; the last value of a property wins."""
    for e in page.order:
        kind = e.attrs.get("itemtype", "")
        if "schema.org/" in kind and names_business(kind.rsplit("/", 1)[-1]):
            values: dict[str, str] = {}
            for x in page.order[e.pos + 1 : e.until + 1]:
                if name := x.attrs.get("itemprop", "").split():
                    if value := x.attrs.get("content") or x.attrs.get("value") or text_of(x):
                        values[name[0]] = value
            whole = ", ".join(values[f] for f in ADDRESS_FIELDS if f in values)
            yield {"name": values.get("name", ""), "phone": values.get("telephone", ""), "address": whole, "context": text_of(e)[:500]}


def contacts(page: Page) -> dict:
    calls = []
    for e in page.order:
        href = attr(e, "href") if e.tag == "a" else ""
        low = href.lower()
        if low.startswith("tel:") or "wa.me/" in low or "api.whatsapp.com/send" in low:
            calls.append({"href": href, "text": text_of(e)})
    scripts = [joined(e) for e in page.order if e.tag == "script" and e.attrs.get("type") == "application/ld+json"]
    return {
        "entities": [x for text in scripts for x in business_entities(text)], "items": list(microdata(page)), "calls": calls,
        "addresses": [text for e in page.order if e.tag == "address" and (text := text_of(e))],
        "site": site_name(page), "brands": list(brands(page)), "alts": list(logo_texts(page)),
        "strings": [x for x in (x.strip() for x in strings(page.root)) if x],
    }
