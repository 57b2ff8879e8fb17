"""Name, address and phone of a business: occurrences on pages, verdicts of consistency, confidence.

Extraction is narrow: the parser's candidates as arrays per page, exploded; occurrences are written once, as many aggregates read them. Comparison groups by field (and by any further
``by`` columns, such as the site): distinct values are aggregated first, so a value on millions of pages
is one row; phones that are suffixes of longer ones are found by an equi-join on suffixes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identity as fn
from ..functions import urls
from ..functions.text import any_contains, strip
from ..plans.work import once

# What marks contact pages, phones and addresses.
CONTACT_TERMS = ("contact", "about", "location", "locations", "store", "stores", "find-us", "findus", "reach-us", "reachus", "branches", "offices")
PHONE_TERMS = ("contact", "about", "location", "office", "branch", "store")
PHONE_LABELS = ("phone", "telephone", "tel", "call", "mobile", "whatsapp", "contact")
ADDRESS_LABELS = ("address", "location", "office", "branch")
PHONE_PATTERNS = (r"\+\d[\d\s().-]{7,}\d", r"\b\d{3}[-.\s]\d{3}[-.\s]\d{4}\b", r"\b\d{5}[-.\s]\d{5}\b", r"\b\d{10}\b")
_OCC = "array<struct<field:string,raw:string,normal:string,source_type:string,quality:double,context:string,entity:string>>"


def _occ(field: str, raw: Column, normal: Column, kind: str, quality: float, context: Column, entity: Column | None = None) -> Column:
    return F.struct(F.lit(field).alias("field"), raw.alias("raw"), normal.alias("normal"), F.lit(kind).alias("source_type"), F.lit(quality).alias("quality"), context.alias("context"), (F.lit("") if entity is None else entity).alias("entity"))


def _none() -> Column:
    return F.array().cast(_OCC)


def _when(cond: Column, occ: Column) -> Column:
    return F.when(cond, F.array(occ)).otherwise(_none())


def priority(url: Column, title: Column, headings: Column) -> Column:
    """How likely a page holds contact data: 1.0 root, 0.9 by path, 0.85 by title or headings, else 0.4."""
    path = F.regexp_replace(F.lower(urls.path(url)), "/+$", "")
    said = F.concat(F.lower(F.coalesce(title, F.lit(""))), F.lit(" "), F.array_join(F.transform(F.coalesce(headings, F.array().cast("array<string>")), lambda h: F.lower(h)), " "))
    return F.when(path == "", 1.0).when(any_contains(path, CONTACT_TERMS), 0.9).when(any_contains(said, [t.replace("-", " ") for t in CONTACT_TERMS]), 0.85).otherwise(0.4)


def _unseen(cands: Column, keys, stays) -> Column:
    """Keep-first over a page's candidates: ``keys(x)`` are remembered, ``stays(x, seen)`` decides."""
    start = F.struct(F.array().cast("array<string>").alias("seen"), _none().alias("kept"))

    def step(acc, x):
        new = stays(x, acc["seen"])
        return F.struct(F.when(new, F.concat(acc["seen"], keys(x))).otherwise(acc["seen"]).alias("seen"), F.when(new, F.concat(acc["kept"], F.array(x))).otherwise(acc["kept"]).alias("kept"))

    return F.aggregate(cands, start, step, lambda acc: acc["kept"])


def phones(calls: Column, text: Column, hint: Column, context: Column) -> Column:
    """tel and messaging links, labelled numbers, and on contact pages any number."""

    def from_link(n):
        href = n["href"]
        low = F.lower(href)
        tel, wa = low.startswith("tel:"), low.contains("wa.me/")
        raw = F.when(tel, strip(F.regexp_replace(href, "(?s)^....", ""))).when(wa | low.contains("api.whatsapp.com/send"), F.regexp_extract(href, r"(?:wa\.me/|phone=)(\+?\d+)", 1)).otherwise("")
        raw = F.when((raw == "") & (tel | wa), n["text"]).otherwise(raw)
        return _occ("phone", raw, fn.phone(raw, hint), "html_tel_link", 0.85, F.when(n["text"] != "", F.substring(n["text"], 1, 300)).otherwise(href))

    links = calls
    groups = [F.transform(links, from_link)]
    for label in PHONE_LABELS:
        pattern = F.lit(rf"(?i){label}\s*[:\-]?\s*(\+?\d[\d\s().-]{{7,}}\d)")
        whole, raw = F.regexp_extract_all(text, pattern, F.lit(0)), F.regexp_extract_all(text, pattern, F.lit(1))
        groups.append(F.zip_with(raw, whole, lambda r, w: _occ("phone", strip(r), fn.phone(r, hint), "html_labeled_phone", 0.8, F.substring(w, 1, 300))))
    for pattern in PHONE_PATTERNS:
        found = F.when(any_contains(context, PHONE_TERMS), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
        groups.append(F.transform(F.filter(found, lambda r: F.length(F.regexp_replace(r, "[^0-9]", "")).between(8, 15)), lambda r: _occ("phone", strip(r), fn.phone(r, hint), "html_phone_pattern", 0.5, strip(r))))
    cands = F.filter(F.concat(*groups), lambda x: x["normal"] != "")
    free = lambda x, seen: ~F.array_contains(seen, x["normal"]) & ((x["source_type"] != "html_phone_pattern") | ~F.array_contains(seen, x["raw"]))
    return _unseen(cands, lambda x: F.array(x["normal"], x["raw"]), free)


def addresses(texts: Column, lines: Column) -> Column:
    """<address> elements and labelled lines."""
    tags = F.transform(texts, lambda t: _occ("address", t, fn.address(t), "html_address_tag", 0.8, F.substring(t, 1, 500)))
    groups = [tags]
    for label in ADDRESS_LABELS:
        pattern = F.lit(rf"(?i){label}\s*[:\-]\s*([^\n]{{8,250}})")
        whole, raw = F.regexp_extract_all(lines, pattern, F.lit(0)), F.regexp_extract_all(lines, pattern, F.lit(1))
        cut = F.transform(raw, lambda r: F.regexp_replace(r, r"^[ ,.\-]+|[ ,.\-]+$", ""))
        made = F.zip_with(cut, whole, lambda r, w: _occ("address", r, fn.address(r), "html_labeled_address", 0.7, F.substring(w, 1, 500)))
        groups.append(F.filter(made, lambda x: F.length(x["raw"]) >= 8))
    return _unseen(F.concat(*groups), lambda x: F.array(F.lower(x["raw"])), lambda x, seen: ~F.array_contains(seen, F.lower(x["raw"])))


def names(site: Column, brands: Column, alts: Column, title: Column) -> Column:
    """og:site_name, brand elements, logo alt texts, and the brand part of the title, best first."""
    made = lambda raw, kind, q, context: _occ("name", raw, fn.business_name(raw), kind, q, context, raw)
    groups = [
        _when((site != "") & (F.length(site) <= 80), made(site, "html_og_site_name", 0.85, F.concat(F.lit("og:site_name "), site))),
        F.transform(brands, lambda t: made(t, "html_brand_element", 0.75, F.substring(t, 1, 300))),
        F.transform(alts, lambda a: made(a, "html_logo_alt", 0.4, F.concat(F.lit("alt "), a))),
    ]
    brand = fn.title_brand(title)
    groups.append(_when(brand != "", made(brand, "html_title", 0.3, F.substring(F.coalesce(title, F.lit("")), 1, 300))))
    return _unseen(F.filter(F.concat(*groups), lambda x: x["normal"] != ""), lambda x: F.array(x["normal"]), lambda x, seen: ~F.array_contains(seen, x["normal"]))


def structured(entities: Column, items: Column) -> Column:
    """Occurrences of JSON-LD entities, then of microdata items."""
    of = lambda e, kind, q: F.concat(
        _when(e["name"] != "", _occ("name", e["name"], fn.business_name(e["name"]), kind, q, e["context"], e["name"])),
        _when(e["phone"] != "", _occ("phone", e["phone"], fn.phone(e["phone"]), kind, q, e["context"], e["name"])),
        _when(e["address"] != "", _occ("address", e["address"], fn.address(e["address"]), kind, q, e["context"], e["name"])),
    )
    return F.concat(F.flatten(F.transform(entities, lambda e: of(e, "json_ld", 1.0))), F.flatten(F.transform(items, lambda e: of(e, "microdata", 0.9))))


def occurrences(pages: DataFrame) -> DataFrame:
    """All occurrences of pages parsed with their contacts, a row each, without repeats of (field, raw, url, source_type).

    ``ord`` is the order of evidence: pages by priority, then page order; structured data before html.
    """
    c = lambda name: F.col(f"contacts.{name}")
    df = pages.where("contacts IS NOT NULL")
    df = df.withColumn("all_text", F.array_join(c("strings"), " ")).withColumn("lines", F.array_join(c("strings"), "\n"))
    heads = F.transform("headings", lambda h: h["text"])
    df = df.withColumn("priority", priority(F.col("final_url"), F.col("title"), heads)).withColumn("hint", fn.country_hint(urls.host(F.col("final_url")), F.col("all_text")))
    context = F.concat(F.lower(F.coalesce("title", F.lit(""))), F.lit(" "), F.lower(F.array_join(heads, " ")), F.lit(" "), F.lower(F.col("final_url")))
    every = F.concat(structured(c("entities"), c("items")), phones(c("calls"), F.col("all_text"), F.col("hint"), context), addresses(c("addresses"), F.col("lines")), names(c("site"), c("brands"), c("alts"), F.col("title")))
    rows = df.select("page_ord", F.col("final_url").alias("url"), "priority", F.posexplode(every).alias("seq", "o")).select("page_ord", "url", "priority", "seq", "o.*")
    rows = rows.withColumn("ord", F.struct((-F.col("priority")).alias("p"), "page_ord", "seq"))
    first = rows.groupBy("field", "raw", "url", "source_type").agg(F.min(F.struct("ord", "normal", "quality", "context", "entity", "priority")).alias("m"))
    return first.select("field", "raw", "m.normal", "url", "source_type", "m.quality", "m.context", "m.entity", "m.priority", "m.ord")


def canonical_phones(values: DataFrame, by: list[str], col: str = "normal") -> DataFrame:
    """Distinct values without those that a longer one ends with; equi-join on proper suffixes."""
    own = values.select(*by, col).where(F.col(col) != "").distinct()
    ends = own.select(*by, F.explode(F.when(F.length(col) > 1, F.transform(F.sequence(F.lit(2), F.length(col)), lambda i: F.substr(F.col(col), i)))).alias(col)).distinct()
    same = reduce(lambda a, b: a & b, [F.col(f"v.{c}").eqNullSafe(F.col(f"e.{c}")) for c in [*by, col]])
    return own.alias("v").join(ends.alias("e"), same, "left_anti")


def reports(occ: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row for each field (and group): verdict, confidence, details, pages, values, normal values.

    occ has field, raw, normal, url, source_type, quality, ord and, optionally, priority. Fields without
    occurrences in a group are ``not_found``.
    """
    by = by or []
    key = [*by, "field"]
    occ = once(occ, "occurrences")
    if "priority" not in occ.columns:
        occ = occ.withColumn("priority", F.lit(0.4))
    occ = occ.withColumn("priority", F.coalesce("priority", F.lit(0.4)))
    # Flags of each group, aggregated and joined back: groups may be large.
    usable = F.col("normal") != ""
    trust = occ.groupBy(*key).agg(F.max(usable & (F.col("quality") >= 0.65)).alias("any_trusted"))
    rows = occ.join(trust, key).withColumn("compared", usable & (~F.col("any_trusted") | (F.col("quality") >= 0.65)))
    phones_ = rows.where("field = 'phone'")
    all_canon = canonical_phones(phones_, key).groupBy(*key).agg(F.count("*").alias("all_canon"))
    cmp_canon = canonical_phones(phones_.where("compared"), key).groupBy(*key).agg(F.count("*").alias("cmp_canon"), F.array_sort(F.collect_list("normal")).alias("canon"))
    rows = rows.join(all_canon, key, "left").withColumn("compared", F.when((F.col("field") == "phone") & (F.col("all_canon") == 1), usable).otherwise(F.col("compared")))
    cmp = rows.where("compared").groupBy(*key).agg(F.count("*").alias("n_cmp"), F.countDistinct("raw").alias("raw_cmp"), F.countDistinct("normal").alias("normal_cmp"), F.max("quality").alias("q_cmp"))
    stats = rows.groupBy(*key).agg(
        F.count("*").alias("n"), F.avg("quality").alias("avg_quality"), F.countDistinct("source_type").alias("types"), F.avg("priority").alias("avg_priority"),
        F.countDistinct(F.when(usable, F.col("normal"))).alias("normals"), F.countDistinct("raw").alias("raws"), F.max("quality").alias("top_quality"), F.max("all_canon").alias("all_canon"),
    )

    def in_order(col: str, alias: str) -> DataFrame:
        seen = rows.where(F.col(col) != "").groupBy(*key, col).agg(F.min("ord").alias("o"))
        return seen.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", col))), lambda s: s[col]).alias(alias))

    # Addresses: components of distinct raw values, streets against the first.
    parts = rows.where("field = 'address'").groupBy(*key, "raw").agg(F.min("ord").alias("ord")).withColumn("c", fn.address_parts(F.col("raw")))
    parts = parts.where((F.col("c.street") != "") | (F.col("c.locality") != "") | (F.col("c.region") != "") | (F.col("c.postal_code") != ""))
    differ = parts.groupBy(*key).agg(*[F.countDistinct(F.when(F.col(f"c.{f}") != "", F.col(f"c.{f}"))).alias(f"n_{f}") for f in ("postal_code", "locality", "region")], F.count("*").alias("parsed"), F.min(F.struct("ord", "c.street", "c.normal")).alias("whole_base"), F.min(F.when(F.col("c.street") != "", F.struct("ord", "c.street"))).alias("base"))
    pair = parts.join(differ, key).where(F.col("ord") != F.col("whole_base.ord")).select(*key, F.col("base.street").alias("a"), F.col("c.street").alias("b"), F.col("whole_base.normal").alias("x"), F.col("c.normal").alias("y")).distinct()
    alike = pair.select(*key, F.when((F.col("a") != "") & (F.col("b") != ""), fn.likeness("a", "b")).alias("street_like"), fn.likeness("x", "y").alias("whole_like"))
    alike = alike.groupBy(*key).agg(F.min("street_like").alias("street_like"), F.min("whole_like").alias("whole_like"))

    out = stats
    for other in (cmp, cmp_canon, differ.drop("whole_base", "base"), alike, in_order("url", "pages"), in_order("raw", "values"), in_order("normal", "normal_values")):
        out = out.join(other, key, "left")
    is_phone = F.col("field") == "phone"
    distinct = F.when(is_phone, F.when(F.col("all_canon") == 1, 1).otherwise(F.col("cmp_canon"))).otherwise(F.col("normal_cmp"))
    floor = F.when(is_phone, 0.75).otherwise(0.8)
    simple = (
        F.when(F.coalesce("n_cmp", F.lit(0)) == 0, "not_found").when(distinct > 1, "genuine_mismatch")
        .when((F.col("n_cmp") == 1) & (F.col("q_cmp") >= floor), "consistent").when(F.col("n_cmp") == 1, "uncertain")
        .when(F.col("raw_cmp") > 1, "minor_formatting_difference").otherwise("consistent")
    )
    clash = (F.col("n_postal_code") > 1) | (F.col("n_locality") > 1) | (F.col("n_region") > 1) | (F.col("street_like") < 0.8)
    addressed = F.when(F.col("parsed").isNull(), "uncertain").when(F.coalesce(clash, F.lit(False)), "genuine_mismatch").when((F.col("normals") == 1) & (F.col("raws") > 1), "minor_formatting_difference").when(F.col("normals") == 1, "consistent").otherwise("uncertain")
    out = out.withColumn("verdict", F.when(F.col("field") == "address", addressed).otherwise(simple))
    agree = F.when(is_phone, F.coalesce("all_canon", F.lit(0))).otherwise(F.col("normals")) <= 1
    score = 0.35 * F.col("avg_quality") + 0.2 * F.least(F.col("types") / 3, F.lit(1.0)) + 0.15 * F.least(F.col("n") / 4, F.lit(1.0)) + 0.15 * F.col("avg_priority") + 0.15 * agree.cast("double")
    score = F.when((F.col("n") == 1) & (F.col("top_quality") >= 0.9), F.least(score, F.lit(0.85))).when((F.col("n") == 1) & (F.col("top_quality") <= 0.4), F.least(score, F.lit(0.35))).otherwise(score)
    score = score * F.when(F.col("verdict") == "genuine_mismatch", 0.9).when(F.col("verdict") == "uncertain", 0.75).otherwise(1.0)
    details = (
        F.when(F.col("verdict") == "genuine_mismatch", F.concat(F.lit("Different values: "), F.array_join(F.when(is_phone, F.col("canon")).otherwise(F.slice("normal_values", 1, 10)), ", ")))
        .when((F.col("field") == "address") & (F.col("whole_like") >= 0.9) & (F.col("verdict") == "uncertain"), "Very similar, but too sparse to prove agreement.")
        .when(F.col("verdict") == "uncertain", "The evidence is too weak or too sparse.").when(F.col("verdict") == "minor_formatting_difference", "One value in several spellings.").otherwise("All compared values agree.")
    )
    made = out.select(*key, "verdict", F.bround(F.greatest(F.lit(0.0), F.least(score, F.lit(1.0))), 2).alias("confidence"), details.alias("details"), "pages", "values", "normal_values", F.col("n").alias("occurrences"))
    spark = occ.sparkSession
    fields = [F.struct(F.lit(i).alias("field_ord"), F.lit(f).alias("field")) for i, f in enumerate(("name", "address", "phone"))]
    groups = occ.select(*by).distinct() if by else spark.range(1).select()
    dims = groups.select(*by, F.explode(F.array(*fields)).alias("f")).select(*by, "f.*")
    none = F.array().cast("array<string>")
    full = dims.join(made, key, "left")
    return full.select(*key, "field_ord", F.coalesce("verdict", F.lit("not_found")).alias("verdict"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("details", F.lit("No value was found.")).alias("details"), *[F.coalesce(c, none).alias(c) for c in ("pages", "values", "normal_values")], F.coalesce("occurrences", F.lit(0)).alias("occurrences"))
