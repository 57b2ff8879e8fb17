"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers

from . import ann, decontam, langid, mixing, quality, records, sharding, simhash, token_count, url_filter

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


#: (rule, verdict); the contract's rules.
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
#: Listed hosts, blocked with their subdomains where no rule fits.
BLOCKED_HOSTS = ["ads-track.example.com", "adult-x.example.com", "casino-win.example.net", "cheap-pills.example.net", "free-bets.example.net", "spam-farm.example.org"]


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark, sf_dir):
    return url_filter.judge(_table(spark, sf_dir, "pages"), URL_RULES, BLOCKED_HOSTS)


OP1_SQL = """
WITH p AS (
  SELECT page_id,
    coalesce(CASE WHEN instr(url, '://') > 0 THEN translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END, '') AS host,
    coalesce(CASE WHEN instr(url, '://') > 0 THEN regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) END, '') AS path
  FROM pages),
rules(h, pre, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
hosts(b) AS (VALUES ('ads-track.example.com'), ('adult-x.example.com'), ('casino-win.example.net'), ('cheap-pills.example.net'), ('free-bets.example.net'), ('spam-farm.example.org')),
j AS (SELECT p.*, (SELECT max_by(h || pre, length(h || pre)) FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre)) AS rule,
             (SELECT max_by(b, length(b)) FROM hosts WHERE host = b OR ends_with(host, '.' || b)) AS listed_host FROM p)
SELECT page_id, host, path, rule,
  CASE WHEN rule IS NOT NULL THEN (SELECT v FROM rules WHERE h || pre = rule) WHEN listed_host IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  listed_host
FROM j
"""


def op2_simhash(spark, sf_dir):
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_token_counts(spark, sf_dir):
    return token_count.token_counts(_table(spark, sf_dir, "documents"), TOKENIZER, public_tokenizers.PATTERN)


def op4_ann(spark, sf_dir):
    return ann.search(_table(spark, sf_dir, "embeddings"))


def op5_langid(spark, sf_dir):
    return langid.identify(_table(spark, sf_dir, "documents"))


def op6_sharding(spark, sf_dir):
    return sharding.assign(_table(spark, sf_dir, "documents"))


def op7_records(spark, sf_dir):
    return records.encode_and_read(_table(spark, sf_dir, "documents"), TOKENIZER)


def op8_quality(spark, sf_dir):
    return quality.assess(_table(spark, sf_dir, "documents"))


def op9_decontamination(spark, sf_dir):
    return decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_mixing(spark, sf_dir):
    return mixing.mix(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_simhash": op2_simhash,
    "op3_token_counts": op3_token_counts,
    "op4_ann": op4_ann,
    "op5_langid": op5_langid,
    "op6_sharding": op6_sharding,
    "op7_records": op7_records,
    "op8_quality": op8_quality,
    "op9_decontamination": op9_decontamination,
    "op10_mixing": op10_mixing,
}
ORACLE_SQL: dict[str, str] = {"op1_url_filter": OP1_SQL}
