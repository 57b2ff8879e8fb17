"""URL filters by a Bloom filter cascade.

Level 1 encodes the listed keys; level 2 the keys of the corpus that level 1 takes in wrongly;
level 3 the listed keys that level 2 takes in, and so on until a level takes in nothing
wrongly. A key of the corpus is listed exactly if the first level that rejects it is an even one.
Since the levels are fitted to the corpus's complete set of keys, membership is exact, and no
row is joined with the list.

Keys are hashed in the JVM to two 64-bit values. Levels are built distributed: each task fills its own
bits, the words meet in one bit_or aggregation. A level of n keys holds about 1.44 n bits for
every factor of two in its error rate; a list whose level would pass ``MAX_BITS`` is cut by hash into parts,
each with a cascade of its own, that are applied one after another.

A rule is a host and a path prefix, such as ``example.com/en/``. The candidates of an address are all its
host's parent domains combined with its path's prefixes, for the prefix lengths that rules have; the
longest listed candidate decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import remove, written

MAX_BITS = 1 << 27  # of one level; what is broadcast at once stays within some 40 MB
MAX_LEVELS = 64


def hashes(key: Column) -> list[Column]:
    """The two hash values of a key."""
    return [F.xxhash64(key), F.xxhash64(F.lit("second"), key)]


class Level:
    """One Bloom filter: ``bits`` (a power of two) in 64-bit words, ``k`` probes for each key."""

    def __init__(self, bits: int, k: int, number: int, words: np.ndarray | None = None):
        self.bits, self.k, self.number = bits, k, number
        self.words = np.zeros(bits // 64, dtype=np.uint64) if words is None else words

    @classmethod
    def sized(cls, n: int, rate: float, number: int) -> Level:
        k = max(1, math.ceil(math.log2(1 / rate)))
        need = max(64, math.ceil(n * k / math.log(2)))
        return cls(1 << (need - 1).bit_length(), k, number)

    def places(self, h1: np.ndarray, h2: np.ndarray) -> Iterator[np.ndarray]:
        with np.errstate(over="ignore"):
            step = (h2 ^ (np.uint64(self.number) * np.uint64(0x9E3779B97F4A7C15))) | np.uint64(1)
            at = h1 * (np.uint64(2 * self.number + 1)) + step
            for _ in range(self.k):
                yield (at >> np.uint64(17)) & np.uint64(self.bits - 1)
                at = at + step * np.uint64(0xC2B2AE3D27D4EB4F)

    def add(self, h1: np.ndarray, h2: np.ndarray) -> None:
        for p in self.places(h1, h2):
            np.bitwise_or.at(self.words, (p >> np.uint64(6)).astype(np.int64), np.uint64(1) << (p & np.uint64(63)))

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        found = np.ones(len(h1), dtype=bool)
        for p in self.places(h1, h2):
            found &= (self.words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
        return found


def listed(levels: Sequence[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Membership of corpus keys: the first rejecting level is even."""
    result = np.zeros(len(h1), dtype=bool)
    open_ = np.arange(len(h1))
    for level in levels:
        inside = level.has(h1[open_], h2[open_])
        result[open_[~inside]] = level.number % 2 == 0
        open_ = open_[inside]
    if len(levels):
        result[open_] = len(levels) % 2 == 1
    return result


def _u64(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def filled(level: Level, batches) -> tuple[np.ndarray, np.ndarray]:
    """The words that a task's keys set."""
    for b in batches:
        level.add(_u64(b.column(0)), _u64(b.column(1)))
    at = np.flatnonzero(level.words)
    return at, level.words[at].view(np.int64)


class Cascade:
    """A cascade over a universe of keys; build() makes one for each part of the list."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    @staticmethod
    def _fill(keys: DataFrame, level: Level) -> Level:
        size, k, number = level.bits, level.k, level.number

        def words(batches):
            at, bits = filled(Level(size, k, number), batches)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(bits, pa.int64())], names=["at", "bits"])

        got = keys.select("h1", "h2").mapInArrow(words, "at long, bits long").groupBy("at").agg(F.expr("bit_or(bits)").alias("bits"))
        for row in got.toLocalIterator():  # at most bits / 64 rows
            level.words[row["at"]] = np.array(row["bits"], dtype=np.int64).view(np.uint64)
        return level

    @classmethod
    def build(cls, listed_keys: DataFrame, other_keys: DataFrame) -> Cascade:
        """From the listed keys of the universe and all its other keys (h1, h2; each distinct)."""
        sides, levels = [listed_keys, other_keys], []
        counts = [listed_keys.count(), other_keys.count()]
        made: list[str] = []
        while counts[0] and len(levels) < MAX_LEVELS:
            rate = 0.5 if levels else min(0.5, max(2.0**-20, math.sqrt(0.5) * counts[0] / max(1, counts[1])))
            level = cls._fill(sides[0], Level.sized(counts[0], rate, len(levels) + 1))
            levels.append(level)
            if not counts[1]:
                break
            wrong, path = written(sides[1].where(member([level], F.col("h1"), F.col("h2"))), "false-positives")
            made.append(path)
            sides, counts = [wrong, sides[0]], [wrong.count(), counts[0]]
        else:
            if counts[0]:
                raise RuntimeError("keys that hash alike are both listed and not listed")
        remove(listed_keys.sparkSession, *made)
        return cls(levels)


def member(levels: list[Level], h1: Column, h2: Column) -> Column:
    """Membership as a column; the levels are broadcast to the workers."""
    held = SparkSession.active().sparkContext.broadcast([(x.bits, x.k, x.number, x.words) for x in levels])

    @F.arrow_udf(T.BooleanType())
    def inside(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(listed([Level(*x) for x in held.value], _u64(a), _u64(b)))

    return inside(h1, h2)


def any_member(levels: list[Level], keys: Column) -> Column:
    """For an array of structs with h1 and h2: an array of booleans."""
    held = SparkSession.active().sparkContext.broadcast([(x.bits, x.k, x.number, x.words) for x in levels])

    @F.arrow_udf(T.ArrayType(T.BooleanType()))
    def inside(a: pa.Array, b: pa.Array) -> pa.Array:
        found = listed([Level(*x) for x in held.value], _u64(a.flatten()), _u64(b.flatten()))
        sizes = np.concatenate([[0], np.cumsum(a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(found))

    return inside(F.transform(keys, lambda k: k["h1"]), F.transform(keys, lambda k: k["h2"]))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def domains(host: Column) -> Column:
    """The host and all its parent domains, longest first; none for an empty host."""
    part = F.split(host, r"\.")
    all_ = F.transform(F.sequence(F.lit(1), F.size(part)), lambda i: F.array_join(F.slice(part, i, F.size(part)), "."))
    return F.when(host != "", all_).otherwise(F.array().cast("array<string>"))


def candidates(host: Column, path: Column, lengths: list[int]) -> Column:
    """Keys host/path-prefix for each parent domain and prefix length that fits."""
    pre = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda p: p.isNotNull())
    return F.flatten(F.transform(domains(host), lambda d: F.transform(pre, lambda p: F.concat(d, p))))


def judge(pages: DataFrame, rules: list[tuple[str, str]], blocked_hosts: list[str], id_col: str = "page_id", url_col: str = "url", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per input row: ``page_id``, ``host``, ``path``, ``rule``, ``verdict`` (allow or block), ``listed_host``.

    rules: (host + path prefix, verdict), e.g. ("example.com/en/", "block"); the longest that fits decides.
    Without one, the verdict is block if the host or a parent domain is in ``blocked_hosts``
    (``listed_host`` tells), else allow. A null url or one without :// has empty host and path and is
    allowed. Repeated rows stay repeated; other columns are not read.
    """
    spark = pages.sparkSession
    verdicts = dict(rules)
    lengths = sorted({len(r) - r.index("/") for r in verdicts})
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    keyed = rows.withColumn("rule_keys", candidates(F.col("host"), F.col("path"), lengths)).withColumn("host_keys", domains(F.col("host")))

    # The complete key universe of the corpus; a key of a host list has no slash, so the kinds don't meet.
    every = keyed.select(F.explode(F.array_distinct(F.concat("rule_keys", "host_keys"))).alias("key")).distinct()
    universe, path = written(every.select("key", *[h.alias(n) for h, n in zip(hashes(F.col("key")), ("h1", "h2"))]), "keys")
    lists = {"allow": [r for r, v in rules if v == "allow"], "block": [r for r, v in rules if v == "block"], "host": list(blocked_hosts)}
    with_hash = lambda keys: F.transform(keys, lambda k: F.struct(k.alias("key"), *[h.alias(n) for h, n in zip(hashes(k), ("h1", "h2"))]))
    out = keyed.withColumn("rule_keys", with_hash(F.col("rule_keys"))).withColumn("host_keys", with_hash(F.col("host_keys")))
    for name, keys in lists.items():
        source = F.col("host_keys" if name == "host" else "rule_keys")
        out = out.withColumn(f"in_{name}", F.array().cast("array<string>"))
        own = spark.createDataFrame([(k,) for k in keys], "key string").distinct()
        parts = max(1, math.ceil(len(set(keys)) * 32 / max_bits))
        for part in range(parts):
            mine = F.pmod(F.xxhash64("key"), F.lit(parts)) == part
            inside = universe.join(own.where(mine), "key", "left_semi")
            outside = universe.join(own.where(mine), "key", "left_anti")
            if parts > 1:
                outside = outside.where(mine)
            found = Cascade.build(inside, outside).levels
            if not found:
                continue
            hit = F.zip_with(source, any_member(found, source), lambda k, m: F.when(m & (F.pmod(F.xxhash64(k["key"]), F.lit(parts)) == part), k["key"]))
            out = out.withColumn(f"in_{name}", F.concat(f"in_{name}", F.filter(hit, lambda k: k.isNotNull())))
    remove(spark, path)
    longest = lambda keys: F.reduce(keys, F.lit(None).cast("string"), lambda a, k: F.when(a.isNull() | (F.length(k) > F.length(a)), k).otherwise(a))
    out = out.withColumn("a", longest(F.col("in_allow"))).withColumn("b", longest(F.col("in_block"))).withColumn("listed_host", longest(F.col("in_host")))
    allow = F.col("b").isNull() & F.col("a").isNotNull() | (F.length("a") > F.length("b"))
    rule = F.when(allow, F.col("a")).otherwise(F.col("b"))
    verdict = F.when(rule.isNull(), F.when(F.col("listed_host").isNotNull(), "block").otherwise("allow")).when(allow, "allow").otherwise("block")
    return out.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "listed_host")
