"""Approximate nearest neighbours by multi-index hashing of learned, rotated binary codes.

Codes: vectors are centred, turned to their principal axes and rotated so that signs lose as little as
possible (iterative quantisation), fitted on a bounded sample of ``FIT_ROWS`` rows. A code of
b bits is split into substrings of 16 bits. By the pigeonhole principle every code within Hamming
radius r of a query agrees within floor(r / m) bits in one of m substrings (one less in all but the first
r - m * floor(r / m) + 1), so probing the substring tables with all masks of that many bits retrieves
every code in the radius. Those are checked on the full code and reranked by their float vectors.

The radius is learned on the fit sample, as the one that holds ``TARGET`` of true neighbours there; the
neighbours in the whole table are nearer still. Queries that find fewer than k rows in it are searched again, with a
radius that widens until each group of rows yields k, so that k neighbours are always found if there are as many.

Distribution: the rows are dealt to groups of bounded size by hash. One shuffle brings each group's rows together with
a copy of every query behind them; a task indexes its group once, then streams the queries past the tables,
and k rows a query and group go on to one top-k. The number of scans doesn't depend on the number of queries,
no task holds more than one group and a batch of queries, nothing is collected or broadcast but the codes' matrix, and nothing pairs rows with rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

FIT_ROWS = 8_000
FIT_QUERIES = 200
TARGET = 0.97
SUB = 16  # bits of a substring
GROUP_ROWS = (16_384, 262_144)  # rows of a group, in small and in large tables
GROUPS = 256  # as many groups, while they keep to these sizes
ROUNDS = 30


def usable(vector: Column) -> Column:
    """Neither null, empty nor zero, and all components finite."""
    v = F.coalesce(vector, F.array().cast("array<double>"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0)


class Codes:
    """Rotated sign codes of ``bits`` bits, a multiple of 16."""

    def __init__(self, mean: np.ndarray, turn: np.ndarray, radius: int):
        self.mean, self.turn, self.radius = mean, turn, radius
        self.bits = turn.shape[1]

    def of(self, x: np.ndarray) -> np.ndarray:
        """Codes as (rows, substrings) of 16 bits."""
        sign = (x - self.mean) @ self.turn > 0
        return np.packbits(sign, axis=1).view(np.uint16)

    @classmethod
    def fit(cls, x: np.ndarray, k: int, seed: int = 3) -> Codes:
        """From sample rows; deterministic."""
        rng = np.random.default_rng(seed)
        x = np.unique(x, axis=0)
        dim = x.shape[1]
        bits = max(SUB, dim // SUB * SUB)
        mean = x.mean(axis=0)
        z = x - mean
        _, axes = np.linalg.eigh(z.T @ z)
        axes = axes[:, ::-1][:, :bits]
        if bits > axes.shape[1]:  # fewer dimensions than bits: random directions fill up
            axes = np.concatenate([axes, rng.normal(size=(dim, bits - axes.shape[1]))], axis=1)
        p = z @ axes
        rot = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
        for _ in range(ROUNDS):
            u, _, v = np.linalg.svd(np.where(p @ rot > 0, 1.0, -1.0).T @ p)
            rot = (u @ v).T
        made = cls(mean, axes @ rot, bits)
        pick = rng.permutation(len(x))[:FIT_QUERIES]
        codes = made.of(x)
        near = []
        for q in pick:
            d = ((x - x[q]) ** 2).sum(axis=1)
            d[q] = np.inf
            top = np.argsort(d)[: min(k, len(x) - 1)]
            near.append(hamming(codes[q], codes[top]))
        found = np.concatenate(near) if near else np.zeros(0)
        made.radius = int(np.quantile(found, TARGET, method="higher")) if len(found) else bits
        return made


def hamming(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    return np.bitwise_count(many ^ one).sum(axis=1, dtype=np.int64)


@cache
def masks(most: int) -> np.ndarray:
    """All 16-bit masks of at most ``most`` bits."""
    every = np.arange(1 << SUB, dtype=np.uint32)
    return every[np.bitwise_count(every) <= most].astype(np.uint16)


class Tables:
    """A chunk's substring tables: rows sorted by each substring's value, with the place of every value."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.rows, self.starts = [], []
        for s in range(codes.shape[1]):
            order = np.argsort(codes[:, s], kind="stable")
            self.rows.append(order)
            self.starts.append(np.concatenate([[0], np.cumsum(np.bincount(codes[:, s], minlength=1 << SUB))]))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code lies within ``radius``, by pigeonhole probing."""
        m = len(self.rows)
        low, more = divmod(radius, m)
        found = np.zeros(len(self.codes), dtype=bool)
        for s in range(m):
            most = low if s <= more else low - 1
            if most < 0:
                break
            if most >= SUB:
                return np.flatnonzero(hamming(code, self.codes) <= radius)
            at = (masks(most) ^ code[s]).astype(np.int64)
            first, n = self.starts[s][at], self.starts[s][at + 1] - self.starts[s][at]
            hit = n > 0
            first, n = first[hit], n[hit]
            places = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
            found[self.rows[s][places]] = True
        rows = np.flatnonzero(found)
        return rows[hamming(code, self.codes[rows]) <= radius]


class Group:
    """A group's rows (``ids``, vectors ``x``, how often each row occurs) and their tables."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, times: np.ndarray, codes: Codes):
        self.ids, self.x, self.times, self.codes = ids, x, times, codes
        self.tables = Tables(codes.of(x))

    def nearest(self, qid: int, q: np.ndarray, code: np.ndarray, k: int, widen: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the k nearest rows in the radius, a row as often as it occurs, the query's own occurrence left out."""
        radius = self.codes.radius
        while True:
            rows = self.tables.within(code, radius)
            own = rows[self.ids[rows] == qid]
            own = own[(self.x[own] == q).all(axis=1)]
            if not widen or self.times[rows].sum() - len(own) >= k or radius >= self.codes.bits:
                break
            radius = min(self.codes.bits, radius + 4)
        times = self.times[rows] - np.isin(rows, own)
        d = np.sqrt(((self.x[rows] - q) ** 2).sum(axis=1))
        ids, d = np.repeat(self.ids[rows], times), np.repeat(d, times)
        if len(d) > k:
            keep = d <= np.partition(d, k - 1)[k - 1]
            ids, d = ids[keep], d[keep]
        order = np.lexsort((ids, d))[:k]
        return ids[order], d[order]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(group, whether queries, part of the batch) of a batch that is sorted by both."""
    key = batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield int(key[a]) // 2, int(key[a]) % 2, batch.slice(a, b - a)


def search_batches(batches: Iterator[pa.RecordBatch], codes: Codes, k: int, widen: bool) -> Iterator[pa.RecordBatch]:
    """A task's part: batches of (grp, asks, vec_id, times, x), sorted by group with its queries last; k rows a query come out."""
    held, at, group = [], None, None
    for batch in batches:
        for g, asks, part in runs(batch):
            if g != at:
                held, at, group = [], g, None
            ids, x = part.column(2).to_numpy(), _matrix(part.column(4))
            if not asks:
                held.append((ids, x, part.column(3).to_numpy()))
                continue
            if group is None:
                if not held:
                    continue
                group, held = Group(*(np.concatenate(c) for c in zip(*held)), codes), []
            found = [group.nearest(int(i), v, c, k, widen) for i, v, c in zip(ids, x, codes.of(x))]
            sizes = [len(i) for i, _ in found]
            keys = part.column(3).to_numpy()
            columns = [np.repeat(ids, sizes), np.repeat(keys, sizes), np.concatenate([i for i, _ in found]), np.concatenate([d for _, d in found])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "key", "vec_id", "score"])


def search(vectors: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest rows of every row whose id is divisible by ``every``.

    Columns ``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` (Euclidean distance in double precision), ties to
    the smaller id. Vectors that are null, empty, zero or hold null or non-finite components take no
    part, nor do rows with a null id, nor vectors that haven't the table's most frequent length (the longer of two as frequent).
    A query's own row alone isn't its candidate: other rows with its id are, and so are further rows that repeat it wholly.
    Rows that share an id but differ in vector are queries of their own; rows that repeat id and vector are one query. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col)
    schema = "query_id long, rank int, vec_id long, score double"
    rows = vectors.where(usable(v) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("x"))
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("x") == sizes["d"])
    fit = rows.select("x").orderBy(F.xxhash64("x")).limit(FIT_ROWS).collect()
    codes = spark.sparkContext.broadcast(Codes.fit(np.array([r["x"] for r in fit]), k))

    low, high = GROUP_ROWS
    groups = -(-sizes["count"] // max(low, min(high, sizes["count"] // GROUPS)))
    # More than k + 1 copies of a row can't be told from k + 1.
    once = rows.groupBy("vec_id", "x").agg(F.least(F.count("*"), F.lit(k + 1)).alias("times"))
    once, _ = written(once, "vectors")
    queries = once.where(F.col("vec_id") % every == 0).select("vec_id", F.xxhash64("x").alias("key"), "x")
    own = once.select(F.pmod(F.xxhash64("vec_id", "x"), F.lit(groups)).alias("grp"), F.lit(0).alias("asks"), "vec_id", "times", "x")

    def nearest(queries: DataFrame, widen: bool) -> DataFrame:
        every_group = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("grp")
        asked = queries.select(every_group, F.lit(1).alias("asks"), "vec_id", F.col("key").alias("times"), "x")
        dealt = own.unionByName(asked).repartition(int(groups), "grp").sortWithinPartitions("grp", "asks")
        found = dealt.mapInArrow(_searcher(codes, k, widen), "query_id long, key long, vec_id long, score double")
        order = Window.partitionBy("query_id", "key").orderBy("score", "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    best, _ = written(nearest(queries, False), "nearest")
    full = best.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), "key")
    short, _ = written(queries.join(full, ["vec_id", "key"], "left_anti"), "short-queries")
    if not short.isEmpty():
        again = nearest(short, True)
        best = best.join(short.select(F.col("vec_id").alias("query_id"), "key"), ["query_id", "key"], "left_anti").unionByName(again)
    return best.select("query_id", "rank", "vec_id", "score")


def _searcher(codes, k: int, widen: bool):
    def run(batches):
        return search_batches(batches, codes.value, k, widen)

    return run
