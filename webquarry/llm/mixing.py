"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

Weights are w_s ~ share_s ** a over the sources' token shares. The exponent a in [0, 1] is
bisected: the largest that reaches the target entropy, raised if needed until no source
is repeated more often than the limit. Each source then gets budget * w_s tokens: whole epochs over all its
documents, and a last part epoch.

Documents are dealt to blocks of a source by hash; every epoch puts the blocks and the documents in
each block in an order of its own. The part epoch takes blocks in its order; the block that crosses the
budget gives, in its order, every document that still fits; longer ones are skipped, so that a source misses
its quota by less than the smallest document skipped. A hot source has many blocks, so that
no window holds a large share of the rows.
"""

from __future__ import annotations

import math

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .token_count import count_udf

BLOCK_TOKENS = 1 << 17
MAX_BLOCKS = 1 << 14  # of a source
MAX_SOURCES = 100_000  # planned on the driver and broadcast; more are planned and joined as a table
SALTS = 16  # there, a source's rows are dealt to so many tasks
BROADCAST_BLOCKS = 200_000  # rows of some 40 bytes; beyond, blocks are joined shuffled
SEED = 17


def weights(tokens: list[int], exponent: float) -> list[float]:
    """Normalised shares to the power ``exponent``; sources without tokens get 0."""
    total = sum(tokens)
    raw = [(t / total) ** exponent if t else 0.0 for t in tokens]
    return [x / sum(raw) for x in raw] if total else [0.0 for _ in tokens]


def entropy(w: list[float]) -> float:
    return -sum(x * math.log(x) for x in w if x > 0)


def measure(tokens: list[int], budget: int):
    """Of an exponent: the mix's entropy, and the most epochs that a source gets."""
    live = [t for t in tokens if t]

    def at(a: float) -> tuple[float, float]:
        w = weights(live, a)
        return entropy(w), max(budget * x / t for x, t in zip(w, live))

    return at


def measure_table(sources: DataFrame, total: int, budget: int):
    """``measure`` over a table (t) of any number of sources: an aggregate for each exponent."""
    share = F.col("t") / total

    def at(a: float) -> tuple[float, float]:
        raw = F.pow(share, F.lit(float(a)))
        r = sources.where("t > 0").agg(F.sum(raw).alias("z"), F.sum(raw * F.log(share)).alias("l"), F.max(raw / F.col("t")).alias("m")).first()
        return math.log(r["z"]) - a * r["l"] / r["z"], budget * r["m"] / r["z"]

    return at


def temperature(at, live: int, target: float | None, repeats: float | None) -> float:
    """The exponent: entropy >= target * log(sources) where possible, and no source over ``repeats`` epochs.

    ``at`` measures an exponent, live is the number of sources that have tokens.
    The repetition limit wins over the entropy. At 1 the mix is proportional; where even this
    breaks the limit (budget over repeats * tokens), 1 is returned.
    """
    if live < 2:
        return 1.0

    def boundary(low: float, high: float, left) -> tuple[float, float]:
        """Narrows (low, high): left holds at low and not at high."""
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if left(at(mid)) else (low, mid)
        return low, high

    even = lambda m: m[0] >= target * math.log(live) - 1e-12
    over = lambda m: m[1] > repeats
    a = 1.0
    if target is not None and not even(at(1.0)):
        a = boundary(0.0, 1.0, even)[0]
    if repeats is not None and over(at(a)):
        a = boundary(a, 1.0, over)[1]
    return a


def token_measure(text: Column) -> Column:
    """Byte-BPE tokens as op3 counts them; 0 for null."""
    return count_udf(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)(text)


def plan(tokens: dict, budget: int | None, target: float | None, repeats: float | None) -> tuple[float, list[tuple]]:
    """(exponent, rows (source, weight, quota, epochs, rest, blocks)); quotas by largest remainder."""
    names = sorted(tokens, key=lambda s: (s is not None, s))
    sizes = [tokens[s] for s in names]
    budget = sum(sizes) if budget is None else budget
    a = temperature(measure(sizes, budget), sum(t > 0 for t in sizes), target, repeats)
    w = weights(sizes, a)
    exact = [budget * x for x in w]
    quota = [int(x) for x in exact]
    if any(w):
        for i in sorted(range(len(w)), key=lambda i: quota[i] - exact[i])[: budget - sum(quota)]:
            quota[i] += 1
    if repeats is not None:  # the limit also binds after rounding, and where no exponent could keep it
        quota = [min(q, int(repeats * t)) for q, t in zip(quota, sizes)]
    rows = []
    for s, x, q, t in zip(names, w, quota, sizes):
        epochs, rest = divmod(q, t) if t else (0, 0)
        rows.append((s, x, q, epochs, rest, max(1, min(MAX_BLOCKS, t // BLOCK_TOKENS))))
    return a, rows


def plan_table(sources: DataFrame, budget: int | None, target: float | None, repeats: float | None) -> tuple[float, DataFrame]:
    """``plan`` for a table (source, t) of more sources than the driver should hold; its rows as a table."""
    r = sources.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("t"), F.count(F.when(F.col("t") > 0, 1)).alias("live")).first()
    total = r["t"]
    budget = total if budget is None else budget
    a = temperature(measure_table(sources, max(1, total), budget), r["live"], target, repeats)
    raw = F.when(F.col("t") > 0, F.pow(F.col("t") / max(1, total), F.lit(a))).otherwise(0.0)
    z = sources.agg(F.sum(raw)).first()[0] or 1.0
    rows = sources.select(F.col("source").alias("s"), "t", (raw / z).alias("weight"))
    rows, _ = written(rows.withColumn("exact", budget * F.col("weight")).withColumn("quota", F.floor("exact")), "sources")
    # Fewer rows of a few bytes than there are sources get one token more.
    more = rows.where("t > 0").orderBy(F.col("quota") - F.col("exact"), "s").limit(int(budget - (rows.agg(F.sum("quota")).first()[0] or 0)) if total else 0)
    rows = rows.join(more.select(F.col("s").alias("m"), F.lit(1).alias("one")), F.col("s").eqNullSafe(F.col("m")), "left").withColumn("quota", F.col("quota") + F.coalesce("one", F.lit(0)))
    if repeats is not None:
        rows = rows.withColumn("quota", F.least("quota", F.floor(F.lit(float(repeats)) * F.col("t"))))
    per = F.greatest("t", F.lit(1))
    blocks = F.greatest(F.lit(1), F.least(F.lit(MAX_BLOCKS), F.floor(F.col("t") / BLOCK_TOKENS))).cast("int")
    rows = rows.select("s", "weight", "quota", F.expr("quota div greatest(t, 1)").alias("epochs"), F.when(F.col("t") > 0, F.col("quota") % per).otherwise(0).cast("long").alias("rest"), blocks.alias("blocks"))
    return a, written(rows, "sources-planned")[0]


def _hash(id_col: str, text_col: str) -> Column:
    """Tells rows apart, but for rows that repeat id and text."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def _block(seed: int, h: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), h), blocks).cast("int")


def fitting(rows: pa.Table) -> pa.Table:
    """The rows of one cut block, by position, that fit into what is left of ``take``."""
    rows = rows.sort_by("position")
    left, keep = rows["take"][0].as_py(), []
    for n in rows["n_tokens"].to_pylist():
        keep.append(n <= left)
        left -= n if n <= left else 0
    return rows.filter(pa.array(keep, pa.bool_()))


class Mix:
    """The plan of one mix: sources, blocks, and the rows' uses."""

    def __init__(self, docs: DataFrame, budget: int | None, target: float | None, repeats: float | None, seed: int, id_col: str, text_col: str, source_col: str):
        spark = docs.sparkSession
        self.seed = seed
        slim = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), _hash(id_col, text_col).alias("h"), token_measure(F.col(text_col)).alias("n_tokens"))
        slim = slim.withColumn("copy", F.row_number().over(Window.partitionBy("h", "source").orderBy("n_tokens")))
        slim, _ = written(slim, "mix-rows")
        per, _ = written(slim.groupBy("source").agg(F.sum("n_tokens").alias("t")), "source-tokens")
        self.few = per.count() <= MAX_SOURCES
        if self.few:
            self.exponent, rows = plan({r["source"]: r["t"] for r in per.collect()}, budget, target, repeats)
            self.sources = spark.createDataFrame(rows, "s string, weight double, quota long, epochs long, rest long, blocks int")
        else:
            self.exponent, self.sources = plan_table(per, budget, target, repeats)
        dealt = self.with_source(slim, F.col("source"), F.col("h"), self.sources, "s").drop("s", "quota")
        self.rows = dealt.withColumn("block", _block(seed, F.col("h"), F.col("blocks"))).drop("blocks")
        blocks = self.rows.groupBy("source", "block").agg(F.sum("n_tokens").alias("t"), F.first("epochs").alias("epochs"), F.first("rest").alias("rest"))
        in_part = Window.partitionBy("source").orderBy(self.turn("epochs", "source", "block"), "block")
        before = F.sum("t").over(in_part.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("t")
        take = F.least(F.greatest(F.col("rest") - before, F.lit(0)), F.col("t"))
        self.blocks, _ = written(blocks.withColumn("take", take).select(F.col("source").alias("s"), F.col("block").alias("b"), "t", "epochs", "take"), "mix-blocks")

    def with_source(self, rows: DataFrame, source: Column, h: Column, sources: DataFrame, name: str) -> DataFrame:
        """rows joined with their source's row (of which ``name`` is the source)."""
        if self.few:
            return rows.join(F.broadcast(sources), source.eqNullSafe(F.col(name)))
        spread = sources.withColumn("__wq_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return rows.withColumn("__wq_mine", F.pmod(h, F.lit(SALTS)).cast("int")).join(spread, source.eqNullSafe(F.col(name)) & (F.col("__wq_mine") == F.col("__wq_salt"))).drop("__wq_mine", "__wq_salt")

    def turn(self, epoch: str, source: str, block: str) -> Column:
        """The order of blocks in an epoch."""
        return F.xxhash64(F.lit(self.seed), epoch, source, block)

    def of_block(self) -> Column:
        return F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))

    def used(self, rows: DataFrame, blocks: DataFrame) -> DataFrame:
        """The rows in their blocks' epochs, in each epoch's order, the part epoch cut to its budget."""
        last = F.when(F.col("take") > 0, F.col("epochs")).otherwise(F.col("epochs") - 1)
        uses = blocks.where(last >= 0).select("s", "b", "t", "take", F.col("epochs").alias("whole"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("epoch"))
        uses = uses.withColumn("block_rank", F.row_number().over(Window.partitionBy("s", "epoch").orderBy(self.turn("epoch", "s", "b"), "b")) - 1)
        cut = (F.col("epoch") == F.col("whole")) & (F.col("take") < F.col("t"))
        part = self.placed(rows, uses.where(cut))
        return self.placed(rows, uses.where(~cut)).unionByName(part.groupBy("source", "block").applyInArrow(fitting, part.schema))

    def placed(self, rows: DataFrame, uses: DataFrame) -> DataFrame:
        """The rows in these uses of their blocks, each with its position in the block."""
        rows = rows.join(uses.drop("t", "whole"), self.of_block()).drop("s", "b")
        own = Window.partitionBy("source", "epoch", "block").orderBy(F.xxhash64(F.lit(self.seed), "epoch", "h", "copy"), "h", "copy", "n_tokens")
        return rows.withColumn("position", F.row_number().over(own) - 1)


def mix(docs: DataFrame, budget: int | None = None, target: float | None = 0.95, repeats: float | None = 2.0, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix, one row for each use of a document.

    Columns: ``doc_id``, ``source``, ``n_tokens``, ``copy`` (number among rows that repeat id, source and
    text), ``epoch``, ``block``, ``block_rank`` (order of blocks in the epoch), ``position`` (in the block,
    skipped documents counted), ``weight`` (the planned share), ``exponent``. budget defaults to all tokens. A null source is a source of its own;
    null or empty texts have 0 tokens and come once in each whole epoch; an empty table gives no rows.
    """
    m = Mix(docs, budget, target, repeats, seed, id_col, text_col, source_col)
    return m.used(m.rows, m.blocks).select("doc_id", "source", "n_tokens", "copy", "epoch", "block", "block_rank", "position", "weight", F.lit(m.exponent).alias("exponent"))


def mixed(docs: DataFrame, budget: int | None = None, target: float | None = 0.95, repeats: float | None = 2.0, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` in the mix: every row as often as ``mix`` uses it, all columns kept.

    A block that the part epoch takes whole or not at all settles its documents where they lie;
    only the blocks that are cut (at most one a source) are joined with their chosen documents.
    """
    m = Mix(docs, budget, target, repeats, seed, id_col, text_col, source_col)
    own = lambda df: df.select(*[F.col(c).alias(f"__wq_{c}") for c in df.columns])
    source = F.col(source_col).cast("string")
    rows = docs.withColumn("__wq_key", _hash(id_col, text_col))
    rows = m.with_source(rows, source, F.col("__wq_key"), own(m.sources.select("s", "blocks")), "__wq_s").drop("__wq_s")
    rows = rows.withColumn("__wq_block", _block(seed, F.col("__wq_key"), F.col("__wq_blocks"))).drop("__wq_blocks")
    blocks = m.blocks.select("s", "b", "epochs", (F.col("take") == F.col("t")).alias("whole"), (F.col("take") > 0).alias("part"))
    if m.blocks.count() <= BROADCAST_BLOCKS:
        blocks = F.broadcast(blocks)
    rows = rows.join(own(blocks), source.eqNullSafe(F.col("__wq_s")) & (F.col("__wq_block") == F.col("__wq_b")))
    cut = F.col("__wq_part") & ~F.col("__wq_whole")
    times = F.col("__wq_epochs") + F.col("__wq_part").cast("long")
    settled = rows.where(~cut & (times > 0)).select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), times)).alias("__wq_use")).drop("__wq_use")
    cut_blocks = m.blocks.where("take > 0 AND take < t")
    cuts = cut_blocks.select(F.col("s").alias("s2"), F.col("b").alias("b2"))
    cuts = F.broadcast(cuts) if m.few else cuts  # at most one a source
    chosen = m.used(m.rows.join(cuts, F.col("source").eqNullSafe(F.col("s2")) & (F.col("block") == F.col("b2")), "left_semi"), cut_blocks)
    chosen = own(chosen.groupBy("source", "h", "copy").agg(F.count("*").cast("long").alias("times")))
    numbered = rows.where(cut).withColumn("__wq_n", F.row_number().over(Window.partitionBy("__wq_key", source_col).orderBy(F.lit(0))))
    some = numbered.join(chosen, source.eqNullSafe(F.col("__wq_source")) & (F.col("__wq_key") == F.col("__wq_h")) & (F.col("__wq_n") == F.col("__wq_copy")))
    some = some.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("__wq_times"))).alias("__wq_use")).drop("__wq_use")
    return settled.unionByName(some)
