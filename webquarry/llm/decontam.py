"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

A spaced seed is a fixed mask of compared word positions; the positions between are
ignored, so a hash of the compared words survives substitutions in the gaps. The two ``MASKS``
together hit every aligned stretch of 11 to 20 words with at most one substitution in
five, wherever the substitutions fall (checked exhaustively in the tests). Items of up to ten words have masks of their
own length, laid over the whole item, that leave out every set of as many words as may differ.

Every document position gives one hash for each mask; a semi-join with the broadcast hashes of the test items
leaves the positions that hit, and only these take the words around them along. They are joined with the items'
seeds (broadcast if their counted bytes are few, else shuffled and salted), the aligned words are compared, and the hit counts when some
window of ``WINDOW`` words (the whole item, if shorter) around it agrees in ``SIMILARITY`` of
its words, or when ``EXACT`` consecutive words agree, however long the item is. Only bounded slices of words travel with a hit.

The hashes are broadcast in blocks of ``SEED_BLOCK`` at most (8 bytes each, some 32 in the join's table), each a
pass over the documents; the number of passes depends on the test set alone.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

MASKS = ((0, 1, 2, 3, 5), (0, 1, 4, 7, 8))
WINDOW = 20
SIMILARITY = 0.8
EXACT = 11  # the shortest stretch that MASKS are sure to hit
SEED_BLOCK = 2_000_000
BROADCAST_BYTES = 16 << 20  # of seeds with their words, as counted; beyond, they are joined shuffled
SALTS = 8  # there, a seed that very many positions hit is dealt to so many tasks


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("([\\p{L}\\p{N}]+)"), F.lit(1))


def least(n: int, similarity: float) -> int:
    """How many words of a window of n must agree."""
    return math.ceil(n * similarity - 1e-9)


def short_masks(n: int, similarity: float) -> list[tuple[int, tuple[int, ...]]]:
    """Masks (place in the item, offsets from there) over an item of n words; one is clean wherever the allowed substitutions fall.

    The words are dealt to blocks, three more than may differ (each word a block, if one may differ); each mask leaves out as many blocks as may differ.
    """
    off = n - least(n, similarity)
    blocks = n if off == 1 else min(n, off + 3)
    kept = [[i for i in range(n) if i * blocks // n not in out] for out in combinations(range(blocks), off)]
    return [(k[0], tuple(i - k[0] for i in k)) for k in kept]


def _seeds(df: DataFrame, keep: list[str], masks: dict[tuple[int, ...], Column]) -> DataFrame:
    """A row for each position ``p`` and mask (compared offsets, and where the mask is laid) of the words ``t``: keep, t, p, h.

    h is 0 where the mask doesn't fit, never null: neither a filter on it nor one on the words
    may be pushed to where it would be evaluated twice for every word. For the same reason the
    positions come from explode_outer, which has no inferred filter.
    """
    n, many, shortest = F.size("t"), len(masks), 1 + min(m[-1] for m in masks)
    places = F.when(n >= shortest, F.sequence(F.lit(0), many * (n - shortest + 1) - 1))
    each = df.select(*keep, "t", F.explode_outer(places).alias("q"))
    each = each.select(*keep, "t", F.expr(f"q div {many}").cast("int").alias("p"), F.expr(f"q % {many}").alias("m"))
    h = F.lit(0).cast("long")
    for i, (mask, where) in enumerate(masks.items()):
        fits = (F.col("m") == i) & (F.col("p") + mask[-1] < n) & where
        h = F.when(fits, F.xxhash64(F.lit(repr(mask)), *[F.get("t", F.col("p") + o) for o in mask])).otherwise(h)
    return each.withColumn("h", h)


def _around(side: int) -> tuple[Column, Column]:
    """The number of words before position ``p``, at most ``side``, and the words from there to ``side`` after it."""
    return F.least("p", F.lit(side)), F.slice("t", F.greatest(F.col("p") - side, F.lit(0)) + 1, F.lit(2 * side + 1))


def _found(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, seed_block: int = SEED_BLOCK, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, text_hash, item_id and the best window ``b`` (matched, window): one row for each text, id and item."""
    back, ctx = _around(WINDOW - 1)
    items, _ = written(bench.select(F.col(item_id).alias("item_id"), words(F.col(item_text)).alias("t")).where(F.size("t") > 0), "items")
    short = sorted(r["n"] for r in items.where(F.size("t") < EXACT).select(F.size("t").alias("n")).distinct().collect())  # ten at most
    n = F.size("t")
    laid = {m: n >= EXACT for m in MASKS}
    for k in short:
        for at, mask in short_masks(k, similarity):
            laid[mask] = laid.get(mask, F.lit(False)) | ((n == k) & (F.col("p") == at))
    seeds = _seeds(items, ["item_id"], laid).where("h <> 0").select("h", "item_id", n.alias("n"), back.alias("back"), ctx.alias("ctx")).distinct()
    seeds, _ = written(seeds, "seeds")
    hashes, _ = written(seeds.select("h").distinct(), "seed-hashes")
    blocks = max(1, -(-hashes.count() // seed_block))

    own = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), words(F.col(text_col)).alias("t"))
    at = _seeds(own, ["doc_id", "text_hash"], dict.fromkeys(laid, F.lit(True)))
    parts = [at.join(F.broadcast(hashes.where(F.pmod("h", F.lit(blocks)) == b) if blocks > 1 else hashes), "h", "left_semi") for b in range(blocks)]
    # A table between: the comparisons would otherwise move into the join's condition, which would then
    # copy a document's words for each of its positions.
    hits, _ = written(reduce(DataFrame.unionByName, [x.select("doc_id", "text_hash", "h", back.alias("dback"), ctx.alias("dctx")) for x in parts]), "hits")

    # A seed's words and, for each, an array's overhead.
    if (seeds.agg(F.sum(F.octet_length(F.array_join("ctx", "")) + 16 * F.size("ctx") + 64)).first()[0] or 0) <= broadcast_bytes:
        hits = hits.join(F.broadcast(seeds), "h")
    else:
        salt = F.pmod(F.xxhash64("doc_id", "text_hash", "dctx"), F.lit(SALTS)).cast("int")
        hits = hits.withColumn("salt", salt).join(seeds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["h", "salt"])
    # Agreement at each word of the item's context; beyond the document's ends nothing agrees.
    aligned = F.expr("transform(ctx, (w, k) -> if(coalesce(w = get(dctx, k - back + dback), false), 1, 0))")
    hits = hits.select("doc_id", "text_hash", "item_id", F.least("n", F.lit(WINDOW)).alias("window"), aligned.alias("eq"))
    best = F.expr(
        "array_max(transform(sequence(0, size(eq) - window), s -> aggregate(slice(eq, s + 1, window), 0, (a, x) -> a + x)))"
    )
    scored = hits.where(F.size("eq") >= F.col("window")).select("doc_id", "text_hash", "item_id", "window", best.alias("matched"))
    kept = scored.where(F.col("matched") >= F.ceil(F.col("window") * similarity - 1e-9))
    # The longest run of agreeing words; a hit lies in it, so that the context holds all of it up to a window.
    run = F.array_max(F.transform(F.split(F.array_join("eq", ""), "0"), lambda r: F.length(r)))
    exact = hits.where(F.array_join("eq", "").contains("1" * EXACT)).select("doc_id", "text_hash", "item_id", F.least(run, "window").alias("window"))
    kept = kept.unionByName(exact.withColumn("matched", F.col("window")))
    return kept.groupBy("doc_id", "text_hash", "item_id").agg(F.max(F.struct("matched", "window")).alias("b"))


def leaks(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, seed_block: int = SEED_BLOCK, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row for each document and test item that leaked into it.

    Columns: ``doc_id``, ``item_id``, ``matched`` (agreeing words of the best window),
    ``window`` (its length), ``overlap`` (their ratio); for an excerpt of ``EXACT`` words or more that fills no
    window, its own words. Null or empty texts on either side match nothing;
    items of under five words match verbatim only, so that a single word is an item too; repeated documents or items give one row
    for each id pair; other columns aren't read. Whole texts are scanned.
    """
    found = _found(docs, bench, id_col, text_col, item_id, item_text, similarity, seed_block, broadcast_bytes)
    out = found.groupBy("doc_id", "item_id").agg(F.max("b").alias("b"))
    return out.select("doc_id", "item_id", F.col("b.matched").cast("long").alias("matched"), F.col("b.window").cast("long").alias("window"), F.round(F.col("b.matched") / F.col("b.window"), 6).alias("overlap"))


def without_leaks(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents into which a test item leaked; all columns and clean rows stay.

    Documents are told apart by id and text, so that a clean text stays whose id (or null) a leaked row repeats.
    """
    found, _ = written(_found(docs, bench, id_col, text_col).select(F.col("doc_id").alias("__wq_id"), F.col("text_hash").alias("__wq_hash")).distinct(), "leaked")
    return docs.join(found, docs[id_col].eqNullSafe(F.col("__wq_id")) & (F.xxhash64(docs[text_col]) == F.col("__wq_hash")), "left_anti")
