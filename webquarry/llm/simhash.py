"""SimHash near-duplicates with pigeonring candidate filtering.

Fingerprints: 64 bits over word shingles. Two fingerprints are linked when they differ in at
most ``TAU`` = 2 bits. The 64 bits are cut into three ring segments; by the pigeonring
principle a pair within 2 bits has a start segment from which every chain prefix stays within
its proportional budget: first segment 0 differing bits, first two at most 1, all three at
most 2. The first condition is the equi-join key, the second prunes inside the join, the third
is the full Hamming check.

Skew: copies collapse to one fingerprint before any join. A segment bucket with more than
``PAIR_BUCKET`` distinct fingerprints is never paired: its members emit the fingerprints at
distance <= 1 that keep the start segment, and members that meet in such a neighbour are linked.
Two fingerprints are within 2 bits exactly if they share a neighbour, and at most 65 distinct
fingerprints share one, so this is exact and linear in the bucket's size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_slices, connected_components, written

TAU = 2
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # (offset, width) on the ring
PAIR_BUCKET = 32
SEED = 42
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8).reshape(-1, 1), axis=1).astype(np.int64)


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned 64-bit SimHash of the whole text; 0 for null or wordless text.

    Words are runs of bytes other than ASCII white space after lower-casing A-Z; shingles of
    ``width`` words count with repeats; shorter texts are one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= width:
        hashes = digest(line, SEED)
    else:
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(size + 1) - 1
        starts = (ends - size)[: len(words) - width + 1].tolist()
        hashes = b"".join([digest(line[i:j], SEED) for i, j in zip(starts, ends[width - 1 :].tolist())])
    n = len(hashes) // 8
    if n < 64:
        ones = np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(n, 8), axis=1).sum(axis=0, dtype=np.int64)
    else:
        at = np.frombuffer(hashes, dtype=np.uint8).reshape(n, 8)
        ones = np.concatenate([np.bincount(at[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@F.arrow_udf(T.LongType())
def fingerprint_udf(texts: pa.Array) -> pa.Array:
    return by_slices(texts, lambda rows: pa.array([_signed(fingerprint(t)) for t in rows], pa.int64()))


def links(fps: DataFrame, tau: int = TAU) -> DataFrame:
    """Links (``a``, ``b``) between distinct fingerprints (column ``fp``) within 2 bits.

    Pairs of small buckets are all found; big buckets give spanning links (see module text).
    """
    if tau != TAU:
        raise ValueError("the ring budgets are laid out for two differing bits")
    fp = F.col("fp")
    cut = [F.shiftrightunsigned(fp, off).bitwiseAND(F.lit((1 << width) - 1)) for off, width in SEGMENTS]
    keyed = fps.select(fp, F.explode(F.array(*[F.struct(F.lit(i).alias("i"), c.alias("seg")) for i, c in enumerate(cut)])).alias("k")).select("fp", "k.i", "k.seg")
    sizes = keyed.groupBy("i", "seg").agg(F.count("*").alias("n")).where("n > 1")
    shared, _ = written(keyed.join(sizes, ["i", "seg"]), "segments")

    few = shared.where(F.col("n") <= PAIR_BUCKET).drop("n")
    a, b = few.alias("a"), few.alias("b")
    differ = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    second = F.lit(False)
    for i in range(3):
        off, width = SEGMENTS[(i + 1) % 3]
        mask = _signed(((1 << width) - 1) << off)
        second = second | ((F.col("a.i") == i) & (F.bit_count(differ.bitwiseAND(F.lit(mask))) <= 1))
    paired = a.join(
        b,
        (F.col("a.i") == F.col("b.i")) & (F.col("a.seg") == F.col("b.seg")) & (F.col("a.fp") < F.col("b.fp")) & second & (F.bit_count(differ) <= tau),
    ).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))

    flips = F.lit(None)
    for i, (off, width) in enumerate(SEGMENTS):
        masks = [0] + [_signed(1 << k) for k in range(64) if not off <= k < off + width]
        flips = F.when(F.col("i") == i, F.array(*[F.lit(m).cast("long") for m in masks])).otherwise(flips)
    near = shared.where(F.col("n") > PAIR_BUCKET).select("i", "fp", F.explode(flips).alias("m")).select("i", "fp", F.expr("fp ^ m").alias("z"))
    met = near.groupBy("i", "z").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    spanned = met.select("a", F.explode("all").alias("b")).where("a <> b")
    return paired.unionByName(spanned).distinct()


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fp, root (the group's smallest fingerprint) and component_id."""
    slim, _ = written(docs.select(F.col(id_col).alias("doc_id"), fingerprint_udf(F.col(text_col)).alias("fp")), "fingerprints")
    reps = slim.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    reps, _ = written(reps, "representatives")
    roots, _ = written(connected_components(links(reps.select("fp"))), "components")
    named = reps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    of = named.join(least, "root").select("fp", "root", "component_id")
    return slim.join(of, "fp").select("doc_id", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``.

    component_id is the smallest non-null id reachable over links, the row's own id included.
    Null, empty and wordless texts have fingerprint zero and link like any other; repeated rows
    stay repeated; an empty table gives no rows; other columns of the input are not read.
    """
    return grouped(docs, id_col, text_col).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate group, all columns kept.

    The row with the smallest id stays; of rows that repeat this id within the group any one
    stays. A group whose ids are all null keeps one of its rows. Only the ids that go (or that
    repeat) are joined with the rows.
    """
    found, _ = written(grouped(docs, id_col, text_col).toDF("__wq_id", "__wq_fp", "__wq_root", "__wq_comp"), "groups")
    stays = F.col("__wq_id").eqNullSafe(F.col("__wq_comp"))
    repeated = found.groupBy("__wq_id").agg(F.count("*").alias("n")).where("n > 1").select("__wq_id")
    gone, _ = written(found.where(~stays).select("__wq_id").unionByName(repeated).distinct(), "removed")
    same = F.col(id_col).eqNullSafe(F.col("__wq_id"))
    kept = docs.join(gone, same, "left_anti")
    repeated, _ = written(repeated, "repeated")
    if not repeated.take(1):
        return kept
    # Rows with repeated ids: looked up by id and fingerprint, one for each group whose smallest id it is.
    again = docs.join(repeated, same, "left_semi").withColumn("__wq_own", fingerprint_udf(F.col(text_col)))
    member = found.where(stays).select("__wq_id", "__wq_fp", "__wq_root").distinct()
    again = again.join(member, same & (F.col("__wq_own") == F.col("__wq_fp"))).dropDuplicates(["__wq_id", "__wq_root"])
    return kept.unionByName(again.select(docs.columns))
