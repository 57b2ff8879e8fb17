"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has 65,536 cells. Each shard owns ``vnodes`` points; a document's cell is the top 16
bits of a hash of its id and text, so that an id that many rows share is spread, and its shard is that of the next point clockwise. No shard takes more
than its bound, floor or ceil of rows/shards; documents beyond a full shard continue clockwise
to the next point whose shard has room. Bounds add up to the number of rows, so counts are at
most one apart (law ``rows``), and documents whose shard isn't full stay where the plain ring has them.

Only the cells' counts (at most 65,536 numbers) reach the driver, which lays out runs of each
cell; rows take their place from their rank in the cell. Cells hold 1/65,536 of the rows, but for rows that repeat
both id and text, which share a cell: their window is sorted with spilling.
"""

from __future__ import annotations

import bisect

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


CELLS = 1 << 16


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """Points (cell, shard) in clockwise order."""
    points = sorted((xxhash.xxh64_intdigest(f"shard-{s}-point-{v}"), s) for s in range(shards) for v in range(vnodes))
    return [(h >> 48, s) for h, s in points]


def layout(counts: dict[int, int], shards: int, vnodes: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (cell, first rank, end rank, shard, first slot) for the cells' counts.

    First every shard takes its own cells' rows in ring order up to its bound, then the
    overflow of each cell walks clockwise to the next shards with room.
    """
    points = ring(shards, vnodes)
    cells = [c for c, _ in points]
    owner = {c: bisect.bisect_left(cells, c) % len(points) for c in counts}
    natural = [0] * shards
    for c, n in counts.items():
        natural[points[owner[c]][1]] += n
    low, extra = divmod(sum(counts.values()), shards)
    room = [low] * shards
    for s in sorted(range(shards), key=lambda s: (-natural[s], s))[:extra]:
        room[s] += 1
    slot = [0] * shards
    runs, over = [], []

    def take(cell: int, first: int, end: int, s: int) -> int:
        n = min(end - first, room[s])
        if n:
            runs.append((cell, first, first + n, s, slot[s]))
            room[s] -= n
            slot[s] += n
        return first + n

    for c in sorted(counts):
        first = take(c, 0, counts[c], points[owner[c]][1])
        if first < counts[c]:
            over.append((c, first))
    for c, first in over:
        at = owner[c]
        while first < counts[c]:
            at = (at + 1) % len(points)
            first = take(c, first, counts[c], points[at][1])
    return runs


def assign(docs: DataFrame, shards: int = 8, vnodes: int = 256, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Every row with its shard: ``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``.

    size = UTF-8 bytes plus 1 (null text: 1; its CRC is that of the empty text, 0). slot is gapless from 0 in
    each shard. grown_shard is null, as bounds make a shard depend on all rows. With ``carry`` the
    input's other columns follow, where their names don't clash. Null ids and texts hash like any; repeated rows each
    get a slot of their own; an empty table gives no rows.
    """
    text = F.col(text_col)
    h = F.xxhash64(F.col(id_col), text)
    own = [
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    ]
    made = {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    rest = [F.col(c) for c in docs.columns if c != id_col and c not in made] if carry else []
    rows = docs.select(*own, *rest, F.shiftrightunsigned(h, 48).cast("int").alias("__wq_cell"), h.alias("__wq_h"))
    cells = docs.select(F.shiftrightunsigned(h, 48).cast("int").alias("cell")).groupBy("cell").count()
    runs = layout({r["cell"]: r["count"] for r in cells.collect()}, shards, vnodes)
    spark = docs.sparkSession
    schema = "__wq_c int, __wq_first long, __wq_end long, __wq_shard int, __wq_base long"
    # At most one run for each cell and a few for overflow: under 5 MB whatever the input's size.
    table = F.broadcast(spark.createDataFrame(runs, schema))
    order = Window.partitionBy("__wq_cell").orderBy("__wq_h", "doc_id", "text_crc32", "size")
    ranked = rows.withColumn("__wq_rank", F.row_number().over(order) - 1)
    placed = ranked.join(table, (F.col("__wq_cell") == F.col("__wq_c")) & (F.col("__wq_rank") >= F.col("__wq_first")) & (F.col("__wq_rank") < F.col("__wq_end")))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("__wq_shard").alias("shard"),
        (F.col("__wq_base") + F.col("__wq_rank") - F.col("__wq_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *rest,
    )
