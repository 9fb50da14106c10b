"""Contiguous shards of nearly equal bytes, in DataFrame functions only.

Texts are ordered by hash. All texts that share the first 14 bits form one atomic
group, so equal texts stay together and there are at most ``GROUPS`` group sizes
however large the table is: that bounds what the search on the driver reads.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from entitylink.session import materialize

GROUPS = 1 << 14
# Rows of one group are counted and numbered in this many parts.
PARTS = 64
OVERHEAD = 16


def minimax_cuts(sizes: list[int], shards: int) -> list[int]:
    """Index of the first size of shards 1, 2, ... for ordered atomic ``sizes``.

    Binary search for the smallest capacity at which filling shards greedily needs
    no more than ``shards``. Within that capacity each cut is then put at or before
    its equal share, no earlier than what follows can still hold.
    """
    ends = [0, *accumulate(sizes)]
    total = ends[-1]

    def fits(capacity: int) -> bool:
        at = 0
        for _ in range(shards):
            at = bisect_right(ends, ends[at] + capacity) - 1
            if at == len(sizes):
                return True
        return False

    low, high = max([*sizes, -(-total // shards)]), total
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    earliest = [len(sizes)]
    for _ in range(shards - 1):
        earliest.append(bisect_left(ends, ends[earliest[-1]] - low))
    earliest.reverse()
    cuts, at = [], 0
    for k in range(1, shards):
        latest = bisect_right(ends, ends[at] + low) - 1
        share = bisect_right(ends, k * total // shards) - 1
        at = max(at, earliest[k - 1], min(latest, share))
        cuts.append(at)
    return cuts


def sharded(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of ``docs`` (doc_id, text).

    Size is the UTF-8 bytes of the text plus 16. Shards are contiguous in hash order
    with the smallest possible largest shard; a slot counts a shard's rows from 0 by
    group, part and doc_id. Null text counts as empty; equal texts, repeated rows
    included, share a shard and differ in slot; a null doc_id sorts first. With an
    empty table there are no rows; a shard may be empty when one text outweighs it.
    Other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    group = F.floor(F.conv(F.substring(F.md5(text.cast("binary")), 1, 4), 16, 10).cast("int") * GROUPS / 65536).cast("int")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        group.alias("group"),
        F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(PARTS)).cast("int").alias("part"),
    )
    rows = materialize(rows, "sized")
    parts = rows.groupBy("group", "part").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    parts = materialize(parts, "parts")
    groups = parts.groupBy("group").agg(F.sum("bytes").alias("bytes")).orderBy("group").collect()  # at most GROUPS rows
    cuts = [groups[i]["group"] if i < len(groups) else GROUPS for i in minimax_cuts([g["bytes"] for g in groups], shards)]
    shard = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("group"))) if cuts else F.lit(0)
    before = Window.partitionBy("shard").orderBy("group", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("shard", shard.cast("int")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    number = F.row_number().over(Window.partitionBy("group", "part").orderBy("doc_id", "text_crc32", "size")) - 1
    placed = rows.join(offsets.select("group", "part", "shard", "offset"), ["group", "part"])
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + number).cast("long").alias("slot"))
