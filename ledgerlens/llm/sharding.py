"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of the ring; a key goes clockwise to the next point.  Shard
loads are bounded: a key whose shard is full goes on clockwise to the next shard that has
room.  All keys between two neighbouring points (an arc) try the shards in the same order, so
the walk is made once over the arcs, whose number is set by parameters, and not over the keys:
arcs are filled in ring order, and of an arc's keys, in hash order, the first go to its own
shard and the rest, as far as it is full, to the next ones.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: points of a shard on the ring
VNODES = 128
#: ring positions are 0 .. 2^RING_BITS - 1
RING_BITS = 16
#: copies of one row that one exploded row stands for
COPIES = 10_000
#: distinct rows of one place that are ranked in one task; a place of more is cut by hash
PLACE_ROWS = 100_000


def ring(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node, in ring order."""
    at = {}
    for shard in range(shards):
        for v in range(vnodes):
            at.setdefault(xxhash.xxh64_intdigest(f"{shard}/{v}") >> (64 - RING_BITS), shard)
    return sorted(at.items())


def capacities(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """Bounds that add up to all rows at least; without slack, at most one apart."""
    if slack:
        return [-int(-rows * (1 + slack) // shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def fill(points: list[tuple[int, int]], counts: dict[int, int],
         room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, past the last rank, shard, first slot) of the walk over all arcs."""
    free, used, out = list(room), [0] * len(room), []
    for arc in sorted(counts):
        rank, left, at = 0, counts[arc], arc
        while left:
            shard = points[at % len(points)][1]
            n = min(left, free[shard])
            if n:
                out.append((arc, rank, rank + n, shard, used[shard]))
                free[shard] -= n
                used[shard] += n
                rank, left = rank + n, left - n
            at += 1
    return out


def arcs(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(place, index of the first point at or after it) of every place; past the last point
    the ring closes."""
    at, out = 0, []
    for place in range(1 << RING_BITS):
        while at < len(points) and points[at][0] < place:
            at += 1
        out.append((place, at % len(points)))
    return out


def _ranked(rows: DataFrame, place_rows: int) -> DataFrame:
    """``rows`` with ``rank0``, the copies before a row in its arc, by place and hash.

    Places (2^RING_BITS at most) are cut into cells of about ``place_rows`` distinct rows; counts
    of the cells are summed along an arc, and only the rows of one cell are sorted together.
    """
    hot = (rows.groupBy("place").agg(F.count(F.lit(1)).alias("distinct_rows"))
           .select("place", F.ceil(F.col("distinct_rows") / place_rows).alias("cells")))
    key = F.xxhash64("doc_id", "size", "text_crc32")
    rows = rows.join(F.broadcast(hot), "place").withColumn("cell", F.pmod(key, F.col("cells")))
    earlier = Window.unboundedPreceding, -1
    along = Window.partitionBy("arc").orderBy("place", "cell").rowsBetween(*earlier)
    inside = Window.partitionBy("place", "cell").orderBy("doc_id", "size", "text_crc32").rowsBetween(*earlier)
    bases = (rows.groupBy("arc", "place", "cell").agg(F.sum("copies").alias("held"))
             .select("place", "cell", F.coalesce(F.sum("held").over(along), F.lit(0)).alias("base")))
    return (rows.withColumn("within", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
            .join(bases, ["place", "cell"])
            .select("arc", "doc_id", "size", "text_crc32", "copies", (F.col("base") + F.col("within")).alias("rank0")))


def shard_rows(docs: DataFrame, shards: int = 8, vnodes: int = VNODES, slack: float = 0.0,
               place_rows: int = PLACE_ROWS) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)`` of every row of ``docs(doc_id, text)``.

    The key is the doc_id (null: one key of its own).  Loads are rows: with ``slack`` 0 the shards'
    row counts are at most one apart; with more, a shard takes at most ``1 + slack`` times its
    share and fewer rows move when shards change.  ``slot`` is gapless from 0 in a shard.  ``size`` is the UTF-8 bytes of the text
    plus 1 (null text: 1, crc 0).  Rows that agree in id, size and crc are ranked together and
    spread again afterwards, so no number of repeated rows meets in one task, and more than
    ``place_rows`` different rows of one place (a null or repeated id) are ranked in cells.  Further columns
    are ignored; no rows give no rows.
    """
    if shards < 1 or vnodes < 1 or slack < 0:
        raise ValueError("shards and vnodes must be positive, slack not negative")
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    place = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))),
                                 64 - RING_BITS)
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        (F.octet_length(raw).cast("long") + 1).alias("size"), F.crc32(raw).alias("text_crc32"))
            .groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
            .withColumn("place", place))
    points = ring(shards, vnodes)
    spark = docs.sparkSession
    borders = F.broadcast(spark.createDataFrame(arcs(points), "place long, arc int"))   # 2^RING_BITS rows
    rows = rows.join(borders, "place")
    counts = {r["arc"]: r["n"] for r in                        # shards x vnodes rows at most
              rows.groupBy("arc").agg(F.sum("copies").alias("n")).collect()}
    walk = fill(points, counts, capacities(sum(counts.values()), shards, slack))
    plan = F.broadcast(spark.createDataFrame(walk or [(-1, 0, 0, 0, 0)],
                                             "arc int, lo long, hi long, shard int, slot0 long"))
    ranked = _ranked(rows, place_rows)
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long")))
    spread = (ranked.withColumn("from", chunk)
              .withColumn("copy", F.explode(F.sequence(
                  F.col("from"), F.least(F.col("from") + (COPIES - 1), F.col("copies") - 1))))
              .withColumn("rank", F.col("rank0") + F.col("copy")))
    return (spread.join(plan, "arc").where("rank >= lo and rank < hi")
            .select("doc_id", "size", "text_crc32", "shard", (F.col("slot0") + F.col("rank") - F.col("lo")).alias("slot")))
