"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, law ``rows``.

Every shard owns ``vnodes`` points of a 64-bit ring; a row belongs to the arc, and so to the shard,
that follows its key's hash clockwise. Loads are bounded by row counts: the capacities are
floor(n / shards), one more for the first n mod shards of them, so they add up to n and no two
shards differ by more than one row. What a full shard can't take continues clockwise to the next
point whose shard has room.

Scale: one pass counts the rows of each arc (at most shards x vnodes rows reach the driver, whatever
the input), the driver lets the surplus flow around the ring, and a second pass ranks the rows
within their arcs. Texts are reduced to size and CRC before anything is shuffled. Equal rows are
one row with a count while they are ranked, so repeated rows and null ids make no hot task.

Defined results: the key is doc_id, and the text where doc_id is null; a null text has size 16 and
the CRC of no bytes, 0; repeated rows each take a place of their own; an empty table gives none.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Points of each shard on the ring.
VNODES = 100
#: Bytes that a row takes besides its text.
ROW_BYTES = 16


def ring(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """The points in ring order, (signed 64-bit place, shard); a shard's points never depend on the others."""
    points = set()
    for s in range(shards):
        for v in range(vnodes):
            h = hashlib.sha256(f"{s}:{v}".encode()).digest()
            points.add((int.from_bytes(h[:8], "big", signed=True), s))
    return sorted(points)


def flow(counts: dict[int, int], points: list[tuple[int, int]], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Segments (arc, first rank, end rank, shard, first slot): where the rows of each arc go.

    First every arc's own shard takes what it has room for, in ring order; then what is left of each
    arc continues clockwise. Afterwards no row is left, as the capacities add up to the rows.
    """
    n, used = len(points), [0] * len(capacity)
    out, left = [], []
    for arc, (_, s) in enumerate(points):
        rows = counts.get(arc, 0)
        take = min(rows, capacity[s] - used[s])
        if take:
            out.append((arc, 0, take, s, used[s]))
            used[s] += take
        if rows > take:
            left.append((arc, take, rows))
    ahead = list(range(n))  # the next point that may have room, with path halving

    def room(i: int) -> int:
        while capacity[points[i][1]] == used[points[i][1]]:
            j = ahead[i] if ahead[i] != i else (i + 1) % n
            ahead[i] = ahead[j] if capacity[points[j][1]] == used[points[j][1]] and ahead[j] != j else j
            i = j
        return i

    for arc, at, rows in left:
        i = arc
        while at < rows:
            i = room(i)
            s = points[i][1]
            take = min(rows - at, capacity[s] - used[s])
            out.append((arc, at, at + take, s, used[s]))
            used[s] += take
            at += take
    return out


def assign(docs: DataFrame, shards: int, vnodes: int = VNODES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """For each row of docs: doc_id, size, text_crc32, law, shard, slot (gapless from 0 in a shard)."""
    spark = docs.sparkSession
    points = ring(shards, vnodes)
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.when(F.col(key).isNull(), F.xxhash64(text)).otherwise(F.xxhash64(key)).alias("place"),
    )
    arcs = _arc_table(rows, points)
    counts = {r[0]: r[1] for r in arcs.groupBy("arc").count().collect()}  # at most shards x vnodes rows
    n = sum(counts.values())
    capacity = [n // shards + (s < n % shards) for s in range(shards)]
    segments = spark.createDataFrame(flow(counts, points, capacity) or [(-1, 0, 0, 0, 0)], "arc int, lo long, hi long, shard int, slot0 long")
    same = arcs.groupBy("arc", "place", "doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    order = Window.partitionBy("arc").orderBy("place", "doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = same.withColumn("rank0", F.coalesce(F.sum("copies").over(order), F.lit(0)))
    # at most shards x vnodes + shards segments, whatever the input
    placed = ranked.join(F.broadcast(segments.withColumnRenamed("arc", "seg_arc")), (F.col("arc") == F.col("seg_arc")) & (F.col("lo") < F.col("rank0") + F.col("copies")) & (F.col("rank0") < F.col("hi")))
    first, end = F.greatest("lo", "rank0"), F.least("hi", F.col("rank0") + F.col("copies"))
    slots = F.explode(F.sequence(F.col("slot0") + first - F.col("lo"), F.col("slot0") + end - F.col("lo") - 1))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", slots.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _arc_table(rows: DataFrame, points: list[tuple[int, int]]) -> DataFrame:
    """rows with arc: ring places are cut into equal cells, each with the points inside it."""
    spark = rows.sparkSession
    bits = 12
    places = [p for p, _ in points]
    cells = []
    for c in range(1 << bits):
        lo = (c << (64 - bits)) - (1 << 63)
        a, b = bisect.bisect_left(places, lo), bisect.bisect_left(places, lo + (1 << (64 - bits)))
        cells.append((c, a, places[a:b]))
    table = spark.createDataFrame(cells, "cell int, base int, inside array<long>")
    cell = F.shiftrightunsigned(F.col("place").bitwiseXOR(F.lit(-(1 << 63))), 64 - bits).cast("int")
    joined = rows.withColumn("cell", cell).join(F.broadcast(table), "cell")  # 4096 rows
    arc = F.col("base") + F.size(F.filter("inside", lambda p: p < F.col("place")))
    return joined.withColumn("arc", (arc % len(points)).cast("int")).drop("cell", "base", "inside")
