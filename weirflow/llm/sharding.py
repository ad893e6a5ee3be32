"""Sharding by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirflow.llm.common import session, table, unused

SHARDS, VIRTUAL = 8, 128
#: The ring has 2^RING_BITS positions; keys are counted in cells of equal length, and only the counts reach the driver.
RING_BITS, CELL_BITS = 60, 12


def ring(shards: int, virtual: int = VIRTUAL) -> list[tuple[int, int]]:
    """(position, shard) of all virtual nodes, clockwise. A shard's nodes don't depend on how many shards there are."""
    digest = lambda s: int.from_bytes(hashlib.blake2b(s.encode(), digest_size=8).digest(), "big") >> 64 - RING_BITS
    return sorted((digest(f"shard {k} node {v}"), k) for k in range(shards) for v in range(virtual))


def allot(cells: list[tuple[int, int]], nodes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Where the keys of each cell go.

    cells: (cell, rows), a cell's keys belonging to the first node at or after the cell's start. Shards hold
    floor(n / shards) rows or one more; cells are dealt clockwise, and rows that find their shard full go on clockwise
    to the next node whose shard has room. Returns (cell, first rank, rows, shard, first slot).
    """
    n = sum(c for _, c in cells)
    room = [n // shards + (k < n % shards) for k in range(shards)]
    used, out = [0] * shards, []
    at, width = [p for p, _ in nodes], 1 << RING_BITS - CELL_BITS
    for cell, count in sorted(cells):
        k, rank = bisect_left(at, cell * width), 0
        while count:
            s = nodes[k % len(nodes)][1]
            take = min(count, room[s] - used[s])
            if take:
                out.append((cell, rank, take, s, used[s]))
                used[s] += take
                rank += take
                count -= take
            k += 1
    return out


def shard_rows(df: DataFrame, keys: tuple[str, ...] = ("doc_id",), text_col: str = "text", shards: int = SHARDS, virtual: int = VIRTUAL) -> DataFrame:
    """Deal all rows of df to `shards` shards of sizes at most one row apart.

    A row's place on the ring is a hash of its keys and text, so rows that share a key, or have none, spread as well.
    Adds shard int and slot long (from 0 without gaps in each shard). Null keys and texts hash as nulls; which of several
    equal rows takes which slot is arbitrary, and they are alike; ties on the ring go by the keys; texts of any length are hashed
    whole; an empty table gives no rows; columns named like the new ones are replaced, all others stay. Only the counts of 2^CELL_BITS ring cells reach the driver.
    """
    session(df.sparkSession)
    spark = df.sparkSession
    at, cell, place = unused(df, "at", "cell", "place")
    begin, n, to_shard, to_slot = unused(df, "begin", "n", "to_shard", "to_slot")
    placed = df.withColumn(at, F.shiftrightunsigned(F.xxhash64(*keys, text_col), 64 - RING_BITS)).withColumn(cell, F.shiftrightunsigned(at, RING_BITS - CELL_BITS))
    counts = [(r[0], r[1]) for r in placed.groupBy(cell).count().collect()]
    segments = allot(counts, ring(shards, virtual), shards)
    to = spark.createDataFrame(segments, f"{cell} long, {begin} long, {n} long, {to_shard} int, {to_slot} long")
    rank = F.row_number().over(Window.partitionBy(cell).orderBy(at, *keys)) - 1
    ranked = placed.withColumn(place, rank.cast("long"))
    joined = ranked.join(F.broadcast(to), cell).where((F.col(place) >= F.col(begin)) & (F.col(place) < F.col(begin) + F.col(n)))
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in ("shard", "slot")]
    return joined.select(*kept, F.col(to_shard).alias("shard"), (F.col(to_slot) + F.col(place) - F.col(begin)).alias("slot"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns; law `rows`: shard sizes are at most one row apart."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    out = shard_rows(docs, ("doc_id",), "text_crc32")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
