"""Operator 4: sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame and SQL functions only.

Every shard owns many arcs of the ring. A row belongs to the arc its key falls on; the rows that a full shard cannot
take continue clockwise to the next shard with room. Where the overflow of each arc goes depends only on how many rows
each arc has, a table that the number of arcs bounds; it is laid over the rows by their rank within their arc.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklake.llm.common import table

SHARDS = 40
VIRTUAL = 256
#: The ring is cut into 2**CELL_BITS equal cells too, by which arcs are looked up.
CELL_BITS = 13


def ring(shards: int, virtual: int) -> list[tuple[int, int]]:
    """The virtual nodes as (position, shard), clockwise; positions are signed 64-bit integers."""
    node = lambda s, v: int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big", signed=True)
    return sorted((node(s, v), s) for s in range(shards) for v in range(virtual))


def arc_cells(nodes: list[tuple[int, int]], bits: int = CELL_BITS) -> list[tuple[int, int, int, int]]:
    """(cell, first position, last position, arc): arc i reaches up to node i; what is past the last node belongs to arc 0."""
    width = 1 << (64 - bits)
    out = []
    low = -(2**63)
    for arc, high in [*((i, p) for i, (p, _) in enumerate(nodes)), (0, 2**63 - 1)]:
        while low <= high:
            cell = (low + 2**63) // width
            end = min(high, (cell + 1) * width - 1 - 2**63)
            out.append((cell, low, end, arc))
            low = end + 1
    return out


def capacities(n: int, shards: int, slack: float) -> list[int]:
    """How many rows each shard may take: equal but for one at no slack, else up to that share more than the mean."""
    if slack > 0:
        return [-(-int(n * (1 + slack) + 0.999999) // shards)] * shards
    return [n // shards + (s < n % shards) for s in range(shards)]


def bounded_plan(counts: dict[int, int], nodes: list[tuple[int, int]], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, last rank, shard, first slot) for all rows: first each shard takes its own arcs' rows, clockwise,
    then what is left goes on clockwise to the next node whose shard has room."""
    room = list(room)
    taken = [0] * len(room)
    out, over = [], []

    def give(arc: int, rank: int, n: int, shard: int) -> None:
        out.append((arc, rank, rank + n - 1, shard, taken[shard]))
        taken[shard] += n
        room[shard] -= n

    for arc, (_, shard) in enumerate(nodes):
        n = counts.get(arc, 0)
        own = min(n, room[shard])
        if own:
            give(arc, 0, own, shard)
        if own < n:
            over.append((arc, own, n - own))
    skip = list(range(1, len(nodes) + 1))  # the next node worth a look, past those whose shard is full

    def next_with_room(i: int) -> int:
        path = []
        i %= len(nodes)
        while not room[nodes[i][1]]:
            path.append(i)
            i = skip[i] % len(nodes)
        for p in path:
            skip[p] = i
        return i

    for arc, rank, n in over:
        while n:
            shard = nodes[next_with_room(arc + 1)][1]
            part = min(n, room[shard])
            give(arc, rank, part, shard)
            rank, n = rank + part, n - part
    return out


def literal_table(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small table of bigints as a literal of the plan."""
    kind = f"array<struct<{','.join(f'{n}:bigint' for n in names)}>>"
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), kind)))


def ring_position(key: Column, fallback: Column) -> Column:
    """A key's place on the ring; rows without a key are placed by the fallback."""
    return F.when(key.isNotNull(), F.xxhash64(key)).otherwise(F.xxhash64(fallback))


def shard_rows(df: DataFrame, key: str = "doc_id", fallback: str = "text", tie: list[str] | None = None, shards: int = SHARDS, virtual: int = VIRTUAL, slack: float = 0.0) -> DataFrame:
    """Every row with its shard and slot (gapless from 0 in each shard).

    No shard takes more than its bound: with no slack, counts differ by one at most; with slack s, none exceeds the
    mean by more than that share, and fewer rows move when shards change. Keys are hashed; a null key is placed by the
    hash of ``fallback``, a null there too at one fixed place. Equal keys lie together until a bound parts them, in
    the order of ``tie`` (default: the fallback); rows equal in all of these may take each other's slots. An empty table
    gives an empty result. A column named shard or slot gives way.
    """
    spark = df.sparkSession
    nodes = ring(shards, virtual)
    names = [c for c in df.columns if c not in ("shard", "slot")]
    own = {c: f"k{i}" for i, c in enumerate(names)}
    placed = df.select(*[F.col(f"`{c}`").alias(k) for c, k in own.items()])
    placed = placed.withColumn("position", ring_position(F.col(own[key]), F.col(own[fallback])))
    placed = placed.withColumn("at_cell", F.shiftrightunsigned(F.col("position").bitwiseXOR(F.lit(-(2**63))), 64 - CELL_BITS))
    cells = literal_table(spark, arc_cells(nodes), ["cell", "low", "high", "on_arc"])
    on_arc = placed.join(F.broadcast(cells), (F.col("at_cell") == F.col("cell")) & F.col("position").between(F.col("low"), F.col("high")))
    counts = {r[0]: r[1] for r in on_arc.groupBy("on_arc").count().collect()}
    plan = bounded_plan(counts, nodes, capacities(sum(counts.values()), shards, slack))
    parts = literal_table(spark, plan, ["arc", "first", "last", "to_shard", "slots"])
    window = Window.partitionBy("on_arc").orderBy("position", *(own[c] for c in [key, *(tie or [fallback])]))
    ranked = on_arc.withColumn("rank", F.row_number().over(window) - 1)
    out = ranked.join(F.broadcast(parts), (F.col("on_arc") == F.col("arc")) & F.col("rank").between(F.col("first"), F.col("last")))
    return out.select(*[F.col(k).alias(c) for c, k in own.items()], F.col("to_shard").cast("int").alias("shard"), (F.col("slots") + F.col("rank") - F.col("first")).alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shard_rows(docs, "doc_id", "text_crc32", ["text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
