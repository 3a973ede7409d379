"""Connected components of a link table, as joins and aggregates whose state stays distributed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.llm.common import cut, release

#: Parts into which the rows of a key are split for a join, if more rows than this have it. So the other side's copies of
#: that key's row, one for each part, are never more than the rows that meet them.
PARTS = 256
#: Links that a task contracts at once, about: what bounds its memory.
LINKS = 500_000


def split_rows(rows: DataFrame, key: str, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows with their part_ (0 but for frequent keys, whose rows are dealt by the hash of ``by``), and the frequent keys.

    Keys are counted before they are shuffled. ``rows`` must be cut, as they are read twice. Rows meet the frequent keys by key and part, so no key gathers in one task here.
    """
    frequent = rows.groupBy(F.col(key).alias("key_")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > PARTS).select("key_")
    parts = frequent.select(F.col("key_"), F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("of_"))
    dealt = rows.withColumn("part_", F.pmod(F.xxhash64(*by), F.lit(PARTS)).cast("int"))
    met = dealt.join(parts, (F.col(key) == F.col("key_")) & (F.col("part_") == F.col("of_")), "left")
    return met.withColumn("part_", F.coalesce("of_", F.lit(0))).drop("key_", "of_"), frequent


def join_split(split: DataFrame, frequent: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """Rows of ``split_rows`` joined with a table in which each key is once; a frequent key's row is repeated for each part."""
    parts = F.when(F.col("key_").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(PARTS - 1)))
    repeated = table.join(frequent, F.col(key) == F.col("key_"), "left").withColumn("part_", F.explode(parts)).drop("key_")
    return split.join(repeated, [key, "part_"]).drop("part_")


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of every node but the roots, each the least node that it reaches by these links."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    up = np.arange(len(nodes))
    while len(a):
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (up[up] != up).any():
            up = up[up]
        a, b = up[a], up[b]
        a, b = a[a != b], b[a != b]
    low = up != np.arange(len(nodes))
    return nodes[low], nodes[up[low]]


def contracted(links: DataFrame) -> DataFrame:
    """Links (u, v) that connect the same nodes, at most one for each node and about LINKS of the links given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for b in batches:
            held.append(tuple(b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)))
            n += b.num_rows
            if n >= 2 * LINKS:
                held = [forest(*map(np.concatenate, zip(*held, strict=True)))]
                n = len(held[0][0])
                if n >= LINKS:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["u", "v"])
                    held, n = [], 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest(*map(np.concatenate, zip(*held, strict=True)))], names=["u", "v"])

    return links.coalesce(max(1, -(-links.count() // LINKS))).mapInArrow(run, "u long, v long")


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of a link; root is the least node that it reaches. ``links``, of bigints, are read twice.

    Tasks first contract about LINKS links each to a forest of the same components, so that chains and rings among these
    cost no rounds. Then each round gives a node the least label among its own and its neighbours', then follows that label's own label,
    so that long chains shrink by halves. Null ends and links from a node to itself add nothing. A node with very many links,
    and a label that very many nodes have, are split among tasks.
    """
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    pairs = cut(contracted(pairs))
    edges = pairs.union(pairs.select("v", "u"))
    labels = cut(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root")))
    split, hubs = split_rows(edges, "v", ["u"])
    split = cut(split)
    while True:
        seen = join_split(split, hubs, "v", labels.select(F.col("node").alias("v"), "root"))
        near = seen.groupBy(F.col("u").alias("node")).agg(F.min("root").alias("near"))
        low = cut(labels.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root")))
        if low.filter("was <> root").isEmpty():
            return low.select("node", "root")
        jump = low.select(F.col("node").alias("root"), F.col("root").alias("far"))
        release(low.sparkSession)
        members, large = split_rows(low.select("node", "root"), "root", ["node"])
        labels = cut(join_split(members, large, "root", jump).select("node", F.least("root", "far").alias("root")))
