"""Shared plumbing of the text operators: Arrow batches in, Arrow batches out, and cut lineage."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes handled at once by a Python worker: what bounds its memory, a single longer text aside.
SLICE_BYTES = 4 << 20
WHITE = b" \t\n\v\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names; only where it names none and all runs in one process, as in tests, one is
    made here. A folder of one machine would be lost to the others, so a cluster without one is an error."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder, so that no later job repeats their work."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle and checkpoint files of tables that nothing holds any more.

    It deletes them when the driver collects its garbage, which a driver with little to do puts off; so the files of all
    finished steps of a long job would lie on disk together.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch, each of about SLICE_BYTES of text or one longer row."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
    part = np.cumsum(sizes) // SLICE_BYTES
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(edges, edges[1:], strict=False):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def as_bytes(batch: pa.RecordBatch, text: str) -> list[bytes]:
    """The texts as UTF-8; a null counts as empty."""
    return [x or b"" for x in batch.column(text).cast(pa.binary()).to_pylist()]


def map_texts(df: DataFrame, text: str, keep: Sequence[str], fields: Sequence[T.StructField], fn: Callable[[list[bytes]], list]) -> DataFrame:
    """The columns ``keep`` of every row, and columns ``fields`` that ``fn`` computes from the texts' UTF-8.

    ``fn`` gets the texts of one slice (null as empty) and returns a list or array for each field. A kept column
    with the name of a computed one gives way to it.
    """
    keep = [c for c in keep if c not in {f.name for f in fields}]
    names = [f"k{i}" for i in range(len(keep))]
    source = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], F.col(f"`{text}`").cast("string").alias("body"))
    schema = T.StructType([T.StructField(n, source.schema[n].dataType) for n in names] + list(fields))
    types = [to_arrow(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "body"):
                made = [pa.array(x, t, from_pandas=False) for x, t in zip(fn(as_bytes(b, "body")), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *made], [*names, *(f.name for f in fields)])

    out = source.mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], *[f.name for f in fields])


def to_arrow(kind: T.DataType) -> pa.DataType:
    plain = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
    if isinstance(kind, T.ArrayType):
        return pa.list_(to_arrow(kind.elementType))
    return plain[kind.simpleString()]


def field(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the result."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(33))


#: Bytes over which word hashes are summed at once; a longer word makes its own block.
BLOCK = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
LENGTH = np.uint64(0xD6E8FEB86659FD93)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WHITE = np.isin(np.arange(256), list(WHITE))


@lru_cache(maxsize=1)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, modulo 2**64."""
    back = np.uint64(pow(int(BASE), -1, 2**64))
    return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (BASE, back))


class Tokens:
    """The words of texts, A-Z in lower case, as 64-bit hashes of their bytes, without an object for each.

    A word's hash is a polynomial over its bytes: a difference of running sums, brought back to the word's start.
    """

    def __init__(self, texts: list[bytes]) -> None:
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.data = LOWER[data]
        edge = np.diff(IS_WHITE[data].view(np.int8), prepend=np.int8(1))
        self.starts, self.ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        docs = np.cumsum([len(t) + 1 for t in texts])
        self.first = np.searchsorted(self.starts, np.concatenate([[0], docs]))
        self.counts = np.diff(self.first)
        self.hashes = np.zeros(len(self.starts), np.uint64)
        i = 0
        while i < len(self.starts):
            base = self.starts[i]
            j = max(i + 1, int(np.searchsorted(self.ends, base + BLOCK, "right")))
            own = self.data[base : self.ends[j - 1]]
            up, down = powers(max(BLOCK, 1 << (len(own) - 1).bit_length()))
            total = np.zeros(len(own) + 1, np.uint64)
            np.cumsum((own.astype(np.uint64) + np.uint64(1)) * up[: len(own)], out=total[1:])
            s, e = self.starts[i:j] - base, self.ends[i:j] - base
            self.hashes[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * LENGTH)
            i = j

    def words(self, which: np.ndarray) -> list[bytes]:
        whole = self.data.tobytes()
        return [whole[a:b] for a, b in zip(self.starts[which].tolist(), self.ends[which].tolist(), strict=True)]

    def documents(self) -> np.ndarray:
        """The number of each word's document."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def sequence_keys(self) -> np.ndarray:
        """One number (int64) for all documents with these words in this order."""
        place = np.arange(len(self.hashes)) - np.repeat(self.first[:-1], self.counts)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self.hashes + mix(place.astype(np.uint64) + np.uint64(1))))])
        return mix(total[self.first[1:]] - total[self.first[:-1]] + self.counts.astype(np.uint64)).view(np.int64)

    def classes(self) -> list[int | None]:
        """The sequence keys; none for documents without words."""
        return [k if n else None for k, n in zip(self.sequence_keys().tolist(), self.counts.tolist(), strict=True)]


def word_hashes(words: list[bytes]) -> np.ndarray:
    """The hashes that Tokens gives these words, which are in lower case, not empty and without white space."""
    return Tokens(words).hashes


def sort_segments(h: np.ndarray, first: np.ndarray) -> None:
    """Sorts each document's part of ``h`` in place; parts begin at ``first``, which has one end more."""
    edges = first.tolist()
    for a, b in zip(edges, edges[1:], strict=False):
        h[a:b].sort()


class Fresh:
    """Which documents of a task have a word sequence that it hasn't seen: copies are dealt out once a task."""

    def __init__(self, remembered: int = 1_000_000) -> None:
        self.seen: set[int] = set()
        self.remembered = remembered

    def __call__(self, tokens: Tokens) -> np.ndarray:
        if len(self.seen) > self.remembered:
            self.seen.clear()
        out = []
        for i, k in enumerate(tokens.classes()):
            if k is not None and k not in self.seen:
                self.seen.add(k)
                out.append(i)
        return np.array(out, np.int64)
