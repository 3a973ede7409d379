"""Operator 2: best-fit packing of tokenised documents into sequences of fixed capacity.

Packing depends only on how many pieces have each length, so the plan is made from that histogram, whose size the
capacity bounds, and then laid over the pieces by their rank within their length.

Token ids are those of the byte-level BPE in a ``tokenizers`` file. They are computed by ``tiktoken`` from the same
file's vocabulary, several times faster; a text with a special token's string goes through ``tokenizers`` itself.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tracklake.llm.common import as_bytes, cut, slices, table

CAPACITY = 1024
END = 2
#: Pieces of one length are ranked in independent parts, one for so many pieces of all lengths, so that a length that very many
#: share is spread; and in so many at most, whose counts reach the driver.
PART_ROWS, MOST_PARTS = 250_000, 1024


def token_bytes(token: str) -> bytes:
    """The bytes that a byte-level vocabulary writes as this string: printable bytes stand for themselves, the others for the code points from 256 up."""
    return bytes(unprinted().get(ord(c), ord(c) & 0xFF) for c in token)


@lru_cache(maxsize=1)
def unprinted() -> dict[int, int]:
    hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
    return {256 + i: b for i, b in enumerate(hidden)}


class ByteTokenizer:
    """Ids of texts by the byte-level BPE of a ``tokenizers`` JSON file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {token_bytes(t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.fast = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(path)

    def encode(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteTokenizer:
    return ByteTokenizer(path)


def piece_edges(n: int, capacity: int) -> list[int]:
    """Where a document of n ids is cut: all pieces are full but for the first."""
    first = n % capacity or min(n, capacity)
    return [0, *range(first, n + 1, capacity)]


def tokenize_pieces(df: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY, end: int = END, ids: bool = True) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32 and, if wanted, its ids.

    Every document ends with the id ``end``; a null text counts as empty, so it has that id alone.
    """
    where = path or public_tokenizers.path("byte_bpe_50k.json")
    source = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("body"))
    schema = T.StructType([source.schema["doc_id"], *(T.StructField(n, t) for n, t in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()))), *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(where)
        for whole in batches:
            for b in slices(whole, "body"):
                row, piece, start, length, crc, kept = [], [], [], [], [], []
                for i, data in enumerate(as_bytes(b, "body")):
                    own = np.array([*coder.encode(data.decode("utf-8", "replace")), end], dtype="<u4")
                    edges = piece_edges(len(own), capacity)
                    for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
                        row.append(i)
                        piece.append(k)
                        start.append(lo)
                        length.append(hi - lo)
                        crc.append(zlib.crc32(own[lo:hi].tobytes()))
                        if ids:
                            kept.append(own[lo:hi].astype(np.int32))
                columns = [b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(kept, pa.list_(pa.int32()))] if ids else []), names=schema.names)

    return source.mapInArrow(run, schema)


def packing_plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Moves (length, first rank, pieces, pieces per bin, first bin, offset) that place all pieces, and the number of bins.

    Pieces above a third of the capacity go at most two to a bin: the longest left with the longest that still fits,
    which pairs as many as can be. Then the shorter ones, longest first, go where they leave the least gap.
    Equal pieces and equally filled bins are dealt with together, so the work depends on the capacity alone.
    """
    left = {s: n for s, n in counts.items() if n}
    rank: dict[int, int] = defaultdict(int)
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []  # the gaps that bins have, ascending
    moves, bins = [], 0

    def add(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                bisect.insort(order, gap)
            gaps.setdefault(gap, []).append((first, n))

    def place(size: int, n: int, each: int, first: int, offset: int) -> None:
        moves.append((size, rank[size], n, each, first, offset))
        rank[size] += n
        left[size] -= n

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        a = large[-1]
        at = bisect.bisect_right(large, capacity - a) - 1
        b = large[at] if at >= 0 else None
        if b is None:
            n = left[a]
            place(a, n, 1, bins, 0)
        elif b == a:
            n = left[a] // 2
            if n:
                place(a, n, 1, bins, 0)
                place(a, n, 1, bins, a)
            elif at:  # the one left over takes the next shorter
                b = large[at - 1]
                n = 1
                place(a, n, 1, bins, 0)
                place(b, n, 1, bins, a)
            else:
                b, n = None, 1
                place(a, n, 1, bins, 0)
        else:
            n = min(left[a], left[b])
            place(a, n, 1, bins, 0)
            place(b, n, 1, bins, a)
        add(capacity - a - (b or 0), bins, n)
        bins += n
        large = [s for s in large if left[s]] if not left[a] or (b and not left[b]) else large
    for s in sorted((s for s in left if left[s]), reverse=True):
        while left[s]:
            at = bisect.bisect_left(order, s)
            if at == len(order):
                n = -(-left[s] // (capacity // s))
                add(capacity, bins, n)
                bins += n
                continue
            gap = order[at]
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                order.pop(at)
            each = gap // s
            full = min(n, left[s] // each)
            if full:
                place(s, full * each, each, first, capacity - gap)
                add(gap - each * s, first, full)
            else:
                each, full = left[s], 1
                place(s, each, each, first, capacity - gap)
                add(gap - each * s, first, 1)
            add(gap, first + full, n - full)
    return moves, bins


def pack_pieces(pieces: DataFrame, order: list[str], capacity: int = CAPACITY, parts: int | None = None) -> DataFrame:
    """The pieces with sequence_id and offset, in as few sequences of ``capacity`` as best-fit packing finds.

    ``pieces`` needs ``length``, from 1 to the capacity; every row is placed, repeated ones too, and those equal in ``order``
    may take each other's places. Columns named part_, rank_, sequence_id or offset give way; an empty table gives an empty
    result. Pieces of full length need a sequence each and no plan. The counts of the other lengths by part, at most
    ``capacity * MOST_PARTS`` numbers, are all that reaches the driver.
    """
    names = [c for c in pieces.columns if c not in ("part_", "rank_", "sequence_id", "offset")]
    pieces = cut(pieces.select(*names))
    below = pieces.filter(F.col("length") < capacity)
    parts = parts or max(1, min(MOST_PARTS, -(-below.count() // PART_ROWS)))
    below = below.withColumn("part_", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    told = below.groupBy("length", "part_").count().toArrow()
    bases = np.zeros((capacity + 1, parts), np.int64)
    bases[told["length"].to_numpy(), told["part_"].to_numpy()] = told["count"].to_numpy()
    moves, bins = packing_plan(dict(enumerate(bases.sum(axis=1).tolist())), capacity)
    bases = np.cumsum(bases, axis=1) - bases
    moves.sort()
    step = 1 << 44  # above any rank
    starts = np.array([m[0] * step + m[1] for m in moves], np.int64)
    each, first_bin, offset = (np.array([m[k] for m in moves], np.int64) for k in (3, 4, 5))
    first_rank = np.array([m[1] for m in moves], np.int64)
    rank = F.row_number().over(Window.partitionBy("length", "part_").orderBy(*order)).cast("long")
    ranked = below.withColumn("rank_", rank)
    schema = T.StructType([*(ranked.schema[n] for n in names), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, part, r = (b.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("length", "part_", "rank_"))
            r = r - 1 + bases[length, part]
            move = np.searchsorted(starts, length * step + r, side="right") - 1
            within = r - first_rank[move]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(first_bin[move] + within // each[move]), pa.array(offset[move] + within % each[move] * length)], names=schema.names)

    # The written pieces lie in fixed partitions in a fixed order, so these ids are the same whenever a task is run again.
    full = pieces.filter(F.col("length") == capacity).select(*names, (F.monotonically_increasing_id() + bins).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return ranked.mapInArrow(run, schema).union(full)


def pack_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY, end: int = END, ids: bool = True, parts: int | None = None) -> DataFrame:
    """A row for each piece of each document, with its ids and its place: sequence_id and offset.

    A null or empty text is packed as its end id alone; a longer document than the capacity is cut into full pieces,
    its first may be shorter. Repeated rows are packed as often as they occur, null doc_ids are kept, an
    empty table gives an empty result, and other columns of the input are not read.
    """
    return pack_pieces(tokenize_pieces(df, doc_id, text, path, capacity, end, ids), ["doc_id", "piece", "start", "ids_crc32"], capacity, parts)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), ids=False)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their ids, and where each lies: what training reads.

    A null or empty text is one piece, the end id alone; repeated rows are packed as often as they occur; an empty table gives
    an empty result. Of the documents' columns only doc_id and text are read.
    """
    return pack_documents(docs)
