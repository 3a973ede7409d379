"""Operator 7: exact n-gram Jaccard join with set-relation skipping.

Documents with the same words form one class. A class's shingles are ordered by how many classes have them, rarest
first; two similar sets must share one of the first few, so only those are indexed. Relations between sets already
compared spare most comparisons: a set is first held against one likely relative in its index lists; lists are then
read by blocks, the groups of sets around one such relative, and a block is skipped if its best position and sizes
cannot reach the threshold, or if it is connected already. What two groups' members can share is bounded by what
their centres share, and what each member has beyond its centre; only pairs within that bound are compared.

Shingles travel as packed arrays of hashes, a row for each task and hash range, not as rows of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklake.llm.common import BASE, Fresh, Tokens, as_bytes, cut, field, map_texts, mix, release, slices, sort_segments, table
from tracklake.llm.components import connected_components, join_split, split_rows

WORDS = 5
#: Jaccard similarity of at least PERCENT / 100.
PERCENT = 75
#: Shingles that one group of the reducers holds, about.
GROUP = 4_000_000
#: Shingles that a mapper gathers before it sends them.
BUFFER = 1_000_000
#: Rounds in which sets are held against one likely relative, each by another order of the sets.
ROUNDS = 3
#: Bits of a shingle's hash that a mapper sends; a hash range tells the others, so it has at least those.
SENT, LEAST_BITS = 56, 8
U8, U4, U2, U1 = np.dtype("<u8"), np.dtype("<u4"), np.dtype("<u2"), np.dtype("u1")


def shingle_sets(tokens: Tokens, docs: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of these documents, ascending within each, and their documents' numbers."""
    own, n = tokens.hashes, max(0, len(tokens.hashes) - words + 1)
    h = np.zeros(n, np.uint64)
    for j in range(words):
        h = h * BASE + own[j : j + n]
    h = np.concatenate([mix(h), np.zeros(len(own) - n, np.uint64)])
    counts = tokens.counts[docs]
    short = (counts > 0) & (counts < words)
    h[tokens.first[docs[short]]] = tokens.sequence_keys()[docs[short]].view(np.uint64)
    sizes = np.where(short, 1, np.maximum(counts - words + 1, 0))
    ends = np.cumsum(sizes)
    h = h[np.repeat(tokens.first[docs] - ends + sizes, sizes) + np.arange(sizes.sum())]
    sort_segments(h, np.concatenate([[0], ends]))
    at = np.repeat(np.arange(len(docs)), sizes)
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1])
    return h[new], at[new]


def memberships(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Every row's doc_id, hash of the text, class and count of words; no class for texts without words."""

    def label(texts: list[bytes]) -> list:
        tokens = Tokens(texts)
        return [tokens.classes(), tokens.counts]

    source = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), text_key(text).alias("text_key"))
    return map_texts(source, "text", ["doc_id", "text_key"], [field("class", T.LongType()), field("words", T.LongType())], label)


def text_key(text: str) -> F.Column:
    return F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))


def packed_shingles(df: DataFrame, text: str, bits: int, groups: int) -> DataFrame:
    """Shingles by hash range (bucket): classes, shingles of each, and the hashes' lower SENT bits in three parts.

    Buckets from 2**bits up hold classes and their numbers of shingles instead, by class.
    """
    source = df.select(F.col(f"`{text}`").cast("string").alias("body"))
    schema = "bucket int, classes binary, counts binary, low binary, middle binary, high binary"
    names = ["bucket", "classes", "counts", "low", "middle", "high"]
    if bits < LEAST_BITS:
        raise ValueError(f"a range's number must tell {LEAST_BITS} bits of the hashes in it")

    def pack(keys: np.ndarray, h: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        rows: list[tuple] = []
        own = np.bincount(at, minlength=len(keys))
        place = (keys % np.uint64(groups)).astype(np.int64)
        for g in np.unique(place):
            rows.append(((1 << bits) + int(g), keys[place == g].tobytes(), own[place == g].astype(U4).tobytes(), b"", b"", b""))
        bucket = (h >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.int64)
        order = np.argsort(bucket, kind="stable")
        h, at, bucket = h[order], at[order], bucket[order]
        edges = np.flatnonzero(np.diff(bucket)) + 1
        for lo, hi in zip([0, *edges], [*edges, len(h)], strict=True):
            if hi > lo:
                first = np.flatnonzero(np.diff(at[lo:hi], prepend=-1))
                counts = np.diff(first, append=hi - lo)
                part = h[lo:hi]
                rows.append((int(bucket[lo]), keys[at[lo:hi][first]].tobytes(), counts.astype(U4).tobytes(), part.astype(U4).tobytes(), (part >> np.uint64(32)).astype(U2).tobytes(), (part >> np.uint64(48)).astype(U1).tobytes()))
        kinds = [pa.int32(), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh = Fresh()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n = 0
        for whole in batches:
            for b in slices(whole, "body"):
                tokens = Tokens(as_bytes(b, "body"))
                docs = fresh(tokens)
                if not len(docs):
                    continue
                h, at = shingle_sets(tokens, docs)
                held.append((tokens.sequence_keys()[docs].view(np.uint64), h, at))
                n += len(h)
                if n >= BUFFER:
                    yield pack(*joined(held))
                    held, n = [], 0
        if held:
            yield pack(*joined(held))

    return source.mapInArrow(run, schema)


def joined(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    shift = np.cumsum([0, *(len(k) for k, _, _ in held)])
    return np.concatenate([k for k, _, _ in held]), np.concatenate([h for _, h, _ in held]), np.concatenate([a + s for (_, _, a), s in zip(held, shift, strict=False)])


def blobs(column: pa.ChunkedArray, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def shared_shingles(packed: DataFrame, bits: int, groups: int) -> DataFrame:
    """By group of classes: the shingles that two or more classes have, with the number of those, at most 65535."""
    schema = "chunk int, classes binary, totals binary, counts binary, hashes binary, frequency binary"
    names = ["chunk", "classes", "totals", "counts", "hashes", "frequency"]
    kinds = [pa.int32(), *[pa.binary()] * 5]

    def count(key: tuple, rows: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        classes, counts = blobs(rows["classes"], U8), blobs(rows["counts"], U4).astype(np.int64)
        _, first = np.unique(classes, return_index=True)
        if bucket >= 1 << bits:
            out = [(bucket - (1 << bits), classes[first].tobytes(), counts[first].astype(U4).tobytes(), b"", b"", b"")]
            return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        h = blobs(rows["low"], U4).astype(np.uint64)
        for part, kind, shift in (("middle", U2, 32), ("high", U1, 48)):
            h |= blobs(rows[part], kind).astype(np.uint64) << np.uint64(shift)
        h |= np.uint64(bucket >> (bits - LEAST_BITS) << SENT)
        once = np.zeros(len(classes), bool)
        once[first] = True
        keep = np.repeat(once, counts)
        h, own = h[keep], np.repeat(classes, counts)[keep]
        order = np.argsort(h, kind="stable")
        h, own = h[order], own[order]
        edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        times = np.diff(edge, append=len(h))
        times = np.repeat(times, times)
        h, own, times = h[times > 1], own[times > 1], np.minimum(times[times > 1], 65535).astype(U2)
        place = (own % np.uint64(groups)).astype(np.int64)
        order = np.lexsort((own, place))
        h, own, times, place = h[order], own[order], times[order], place[order]
        edges = np.flatnonzero(np.diff(place)) + 1
        out = []
        for lo, hi in zip([0, *edges], [*edges, len(h)], strict=True):
            if hi > lo:
                first = np.flatnonzero(np.concatenate([[True], own[lo + 1 : hi] != own[lo : hi - 1]]))
                out.append((int(place[lo]), own[lo:hi][first].tobytes(), b"", np.diff(first, append=hi - lo).astype(U4).tobytes(), h[lo:hi].tobytes(), times[lo:hi].tobytes()))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)], names=names)

    return packed.groupBy("bucket").applyInArrow(count, schema)


def views(column: pa.Array) -> Iterator[np.ndarray]:
    """The hashes in each row of a binary column, without copying them."""
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    edges = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].tolist()
    for a, b in zip(edges, edges[1:], strict=False):
        yield np.frombuffer(data, U8, (b - a) // 8, a)


def indexed_sets(shared: DataFrame, percent: int) -> DataFrame:
    """Every class with its number of shingles n; those that can have a link also with their shared shingles (hashes)
    and the ones that are indexed: prefix, at the positions from ``place`` on in the order rarest first."""
    schema = "class long, n long, place long, prefix array<long>, hashes binary"
    names = ["class", "n", "place", "prefix", "hashes"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]

    def index(rows: pa.Table) -> pa.Table:
        sized = rows.filter(pc.greater(pc.binary_length(rows["totals"]), 0))
        classes, first = np.unique(blobs(sized["classes"], U8), return_index=True)
        n = blobs(sized["totals"], U4).astype(np.int64)[first]
        rest = rows.filter(pc.equal(pc.binary_length(rows["totals"]), 0))
        own = np.repeat(blobs(rest["classes"], U8), blobs(rest["counts"], U4).astype(np.int64))
        h, times = blobs(rest["hashes"], U8), blobs(rest["frequency"], U2)
        order = np.lexsort((h, times, own))
        h, own = h[order], own[order]
        lo, hi = np.searchsorted(own, classes, "left"), np.searchsorted(own, classes, "right")
        alone = n - (hi - lo)
        wanted = n - (percent * n + 99) // 100 + 1 - alone
        out = []
        for c, size, a, z, u, p in zip(classes.view(np.int64).tolist(), n.tolist(), lo.tolist(), hi.tolist(), alone.tolist(), wanted.tolist(), strict=True):
            out.append((c, size, u, h[a : a + p].view(np.int64), np.sort(h[a:z]).tobytes()) if p > 0 and z > a else (c, size, u, None, None))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], names=names)

    return shared.groupBy("chunk").applyInArrow(index, schema)


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b), with their sizes n_a and n_b and the number of shingles that they share."""
    left = sets.select(F.col("class").alias("a"), F.col("n").alias("n_a"), F.col("hashes").alias("h_a"))
    right = sets.select(F.col("class").alias("b"), F.col("n").alias("n_b"), F.col("hashes").alias("h_b"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "h_a", "h_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            common = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(views(b.column("h_a")), views(b.column("h_b")), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(common, pa.int64())], names=["a", "b", "n_a", "n_b", "common"])

    return both.mapInArrow(run, "a long, b long, n_a long, n_b long, common long")


def needed(n_a: str, n_b: str, percent: int) -> F.Column:
    """The least overlap of two linked sets of these sizes."""
    return F.ceil(F.lit(percent) * (F.col(n_a) + F.col(n_b)) / F.lit(100 + percent))


def linked(percent: int) -> F.Column:
    return (100 + percent) * F.col("common") >= percent * (F.col("n_a") + F.col("n_b"))


def similar_classes(indexed: DataFrame, percent: int, rounds: int = ROUNDS) -> DataFrame:
    """Links (a, b) that connect all classes which links connect; not every link within a component is among them."""
    sets = indexed.filter("prefix IS NOT NULL").select("class", "n", "place", "hashes")
    lists = indexed.filter("prefix IS NOT NULL").select("class", "n", "place", F.posexplode("prefix").alias("i", "h")).select("h", "class", "n", (F.col("place") + F.col("i")).alias("place"), (F.col("place") / F.col("n")).alias("alone"))
    more = lists.groupBy("h").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1").select("h")
    lists = cut(lists.join(more, "h"))
    empty = lists.select(F.col("class").alias("a"), F.col("class").alias("b"), F.col("n").alias("n_a"), F.col("n").alias("n_b"), F.col("n").alias("common")).limit(0)
    tried = empty
    for k in range(rounds):
        # The likeliest relative has the fewest shingles to itself, as what others were made from has; later rounds try others.
        key = F.struct("alone", "class") if k < 2 else F.struct(F.xxhash64("class", F.lit(k)).cast("double").alias("alone"), "class")
        free = lists
        if k:
            free = lists.join(tried.filter(linked(percent)).select(F.col("a").alias("class")).distinct(), "class", "left_anti")
        centre = lists.groupBy("h").agg(F.min(key).alias("b"))
        likely = free.select("h", F.col("class").alias("a")).join(centre, "h").filter("a <> b.class").groupBy("a", "b").agg(F.count(F.lit(1)).alias("times"))
        best = F.struct(-F.col("b.alone"), "times", "b.class") if k == 0 else F.struct("times", -F.col("b.alone"), "b.class")
        pairs = likely.groupBy("a").agg(F.max_by("b.class", best).alias("b"))
        if k:
            pairs = pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti")
        tried = tried.union(cut(overlaps(pairs, sets)))
        release(indexed.sparkSession)
    near = tried.filter(linked(percent))
    links = near.select("a", "b")
    roots = connected_components(links)
    # A set's block: the set around which it lies, and how many shingles it has beyond that which are not its alone; sets
    # without a link are their own block.
    around = near.groupBy(F.col("a").alias("class")).agg(F.max_by(F.struct("b", "common"), F.struct("common", "b")).alias("best"))
    base = sets.select("class", "n", "place").join(around, "class", "left").join(roots.withColumnRenamed("node", "class"), "class", "left")
    base = cut(base.select("class", "n", F.coalesce("best.b", "class").alias("block"), F.coalesce(F.col("n") - F.col("place") - F.col("best.common"), F.lit(0)).alias("beyond"), F.coalesce("root", "class").alias("root")))
    blocks = lists.join(base.select("class", "block", "root"), "class").groupBy("h", "block", "root").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.col("n") - F.col("place")).alias("room"))
    mixed = blocks.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("h")
    blocks = cut(blocks.join(mixed, "h"))
    x, y = blocks.alias("x"), blocks.alias("y")
    fits = (F.col("x.h") == F.col("y.h")) & (F.col("x.root") < F.col("y.root"))
    fits &= (100 * F.col("x.most") >= percent * F.col("y.least")) & (100 * F.col("y.most") >= percent * F.col("x.least"))
    fits &= (100 + percent) * F.least("x.room", "y.room") >= percent * (F.col("x.least") + F.col("y.least"))
    centres = x.join(y, fits).select(F.least("x.block", "y.block").alias("a"), F.greatest("x.block", "y.block").alias("b")).distinct()
    between = cut(overlaps(centres, sets))
    release(indexed.sparkSession)
    links = links.union(between.filter(linked(percent)).select("a", "b"))
    # Blocks whose centres are not linked: a member shares with the other centre at most what the centres share and what it
    # has beyond its own; what can reach the threshold is compared.
    apart = between.filter(~linked(percent))
    ends = apart.select("a", "b", "common", F.col("n_b").alias("other_n")).union(apart.select(F.col("b").alias("a"), F.col("a").alias("b"), "common", F.col("n_a").alias("other_n")))
    m = base.select(F.col("class").alias("member"), "block", "n", "beyond").filter("member <> block")
    reaches = (100 + percent) * (F.col("common") + F.col("beyond")) >= percent * (F.col("n") + F.col("other_n"))
    toward = ends.join(m, (F.col("a") == F.col("block")) & reaches).select(F.col("member").alias("a"), "b")
    toward = cut(overlaps(toward, sets))
    met = toward.filter(linked(percent)).select("a", "b")
    links = links.union(met)
    # Of blocks still apart, pairs of members: they share at most what one shares with the other's centre, which is known
    # by now or too little, and what the other has beyond that centre.
    joined_now = met.join(m, F.col("a") == F.col("member")).select(F.least("block", "b").alias("a"), F.greatest("block", "b").alias("b")).distinct()
    far = m.groupBy("block").agg(F.max("beyond").alias("far"))
    apart = apart.join(joined_now, ["a", "b"], "left_anti").join(far.select(F.col("block").alias("a"), F.col("far").alias("far_a")), "a").join(far.select(F.col("block").alias("b"), F.col("far").alias("far_b")), "b")
    known = toward.select(F.col("a").alias("member"), F.col("b").alias("centre"), F.col("common").alias("exact"))
    sides = []
    for own, other in (("a", "b"), ("b", "a")):
        side = apart.select(F.col("a").alias("p"), F.col("b").alias("q"), F.col(own).alias("mine"), F.col(other).alias("centre"), "common", F.col(f"far_{other}").alias("far"))
        could = (100 + percent) * (F.col("common") + F.col("beyond") + F.col("far")) >= percent * (F.col("n") + F.ceil(percent * F.col("n") / 100))
        side = side.join(m, (F.col("mine") == F.col("block")) & could).join(known, ["member", "centre"], "left")
        sides.append(side.select("p", "q", F.col("member").alias(own), F.col("n").alias(f"n_{own}"), F.col("beyond").alias(f"beyond_{own}"), F.coalesce("exact", F.col("common") + F.col("beyond")).alias(f"most_{own}")))
    x, y = sides
    most = F.least(F.col("most_a") + F.col("beyond_b"), F.col("most_b") + F.col("beyond_a"))
    close = x.join(y, ["p", "q"]).filter(((100 + percent) * most >= percent * (F.col("n_a") + F.col("n_b"))) & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")))
    return links.union(overlaps(close.select("a", "b").distinct(), sets).filter(linked(percent)).select("a", "b"))


def ngram_components(df: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles, and component_id, the least doc_id that links reach.

    Two documents link if their sets of five-word shingles have a Jaccard similarity of percent / 100 or more. A text
    of fewer words is one shingle. Null, empty and blank texts have no shingles and no links: they are their own
    component. Repeated rows link with each other; rows with a null doc_id get the least doc_id of their component, null if
    there is none. Whole texts are read; an empty table gives an empty result; other columns are not read.
    """
    return keyed_components(df, doc_id, text, percent).drop("text_key")


def keyed_components(df: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The same, with the hash of each row's text, text_key."""
    members = cut(memberships(df, doc_id, text))
    words = members.agg(F.sum("words")).first()[0] or 0
    bits = max(3, math.ceil(math.log2(max(1, words) / GROUP)))
    ranges, groups = max(LEAST_BITS, bits), 1 << bits
    indexed = cut(indexed_sets(shared_shingles(packed_shingles(df, text, ranges, groups), ranges, groups), percent))
    release(df.sparkSession)
    links = cut(similar_classes(indexed, percent))
    release(df.sparkSession)
    roots = connected_components(links)
    # Components are settled among classes; documents meet them last. The classes of a large component, and the rows of a text
    # with very many copies, are split among tasks.
    worded = members.filter("class IS NOT NULL")
    named = worded.groupBy("class").agg(F.min("doc_id").alias("least"))
    classes = cut(indexed.select("class", "n").join(named, "class").join(roots.withColumnRenamed("node", "class"), "class", "left").select("class", "n", "least", F.coalesce("root", "class").alias("root")))
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    told = cut(join_split(*split_rows(classes, "root", ["class"]), "root", least).select("class", F.col("n").alias("n_shingles"), "component_id"))
    release(df.sparkSession)
    out = join_split(*split_rows(worded, "class", ["doc_id", "text_key"]), "class", told).select("doc_id", "n_shingles", "component_id", "text_key")
    return out.union(members.filter("class IS NULL").select("doc_id", F.lit(0).cast("bigint").alias("n_shingles"), F.col("doc_id").alias("component_id"), "text_key"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {WORDS} + 2), lambda i: array_to_string(w[i:i + {WORDS} - 1], ' ')) END) AS s FROM words),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= {PERCENT} * (p.n + q.n - c)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, m.component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) m USING (doc_id)
"""


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the document with the least doc_id; documents without a doc_id stay.

    A row is known by its doc_id and its text: of rows with one doc_id and unlike texts only those go that a lesser doc_id is
    linked with; repeated rows of the least doc_id all stay. Null, empty and blank texts are linked with nothing and stay.
    An empty table gives an empty result, and all columns, whatever their names, pass through.
    """
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    named = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()])
    found = keyed_components(named, own["doc_id"], own["text"])
    gone = found.filter("doc_id IS NOT NULL AND component_id <> doc_id").select(F.col("doc_id").alias("gone_id"), "text_key").distinct()
    named = named.withColumn("key", text_key(own["text"]))
    left = named.join(gone, (F.col(own["doc_id"]) == F.col("gone_id")) & (F.col("key") == F.col("text_key")), "left_anti")
    return left.select(*[F.col(n).alias(c) for c, n in own.items()])
