"""Operator 8: language-model scoring by the likelihood of all segmentations into subwords.

The pieces of an existing vocabulary weigh every way to cut a word; a log-space forward recursion over the lattice of
pieces adds them all up, so a text's score is its marginal probability, not that of one best cut. The vocabulary's own
scores start the weights; expectation and maximisation over the training documents' words fit them to the corpus.

Words are counted and scored once each, not once per occurrence. The most frequent words, a fixed number of them, are
known to every task, so their occurrences are added up where they are read. The others meet their scores by hash range and,
as one of them can still be in very many texts, by part of the texts too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklake.llm.common import Fresh, Tokens, as_bytes, cut, field, map_texts, mix, slices, table, word_hashes
from tracklake.llm.lattice import FEW, PLACES, SPACE, Batch, Pieces, by_length, pieces

#: Rounds of expectation and maximisation.
ROUNDS = 4
#: What each piece counts beyond its occurrences, so that none is impossible.
SMOOTHING = 0.02
#: Words that go through the lattice together, about: the more, the more of one length.
TOGETHER = 100_000
#: Words, repeated ones too, that a mapper counts before it sends them.
COUNTED = 1_500_000
#: Words that every task knows: the most frequent ones, as 24 bytes each.
COMMON = 1 << 16
#: Occurrences of other words that one group of the reducers meets, about.
GROUP = 2_000_000
#: Occurrences of other words that a mapper gathers before it sends them.
BUFFER = 500_000
U8, F8 = np.dtype("<u8"), np.dtype("<f8")
U4, I8 = np.dtype("<u4"), np.dtype("<i8")


@dataclass
class Weights:
    """Natural log probabilities of the pieces, and of the end of a text."""

    piece: np.ndarray
    end: float


def first_weights(v: Pieces) -> Weights:
    """From the vocabulary's scores: a piece of rank r, which is what they tell, has a share of 1 / (r + 2)."""
    share = 1.0 / (2.0 + np.abs(v.score))
    usable = v.is_normal.copy()
    usable[v.byte[v.byte >= 0]] = True
    share[v.byte[v.byte >= 0]] = 1.0 / (2.0 + v.size)
    share = np.where(usable, share, 0.0)
    with np.errstate(divide="ignore"):
        return Weights(np.log(share / share.sum() * 0.9), math.log(0.1))


def refitted(v: Pieces, counts: np.ndarray, ends: float) -> Weights:
    usable = v.is_normal.copy()
    usable[v.byte[v.byte >= 0]] = True
    counts = np.where(usable, counts + SMOOTHING, 0.0)
    total = counts.sum() + ends + SMOOTHING
    with np.errstate(divide="ignore"):
        return Weights(np.log(counts / total), math.log((ends + SMOOTHING) / total))


def spelling(batch: Batch, column: int, rows: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
    """For characters that are no piece: which of the distinct ones each is, and the ids that spell those."""
    return spelling_of(batch.codes[column, rows], batch.vocabulary)


def spelling_of(codes: np.ndarray, v: Pieces) -> tuple[np.ndarray, list[list[int]]]:
    distinct, which = np.unique(codes, return_inverse=True)
    return which, [[int(v.byte[x]) for x in chr(int(c)).encode("utf-8", "surrogatepass")] if v.byte[0] >= 0 else [v.unknown] for c in distinct]


def forward(batch: Batch, weights: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Log probability of each prefix of each word, all its segmentations added; ``keep`` gathers the lattice's edges."""
    alpha = np.full((batch.length + 1, batch.n), -np.inf)
    alpha[0] = 0.0
    for end in range(1, batch.length + 1):
        for start, hit, found in batch.spans(end):
            if len(hit):
                alpha[end, hit] = np.logaddexp(alpha[end, hit], alpha[start, hit] + weights[found])
                if keep is not None:
                    keep.append((start, end, hit, found, None))
            if end - start == 1 and len(hit) < batch.n:
                missed = np.ones(batch.n, bool)
                missed[hit] = False
                rest = np.flatnonzero(missed)
                which, ids = spelling(batch, start, rest)
                cost = np.array([weights[x].sum() for x in ids])[which]
                alpha[end, rest] = np.logaddexp(alpha[end, rest], alpha[start, rest] + cost)
                if keep is not None:
                    keep.append((start, end, rest, which, ids))
    return alpha


def added(values: list[float]) -> float:
    """The logarithm of the sum of what has these logarithms."""
    top = max(values)
    return top if len(values) == 1 or top == -math.inf else top + math.log(sum(math.exp(v - top) for v in values))


def costs_of(batch: Batch, row: int, starts: np.ndarray, found: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The log weights of a word's edges; one without a piece is spelled."""
    cost = weights[found]
    bad = np.flatnonzero(found < 0)
    if len(bad):
        which, ids = spelt_at(batch, row, starts[bad])
        cost[bad] = np.array([weights[x].sum() for x in ids])[which]
    return cost


def spelt_at(batch: Batch, row: int, places: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
    return spelling_of(batch.codes[places, row], batch.vocabulary)


def forward_one(batch: Batch, row: int, weights: np.ndarray) -> list[float]:
    """Log probability of each prefix of one word, all its segmentations added."""
    alpha = [0.0]
    for lo in range(1, batch.length + 1, PLACES):
        hi = min(lo + PLACES, batch.length + 1)
        starts, ends, found = batch.edges(row, lo, hi, by_end=True)
        cost = costs_of(batch, row, starts, found, weights).tolist()
        edges, starts = np.searchsorted(ends, np.arange(lo, hi + 1)).tolist(), starts.tolist()
        for a, z in zip(edges, edges[1:], strict=False):
            alpha.append(added([alpha[starts[k]] + cost[k] for k in range(a, z)]))
    return alpha


def expected_one(batch: Batch, row: int, weights: np.ndarray, times: float, counts: np.ndarray) -> None:
    """Adds to ``counts`` how often each piece is expected in so many occurrences of one word."""
    alpha = np.array(forward_one(batch, row, weights))
    beta = [-math.inf] * batch.length + [0.0]
    for lo in reversed(range(0, batch.length, PLACES)):
        hi = min(lo + PLACES, batch.length)
        starts, ends, found = batch.edges(row, lo, hi, by_end=False)
        cost = costs_of(batch, row, starts, found, weights)
        own, edges, to = cost.tolist(), np.searchsorted(starts, np.arange(lo, hi + 1)).tolist(), ends.tolist()
        for s in range(hi - 1, lo - 1, -1):
            if edges[s - lo] < edges[s - lo + 1]:
                beta[s] = added([beta[to[k]] + own[k] for k in range(edges[s - lo], edges[s - lo + 1])])
        ahead = np.array(beta[lo : min(hi + batch.vocabulary.longest, batch.length) + 1])
        with np.errstate(under="ignore"):
            share = np.exp(alpha[starts] + cost + ahead[ends - lo] - alpha[-1]) * times
        plain = found >= 0
        np.add.at(counts, found[plain], share[plain])
        if not plain.all():
            which, ids = spelt_at(batch, row, starts[~plain])
            for total, spelt in zip(np.bincount(which, weights=share[~plain], minlength=len(ids)), ids, strict=True):
                np.add.at(counts, spelt, total)


def word_log_probabilities(words: list[str], v: Pieces, weights: np.ndarray) -> np.ndarray:
    """Marginal natural log probability of each word, with the space before it."""
    out = np.zeros(len(words))
    for places, own in by_length([SPACE + w for w in words]):
        batch = Batch(own, v)
        out[places] = [forward_one(batch, row, weights)[-1] for row in range(batch.n)] if batch.n <= FEW else forward(batch, weights)[-1]
    return out


def expected_counts(words: list[str], times: np.ndarray, v: Pieces, weights: np.ndarray) -> np.ndarray:
    """How often each piece is expected in the words' segmentations."""
    counts = np.zeros(v.size)
    for places, own in by_length([SPACE + w for w in words]):
        batch = Batch(own, v)
        if batch.n <= FEW:
            for row, place in enumerate(places):
                expected_one(batch, row, weights, times[place], counts)
            continue
        edges: list = []
        alpha = forward(batch, weights, edges)
        beta = np.full((batch.length + 1, batch.n), -np.inf)
        beta[-1] = 0.0
        share = times[places]
        for start, end, rows, found, ids in reversed(edges):
            cost = weights[found] if ids is None else np.array([weights[x].sum() for x in ids])[found]
            ahead = beta[end, rows] + cost
            # Edges come back by falling end, so what leaves ``end`` is complete.
            beta[start, rows] = np.logaddexp(beta[start, rows], ahead)
            with np.errstate(under="ignore"):
                expected = np.exp(alpha[start, rows] + ahead - alpha[-1, rows]) * share[rows]
            if ids is None:
                counts += np.bincount(found, weights=expected, minlength=v.size)
            else:
                for total, spelt in zip(np.bincount(found, weights=expected, minlength=len(ids)), ids, strict=True):
                    np.add.at(counts, spelt, total)
    return counts


def held_out(doc_id: Column, modulus: int = 7, remainder: int = 2) -> Column:
    """Whether a document is kept out of training; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def word_counts(df: DataFrame) -> DataFrame:
    """(word, times in training, seen in all) for every word of all documents, and the empty word for their ends; ``df`` has text and held_out."""
    source = df.select(F.col("text").cast("string").alias("body"), F.col("held_out"))

    def counted(parts: list[tuple[Tokens, np.ndarray]], ends: list[int]) -> pa.RecordBatch:
        h = np.concatenate([t.hashes for t, _ in parts])
        distinct, first, which = np.unique(h, return_index=True, return_inverse=True)
        times = np.bincount(which, weights=np.concatenate([w for _, w in parts]), minlength=len(distinct))
        seen = np.bincount(which, minlength=len(distinct))
        words: list[bytes] = []
        order = np.sort(first)
        lo = 0
        for t, _ in parts:
            words += t.words(order[(order >= lo) & (order < lo + len(t.hashes))] - lo)
            lo += len(t.hashes)
        columns = [(x[which[order]].astype(np.int64).tolist(), e) for x, e in zip((times, seen), ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([*words, b""], pa.binary()), *(pa.array([*x, e], pa.int64()) for x, e in columns)], names=["word", "times", "seen"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n, ends = [], 0, [0, 0]
        for whole in batches:
            for b in slices(whole, "body"):
                tokens = Tokens(as_bytes(b, "body"))
                trains = 1.0 - np.array(b.column("held_out").to_pylist(), float)
                parts.append((tokens, np.repeat(trains, tokens.counts)))
                n += len(tokens.hashes)
                ends = [ends[0] + int(trains.sum()), ends[1] + len(trains)]
                if n > COUNTED:
                    yield counted(parts, ends)
                    parts, n, ends = [], 0, [0, 0]
        if parts:
            yield counted(parts, ends)

    return source.mapInArrow(run, "word binary, times long, seen long").groupBy("word").agg(F.sum("times").alias("times"), F.sum("seen").alias("seen"))


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= TOGETHER:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def fit(words: DataFrame, ends: int, path: str, rounds: int = ROUNDS) -> Weights:
    """The pieces' weights after so many rounds over the training words; the driver gets one number a piece."""
    v = pieces(path)
    weights = first_weights(v)
    for _ in range(rounds):
        now = weights.piece

        def run(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            own = pieces(path)
            total = np.zeros(own.size)
            for b in gathered(batches):
                total += expected_counts([w.decode("utf-8", "replace") for w in b.column("word").to_pylist()], b.column("times").to_numpy().astype(float), own, now)
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["piece", "expected"])

        counts = np.zeros(v.size)
        for r in words.filter("times > 0").mapInArrow(run, "piece int, expected double").groupBy("piece").agg(F.sum("expected")).collect():
            counts[r[0]] = r[1]
        weights = refitted(v, counts, ends)
    return weights


def scored_words(words: DataFrame, path: str, weights: np.ndarray) -> DataFrame:
    """The words by hash: times in training, seen in all, natural log probability."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = pieces(path)
        for b in gathered(batches):
            own = b.column("word").to_pylist()
            logs = word_log_probabilities([w.decode("utf-8", "replace") for w in own], v, weights)
            yield pa.RecordBatch.from_arrays([pa.array(word_hashes(own).view(np.int64)), *(b.column(c).combine_chunks() for c in ("times", "seen")), pa.array(logs)], names=["hash", "times", "seen", "log"])

    return words.mapInArrow(run, "hash long, times long, seen long, log double")


@dataclass
class Known:
    """Words by ascending hash, with what they add to a text's sums: whether in training, log10 by counts, log10 by the lattice."""

    hashes: np.ndarray
    adds: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray, times: np.ndarray, logs: np.ndarray, denominator: float) -> Known:
        order = np.argsort(hashes)
        hashes = hashes[order]
        if (hashes[1:] == hashes[:-1]).any():
            raise ValueError("two words have one hash")
        times = times[order].astype(float)
        return cls(hashes, np.array([times > 0, np.log10((times + 1.0) / denominator), logs[order] / math.log(10)], float))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where these hashes are, and which of them are here."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return at, self.hashes[at] == hashes


def sums(values: np.ndarray, owner: np.ndarray, n: int) -> list[np.ndarray]:
    return [np.bincount(owner, weights=v, minlength=n) for v in values]


def memberships(docs: DataFrame, common: Known) -> DataFrame:
    """Every document's class of equal word sequences, number of words, and the sums over its common words."""

    def label(texts: list[bytes]) -> list:
        tokens = Tokens(texts)
        at, here = common.find(tokens.hashes)
        return [tokens.classes(), tokens.counts, *sums(common.adds[:, at[here]] if here.any() else np.zeros((3, 0)), tokens.documents()[here], len(texts))]

    fields = [field("class", T.LongType()), field("words", T.LongType()), *(field(n, T.DoubleType()) for n in ("known0", "base0", "score0"))]
    return map_texts(docs, "text", ["doc_id", "held_out"], fields, label)


PACKED = "cell long, classes binary, counts binary, hashes binary, times binary, logs binary"
NAMES = [c.split()[0] for c in PACKED.split(", ")]
KINDS = [pa.int64(), *[pa.binary()] * 5]


def packed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, KINDS, strict=True)], names=NAMES)


def runs(keys: np.ndarray) -> list[tuple[int, int]]:
    edges = (np.flatnonzero(np.diff(keys)) + 1).tolist()
    return [(lo, hi) for lo, hi in zip([0, *edges], [*edges, len(keys)], strict=True) if hi > lo]


def packed_words(scored: DataFrame, most: int, common: Known, bits: int, salts: int) -> DataFrame:
    """The other words by cell: hash range and part of the texts, to each of which all words of the range go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column("hash").to_numpy().view(np.uint64)
            rest = np.flatnonzero(~common.find(h)[1])
            rest = rest[np.argsort(h[rest], kind="stable")]
            h, times, logs = h[rest], b.column("times").to_numpy()[rest], b.column("log").to_numpy()[rest]
            ranges = (h >> np.uint64(64 - bits)).astype(np.int64)
            yield packed([(int(ranges[lo]) * salts + s, b"", b"", h[lo:hi].tobytes(), times[lo:hi].astype(U8).tobytes(), logs[lo:hi].tobytes()) for lo, hi in runs(ranges) for s in range(salts)])

    return scored.filter(F.col("seen") <= most).mapInArrow(run, PACKED)


def packed_documents(df: DataFrame, common: Known, bits: int, salts: int) -> DataFrame:
    """The other words of each class by cell: classes, words of each, hashes."""
    source = df.select(F.col("text").cast("string").alias("body"))

    def pack(keys: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
        salt = (mix(keys.view(np.uint64)) % np.uint64(salts)).astype(np.int64)
        cell = (h >> np.uint64(64 - bits)).astype(np.int64) * salts + salt
        order = np.lexsort((keys, cell))
        keys, h, cell = keys[order], h[order], cell[order]
        rows = []
        for lo, hi in runs(cell):
            first = np.flatnonzero(np.concatenate([[True], keys[lo + 1 : hi] != keys[lo : hi - 1]]))
            rows.append((int(cell[lo]), keys[lo:hi][first].tobytes(), np.diff(first, append=hi - lo).astype(U4).tobytes(), h[lo:hi].tobytes(), b"", b""))
        return packed(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh = Fresh()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for whole in batches:
            for b in slices(whole, "body"):
                tokens = Tokens(as_bytes(b, "body"))
                new = np.zeros(len(tokens.counts), bool)
                new[fresh(tokens)] = True
                owner = tokens.documents()
                rest = np.flatnonzero(new[owner])
                rest = rest[~common.find(tokens.hashes[rest])[1]]
                held.append((tokens.sequence_keys()[owner[rest]], tokens.hashes[rest]))
                n += len(rest)
                if n >= BUFFER:
                    yield pack(*map(np.concatenate, zip(*held, strict=True)))
                    held, n = [], 0
        if n:
            yield pack(*map(np.concatenate, zip(*held, strict=True)))

    return source.mapInArrow(run, PACKED)


def class_scores(both: DataFrame, denominator: float) -> DataFrame:
    """(class, known, base, score): sums over the other words of each class; logs of base 10."""

    def join(rows: pa.Table) -> pa.Table:
        blobs = lambda column, kind: np.frombuffer(b"".join(column.to_pylist()), kind)
        isword = pc.equal(pc.binary_length(rows["classes"]), 0)
        words, docs = rows.filter(isword), rows.filter(pc.invert(isword))
        known = Known.of(*(blobs(words[c], k) for c, k in (("hashes", U8), ("times", U8), ("logs", F8))), denominator)
        out = []
        for classes, counts, hashes in zip(*(docs[c].to_pylist() for c in ("classes", "counts", "hashes")), strict=True):
            own, at = np.frombuffer(classes, I8), np.frombuffer(counts, U4)
            place, here = known.find(np.frombuffer(hashes, U8))
            if not here.all():
                raise ValueError("a word of a document was not counted")
            out.append((own, *sums(known.adds[:, place], np.repeat(np.arange(len(own)), at), len(own))))
        whole = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, I8), *[np.zeros(0)] * 3]
        _, first = np.unique(whole[0], return_index=True)
        return pa.table([pa.array(x[first]) for x in whole], names=["class", "known", "base", "score"])

    return both.groupBy("cell").applyInArrow(join, "class long, known double, base double, score double").groupBy("class").agg(*[F.sum(c).alias(c) for c in ("known", "base", "score")])


def score_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", held: Column | None = None, path: str | None = None, rounds: int = ROUNDS) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability).

    The model learns from the rows that are not held out (by default by the checksum of doc_id). Tokens are the words, A-Z in
    lower case, and one end. A null text counts as empty: its only token is the end. Equal texts have equal scores,
    repeated rows count as often in training, an empty table gives an empty result; other columns are not read.
    """
    where = path or public_tokenizers.path("piece_bpe_32k.model")
    out = held if held is not None else held_out(F.col(f"`{doc_id}`"))
    docs = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), out.alias("held_out"))
    words = cut(word_counts(docs))
    tokens, distinct = words.agg(F.sum("times"), F.count_if(F.col("times") > 0)).first()
    tokens = tokens or 0
    ends = words.filter(F.length("word") == 0).select("times").first()
    ends = ends[0] if ends else 0
    words = words.filter(F.length("word") > 0)
    denominator = float(tokens + distinct + 1)
    weights = fit(words, ends, where, rounds)
    scored = cut(scored_words(words, where, weights.piece))
    top = scored.orderBy(F.desc("seen"), "hash").limit(COMMON).toArrow()
    common = Known.of(top["hash"].to_numpy().view(np.uint64), top["times"].to_numpy(), top["log"].to_numpy(), denominator)
    members = memberships(docs, common)
    if top.num_rows < COMMON:
        sums_of = members.select("*", *[F.lit(0.0).alias(c) for c in ("known", "base", "score")])
    else:
        most = top["seen"][-1].as_py()  # no other word occurs more often
        rest = scored.agg(F.sum("seen")).first()[0] - pc.sum(top["seen"]).as_py()
        salts = max(1, -(-most // GROUP))
        bits = max(3, math.ceil(math.log2(max(1, rest) / GROUP / salts)))
        both = packed_words(scored, most, common, bits, salts).union(packed_documents(docs, common, bits, salts))
        sums_of = members.join(cut(class_scores(both, denominator)), "class", "left")  # written, so that the rows of a text with very many copies can be split in the join
    both_sums = lambda c: F.col(f"{c}0") + F.coalesce(c, F.lit(0.0))
    return sums_of.select(
        "doc_id",
        "held_out",
        (F.col("words") + 1).alias("n_tokens"),
        (both_sums("known") + F.lit(int(ends > 0))).cast("bigint").alias("n_known"),
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        (both_sums("base") + F.lit(math.log10((ends + 1) / denominator))).alias("base_score"),
        (both_sums("score") + F.lit(weights.end / math.log(10))).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
