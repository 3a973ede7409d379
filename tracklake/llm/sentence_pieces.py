"""Operator 1: SentencePiece encoding and decoding in batches.

Unigram encoding is a Viterbi search over all words of one length at once: at each end, the pieces that reach it are
looked up by their substrings' hashes, the best one so far is a vectorised maximum, and it is stored as a backpointer.

A model of kind BPE doesn't define its ids by the best path of its scores, which are merge ranks, but by merging the best
neighbours first. For those the same batches and lookups run the merges instead.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklake.llm.common import as_bytes, slices, table
from tracklake.llm.lattice import BPE, FEW, PLACES, SPACE, UNIGRAM, Batch, Pieces, by_length, pieces

#: Below the lowest score by so much lies a character that no piece covers.
UNKNOWN_PENALTY = 10.0
#: Merges within longer words are kept in a heap, word by word.
LONG_WORD = 256
#: Words that a worker remembers.
REMEMBERED = 500_000
WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def normalized(text: str, vocabulary: Pieces) -> str:
    return (SPACE if vocabulary.prefix and text else "") + text.replace(" ", SPACE)


def uncovered(batch: Batch, row: int, column: int) -> list[int]:
    """The ids of a character that is no piece: those of its bytes, or the unknown id."""
    v = batch.vocabulary
    if v.byte[0] < 0:
        return [v.unknown]
    return [int(v.byte[x]) for x in batch.utf8(column, np.array([row]))[0]]


#: A batch's outcome: the words' places, all their ids one after another, how many each has, and the scores.
Found = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def respelled(batch: Batch, rows: np.ndarray, starts: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and counts of words that are cut at ``starts``, sorted by row; what is no piece is spelled in bytes."""
    counts = np.bincount(rows, minlength=batch.n)
    bad = np.flatnonzero(found < 0)
    if not len(bad):
        return found, counts
    spelt = [uncovered(batch, r, c) for r, c in zip(rows[bad].tolist(), starts[bad].tolist(), strict=True)]
    times = np.ones(len(found), np.int64)
    times[bad] = [len(x) for x in spelt]
    out = np.repeat(found, times)
    out[np.repeat(found < 0, times)] = [i for x in spelt for i in x]
    counts = np.bincount(rows, weights=times, minlength=batch.n).astype(np.int64)
    return out, counts


def best_path(batch: Batch, row: int, lowest: float) -> tuple[np.ndarray, np.ndarray, float]:
    """The best path of one word: the starts of its pieces, the pieces, and its score."""
    best, back, piece = [0.0], [0], [-1]
    for lo in range(1, batch.length + 1, PLACES):
        starts, ends, found = batch.edges(row, lo, min(lo + PLACES, batch.length + 1), by_end=True)
        cost = np.where(found >= 0, batch.vocabulary.score[found], lowest).tolist()
        edges = np.searchsorted(ends, np.arange(lo, min(lo + PLACES, batch.length + 1) + 1)).tolist()
        starts, found = starts.tolist(), found.tolist()
        for a, z in zip(edges, edges[1:], strict=False):
            top = -np.inf
            for k in range(a, z):
                x = best[starts[k]] + cost[k]
                if x > top:
                    top, at = x, k
            best.append(top)
            back.append(starts[at])
            piece.append(found[at])
    chosen, at = [], batch.length
    while at:
        chosen.append((back[at], piece[at]))
        at = back[at]
    starts, found = (np.array(x, np.int64) for x in zip(*reversed(chosen), strict=True))
    return starts, found, best[-1]


def viterbi(words: list[str], vocabulary: Pieces) -> Iterator[Found]:
    """The best path of each word by the sum of its pieces' scores."""
    lowest = vocabulary.score[vocabulary.normal].min() - UNKNOWN_PENALTY
    for places, own in by_length(words):
        batch = Batch(own, vocabulary)
        if batch.n <= FEW:
            for row, place in enumerate(places):
                starts, found, score = best_path(batch, row, lowest)
                own_rows = np.full(len(starts), row)
                ids, _ = respelled(batch, own_rows, starts, found)
                yield np.array([place]), ids, np.array([len(ids)]), np.array([score])
            continue
        best = np.full((batch.length + 1, batch.n), -np.inf)
        best[0] = 0.0
        back = np.zeros((batch.length + 1, batch.n), np.int32)
        piece = np.full((batch.length + 1, batch.n), -1, np.int64)
        for end in range(1, batch.length + 1):
            for start, hit, found in batch.spans(end):
                if end - start == 1:  # the first to reach this end
                    best[end] = best[start] + lowest
                    best[end, hit] = best[start, hit] + vocabulary.score[found]
                    back[end] = start
                    piece[end, hit] = found
                    continue
                score = best[start, hit] + vocabulary.score[found]
                better = score > best[end, hit]
                hit = hit[better]
                best[end, hit] = score[better]
                back[end, hit] = start
                piece[end, hit] = found[better]
        rows, starts, chosen = [], [], []
        live, at = np.arange(batch.n), np.full(batch.n, batch.length)
        while len(live):
            chosen.append(piece[at, live])
            at = back[at, live]
            rows.append(live)
            starts.append(at)
            live, at = live[at > 0], at[at > 0]
        row, start, found = np.concatenate(rows), np.concatenate(starts), np.concatenate(chosen)
        order = np.lexsort((start, row))
        yield (places, *respelled(batch, row[order], start[order], found[order]), best[-1])


def merged_long(batch: Batch) -> np.ndarray:
    """Where one long word is cut after its merges, by a heap of neighbours."""
    n, gains = batch.length, batch.vocabulary.gains
    text = batch.codes[:, 0].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    end = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap = [(-gains[text[s : s + 2]], s, s + 2) for s in range(n - 1) if text[s : s + 2] in gains]
    heapq.heapify(heap)
    while heap:
        _, s, e = heapq.heappop(heap)
        if not alive[s] or end[s] >= n or end[end[s]] != e:
            continue
        alive[end[s]] = False
        end[s] = e
        if e < n:
            before[e] = s
        for x in (s, before[s]):
            if x >= 0 and end[x] < n:
                gain = gains.get(text[x : end[end[x]]])
                if gain is not None:
                    heapq.heappush(heap, (-gain, x, end[end[x]]))
    return np.flatnonzero(alive)


def merges(words: list[str], vocabulary: Pieces) -> Iterator[Found]:
    """The ids of each word by merging the best-scored neighbours first, of equals the leftmost."""
    for places, own in by_length(words):
        if len(own[0]) > LONG_WORD:
            for place, word in zip(places, own, strict=True):
                batch = Batch([word], vocabulary)
                starts = merged_long(batch)
                found = vocabulary.find(batch.key(0, starts, np.append(starts[1:], batch.length)))
                yield (np.array([place]), *respelled(batch, np.zeros(len(starts), np.int64), starts, found), np.zeros(1))
            continue
        batch = Batch(own, vocabulary)
        n, length = batch.n, batch.length
        # A symbol is known by its start; to each belong its end, the start before it, and the score of joining it with the next.
        end = np.tile(np.arange(1, length + 1), (n, 1))
        before = np.tile(np.arange(-1, length - 1), (n, 1))
        gain = np.full((n, length), -np.inf)
        alive = np.ones((n, length), bool)

        def join(rows: np.ndarray, start: np.ndarray) -> None:
            last = end[rows, start]
            ok = last < length
            gain[rows[~ok], start[~ok]] = -np.inf
            rows, start, last = rows[ok], start[ok], last[ok]
            found = vocabulary.find(batch.key(rows, start, end[rows, last]))
            gain[rows, start] = np.where(found >= 0, vocabulary.score[found], -np.inf)

        for s in range(length - 1):
            join(np.arange(n), np.full(n, s))
        live = np.arange(n)
        while len(live):
            at = gain[live].argmax(axis=1)
            open_ = gain[live, at] > -np.inf
            live, at = live[open_], at[open_]
            if not len(live):
                break
            other = end[live, at]
            last = end[live, other]
            alive[live, other] = False
            gain[live, other] = -np.inf
            end[live, at] = last
            inner = last < length
            before[live[inner], last[inner]] = at[inner]
            join(live, at)
            left = before[live, at]
            join(live[left >= 0], left[left >= 0])
        rows, starts = np.nonzero(alive)
        found = vocabulary.find(batch.key(rows, starts, end[rows, starts]))
        yield (places, *respelled(batch, rows, starts, found), np.zeros(n))


class Spellings:
    """The ids of words by one rule, one word after another in one array."""

    def __init__(self, vocabulary: Pieces, kind: int) -> None:
        if kind not in (UNIGRAM, BPE):
            raise ValueError(f"models of kind {kind} are not supported")
        self.vocabulary, self.search = vocabulary, viterbi if kind == UNIGRAM else merges
        self.flat, self.start, self.count, self.best = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def learn(self, new: list[str]) -> None:
        start, count, best = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64), np.zeros(len(new))
        parts, at = [self.flat], len(self.flat)
        for places, ids, counts, scores in self.search(new, self.vocabulary):
            count[places], best[places] = counts, scores
            start[places] = at + np.cumsum(counts) - counts
            parts.append(ids.astype(np.int32))
            at += len(ids)
        self.flat = np.concatenate(parts)
        self.start, self.count, self.best = np.concatenate([self.start, start]), np.concatenate([self.count, count]), np.concatenate([self.best, best])

    def of(self, words: np.ndarray, edges: np.ndarray) -> tuple[list[np.ndarray], list[float]]:
        """The ids and scores of texts whose words, by their numbers, lie between the edges."""
        count = self.count[words]
        ends = np.cumsum(count)
        ids = self.flat[np.repeat(self.start[words] - ends + count, count) + np.arange(count.sum())]
        ends = np.concatenate([[0], ends])
        return np.split(ids, ends[edges[1:-1]]), [float(self.best[words[a:z]].sum()) for a, z in zip(edges, edges[1:], strict=False)]


class Encoder:
    """Ids of texts by one or more rules; the ids of words that came before are remembered."""

    def __init__(self, vocabulary: Pieces, *kinds: int) -> None:
        self.vocabulary, self.kinds = vocabulary, kinds or (vocabulary.kind,)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.spellings = [Spellings(self.vocabulary, k) for k in self.kinds]

    def words(self, text: str) -> list[str]:
        whole = normalized(text, self.vocabulary)
        return WORD.findall(whole) if self.vocabulary.splits else [whole] * bool(whole)

    def encode(self, texts: list[str]) -> list[tuple[list[np.ndarray], list[float]]]:
        """For each rule: the ids of each text and, for the best path, its score."""
        if not texts:
            return [([], []) for _ in self.kinds]
        docs = [self.words(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.forget()
        words = [w for d in docs for w in d]
        new = list({w for w in words if w not in self.known})
        if new:
            for s in self.spellings:
                s.learn(new)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        edges = np.cumsum([0, *map(len, docs)])
        return [s.of(at, edges) for s in self.spellings]


def decode(ids: np.ndarray | list[int], vocabulary: Pieces) -> str:
    """The text of the ids: pieces and bytes joined, the space put before the text taken off."""
    data = b"".join(map(vocabulary.bytes_of.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))
    text = data.decode("utf-8", "replace")
    return text[1:] if vocabulary.prefix and text.startswith(" ") else text


def encode_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, kind: int | None = None) -> DataFrame:
    """Per row: doc_id, ids (array<int>) and, of the unigram search, score.

    ``kind`` is the model's own unless given: UNIGRAM for the best path of the scores, BPE for merges. A null text counts
    as empty, which has no ids. Equal texts have equal ids, repeated rows stay, an empty table gives an empty result;
    other columns are not read.
    """
    where = path or public_tokenizers.path("piece_bpe_32k.model")
    source = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("body"))
    schema = T.StructType([source.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(pieces(where), *([] if kind is None else [kind]))
        for whole in batches:
            for b in slices(whole, "body"):
                ((ids, scores),) = coder.encode([t.decode("utf-8", "replace") for t in as_bytes(b, "body")])
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(scores, pa.float64())], names=schema.names)

    return source.mapInArrow(run, schema)


def decode_documents(df: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """The rows with column text in place of their ids; null ids count as none, which are the empty text."""
    where = path or public_tokenizers.path("piece_bpe_32k.model")
    names = [c for c in df.columns if c not in (ids, "text")]
    source = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(names)], F.col(f"`{ids}`").alias("ids"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(where)
        for b in batches:
            texts = [decode(x or [], vocabulary) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], names=schema.names)

    return source.mapInArrow(run, schema).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)], "text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids by the model's own rule and by the best path of its scores, and what both decode to."""
    where = public_tokenizers.path("piece_bpe_32k.model")
    source = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("body"))
    made = "n_ids long, ids_crc32 long, n_path long, path_crc32 long, path_score double, text_crc32 long, decoded_crc32 long, path_decoded_crc32 long"
    schema = T.StructType([source.schema["doc_id"], *T.StructType.fromDDL(made).fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(where)
        coder = Encoder(vocabulary, vocabulary.kind, UNIGRAM)
        crc = lambda x: zlib.crc32(x.astype("<u4").tobytes())
        for whole in batches:
            for b in slices(whole, "body"):
                data = as_bytes(b, "body")
                texts = [t.decode("utf-8", "replace") for t in data]
                (ids, _), (best, scores) = coder.encode(texts)
                back = [[zlib.crc32(decode(x, vocabulary).encode()) for x in made] for made in (ids, best)]
                columns = [[len(x) for x in ids], [crc(x) for x in ids], [len(x) for x in best], [crc(x) for x in best], scores, [zlib.crc32(t) for t in data], *back]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.float64() if n == "path_score" else pa.int64()) for c, n in zip(columns, names[1:], strict=True))], names=names)

    return source.mapInArrow(run, schema)
