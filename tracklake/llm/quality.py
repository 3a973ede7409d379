"""Operator 5: quality rules by compression bands.

A whole document and each of its fixed chunks are compressed with zstandard. Natural prose of a given length
compresses to a narrow band of ratios; repetition falls below it, random text rises above it. The limits depend on
the length, since short pieces carry the coder's start-up cost.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklake.llm.common import WHITE, field, map_texts, mix, table

WINDOW = 8
CHUNK = 4096
LEVEL = 3
#: Production limits: (bytes, least ratio, greatest ratio); between two lengths they are interpolated over the
#: logarithm of the length. Set once from labelled prose, a little outside what good documents show.
BANDS = ((1, 0.60, 16.0), (16, 0.60, 1.9), (32, 0.60, 1.6), (64, 0.60, 1.25), (128, 0.58, 1.05), (256, 0.525, 0.98), (512, 0.50, 0.88), (724, 0.484, 0.83), (1024, 0.472, 0.78), (1448, 0.461, 0.74), (2048, 0.453, 0.70), (2896, 0.445, 0.67), (4096, 0.434, 0.64), (8192, 0.415, 0.62), (16384, 0.39, 0.60), (65536, 0.365, 0.60), (1 << 20, 0.33, 0.60))
#: The share of a document's judged chunk bytes that may lie outside the bands.
MOST_BAD = 0.25
FIELDS = [field(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [field("base_failed", T.BooleanType()), field("ratio", T.DoubleType()), field("bad_share", T.DoubleType()), field("kept", T.BooleanType())]


def repeated_words(docs: list[list[bytes]], window: int = WINDOW) -> list[int]:
    """For each document the words covered by a window that occurs in it more than once.

    Hashed windows of all documents are sorted together to find candidates; those are then compared as words.
    """
    sizes = np.array([len(w) for w in docs], dtype=np.int64)
    words = [x for w in docs for x in w]
    found = [0] * len(docs)
    if len(words) < window + 1:
        return found
    h = mix(np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64))
    n = len(words) - window + 1
    rolled = np.zeros(n, np.uint64)
    for j in range(window):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    doc = np.repeat(np.arange(len(docs)), sizes)
    inside = np.flatnonzero(doc[:n] == doc[window - 1 :])
    key = mix(rolled[inside] + mix(doc[inside].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    hit = np.zeros(len(order), bool)
    hit[1:] |= same
    hit[:-1] |= same
    at = np.sort(inside[order[hit]])
    starts = np.cumsum(sizes) - sizes
    for d in np.unique(doc[at]):
        own = at[doc[at] == d] if len(docs) < 3 else at[np.searchsorted(at, starts[d]) : np.searchsorted(at, starts[d] + sizes[d])]
        windows = [tuple(words[i : i + window]) for i in own.tolist()]
        times = Counter(windows)
        edge = np.zeros(sizes[d] + 1, np.int64)
        for i, w in zip((own - starts[d]).tolist(), windows, strict=True):
            if times[w] > 1:
                edge[i] += 1
                edge[i + window] -= 1
        found[d] = int((np.cumsum(edge)[: sizes[d]] > 0).sum())
    return found


def limits(size: np.ndarray, bands: tuple = BANDS) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest ratio allowed for pieces of these byte lengths."""
    x = np.log2(np.maximum(size, 1))
    at = np.log2([b[0] for b in bands])
    return np.interp(x, at, [b[1] for b in bands]), np.interp(x, at, [b[2] for b in bands])


def band_verdict(data: bytes, coder: zstandard.ZstdCompressor, bands: tuple = BANDS, chunk: int = CHUNK, most_bad: float = MOST_BAD) -> tuple[float | None, float, bool]:
    """Whole-document ratio, the share of chunk bytes outside the bands, and whether both are within limits."""
    if not data:
        return None, 0.0, False
    parts = [data[i : i + chunk] for i in range(0, len(data), chunk)]
    size = np.array([len(data), *map(len, parts)])
    whole = len(coder.compress(data)) if len(parts) > 1 or len(parts[0]) < len(data) else None
    packed = [len(coder.compress(p)) for p in parts]
    ratio = np.array([packed[0] if whole is None else whole, *packed]) / size
    least, most = limits(size, bands)
    out = (ratio < least) | (ratio > most)
    share = float((size[1:] * out[1:]).sum() / size[1:].sum())
    return float(ratio[0]), share, not out[0] and share <= most_bad


def judge(texts: list[bytes]) -> list[list]:
    coder = zstandard.ZstdCompressor(level=LEVEL)
    docs = [t.split() for t in texts]
    repeats = repeated_words(docs)
    rows = []
    for data, words, repeat in zip(texts, docs, repeats, strict=True):
        chars = len(data.decode("utf-8", "replace")) - (len(data) - len(data.translate(None, WHITE)))
        lines = Counter(x for x in data.split(b"\n") if x.strip(WHITE))
        failed = len(words) < 20 or 100 * repeat > 30 * len(words)
        ratio, share, good = band_verdict(data, coder)
        rows.append((len(words), chars, len(data) - len(data.translate(None, b"#*$%&|<>")), sum(lines.values()) - len(lines), repeat, failed, ratio, share, not failed and good))
    return [list(c) for c in zip(*rows, strict=True)]


def quality_rules(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Every row with its counts, compression ratio, share of bad chunks, and verdict ``kept``.

    A null or empty text has no words, so it fails the base and is not kept; its ratio is null. Equal texts get
    equal verdicts, repeated rows stay repeated, an empty table gives an empty result. Long texts are judged
    whole. Kept columns that bear a computed column's name give way to it; other columns pass through.
    """
    return map_texts(df, text, df.columns if keep is None else keep, FIELDS, judge)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep, with their own columns.

    Null, empty and blank texts have no words and go. Equal texts stay or go together, repeated rows stay repeated, an empty
    table gives an empty result; columns of any names pass through unchanged.
    """
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    named = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()])
    out = map_texts(named, own["text"], list(own.values()), [field("verdict", T.BooleanType())], lambda texts: [judge(texts)[-1]])
    return out.filter("verdict").select(*[F.col(n).alias(c) for c, n in own.items()])
