from __future__ import annotations

import math
import random
import re
from collections import Counter

import zstandard

from tracklake.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text)
    win = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if win[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(words) < 20 or 100 * len(covered) > 30 * len(words)


def texts():
    rng = random.Random(1)
    some = ["a", "bé", "c#", " ", "d|e", "\x1c", "ß"]
    out = ["", "\n\n", "one", "   x", "a b c d e f g h\n" * 3]
    for n in (5, 30, 200):
        for _ in range(10):
            out.append("".join(rng.choice(some) + rng.choice(" \n\t\x0b  ") for _ in range(n)))
    return out


def test_counts_match_brute_force():
    got = list(zip(*quality.judge([t.encode() for t in texts()]), strict=True))
    assert [g[:6] for g in got] == [brute(t) for t in texts()]
    assert list(zip(*quality.judge([texts()[-1].encode()]), strict=True))[0] == got[-1]


def prose(n, seed):
    rng = random.Random(seed)
    parts = "th er ing on re and es st en at ed nd ti ha ou ea nt or ly wh an in he sh ble".split()
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n))


def test_bands_tell_prose_from_junk():
    coder = zstandard.ZstdCompressor(level=quality.LEVEL)
    rng = random.Random(2)
    for n in (30, 100, 300, 3000):
        assert quality.band_verdict(prose(n, n).encode(), coder)[2]
        assert not quality.band_verdict(("the same words " * n).encode(), coder)[2]
    assert not quality.band_verdict("".join(chr(rng.randint(33, 126)) for _ in range(5000)).encode(), coder)[2]
    half = prose(800, 4) + " ab cd" * 3000
    assert not quality.band_verdict(half.encode(), coder)[2]


def test_table_and_stage(spark):
    good = prose(100, 9)
    rows = [(1, good), (2, None), (3, ""), (1, good), (None, good), (4, "x y z " * 100)]
    df = spark.createDataFrame([(*r, "en", 5) for r in rows], "doc_id bigint, text string, kept string, n_words int")
    got = quality.quality_rules(df).collect()
    assert Counter((r.doc_id, r.kept) for r in got) == Counter([(1, True), (1, True), (None, True), (2, False), (3, False), (4, False)])
    kept = quality.quality_stage(spark, df, "")
    assert kept.columns == df.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 1]
    assert quality.quality_rules(df.limit(0)).count() == 0


def plain_verdict(data):
    """The band rule by plain arithmetic: ratios of the whole and of each chunk, the last one too, against interpolated limits."""
    def limit(n, column):
        for (a, *low), (b, *high) in zip(quality.BANDS, quality.BANDS[1:], strict=False):
            if a <= n <= b:
                share = math.log(n / a) / math.log(b / a)
                return low[column] + share * (high[column] - low[column])
        return quality.BANDS[-1][column + 1]

    def out(part):
        ratio = len(zstandard.compress(part, quality.LEVEL)) / len(part)
        return not limit(len(part), 0) <= ratio <= limit(len(part), 1)

    if not data:
        return False
    parts = [data[i : i + quality.CHUNK] for i in range(0, len(data), quality.CHUNK)]
    return not out(data) and sum(len(p) for p in parts if out(p)) <= quality.MOST_BAD * len(data)


def test_verdict_matches_brute_force():
    rng = random.Random(6)
    coder = zstandard.ZstdCompressor(level=quality.LEVEL)
    kinds = [lambda n: prose(n, rng.random()), lambda n: "same words " * n, lambda n: "".join(chr(rng.randint(33, 126)) for _ in range(n * 5)), lambda n: f"é{n} " * n]
    verdicts = Counter()
    for _ in range(400):
        text = " ".join(rng.choice(kinds[:1] * 4 + kinds)(rng.choice([1, 3, 20, 150, 800])) for _ in range(rng.randint(0, 3))).encode()
        got = quality.band_verdict(text, coder)[2]
        assert got == plain_verdict(text), (len(text), text[:100])
        verdicts[got] += 1
    assert min(verdicts.values()) > 40


def test_the_last_chunk_counts():
    coder = zstandard.ZstdCompressor(level=quality.LEVEL)
    head = prose(2000, 5).encode()[: quality.CHUNK]
    assert quality.band_verdict(head + b"x" * 500, coder)[1] > 0.1
