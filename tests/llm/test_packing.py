from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tracklake.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("seed", range(40))
def test_plan_places_all_without_overlap(seed):
    rng = random.Random(seed)
    cap = rng.choice([16, 64, 1024])
    counts = {rng.randint(1, cap): rng.randint(1, rng.choice([1, 5, 1000])) for _ in range(rng.randint(0, 60))}
    moves, bins = packing.packing_plan(counts, cap)
    used, placed = defaultdict(list), defaultdict(int)
    for size, rank, n, each, first, offset in moves:
        assert rank == placed[size]
        placed[size] += n
        for k in range(n):
            used[first + k // each].append((offset + k % each * size, size))
    assert placed == counts and set(used) == set(range(bins))
    for own in used.values():
        at = 0
        for offset, size in sorted(own):
            assert offset == at
            at += size
        assert at <= cap
        assert sum(3 * s > cap for _, s in own) <= 2
    # The longer half can't be packed closer than one to a bin, and nothing beats the total.
    assert bins >= max(-(-sum(s * n for s, n in counts.items()) // cap), sum(n for s, n in counts.items() if 2 * s > cap))


def test_ids_are_the_tokenizer_s():
    whole = Tokenizer.from_file(PATH)
    texts = ["", " ", "Hello  world\n\n", "naïve é ß 日本", "a<|endoftext|>b", "x" * 3000, "1234 's 're\t\t", "​﻿"]
    assert [packing.tokenizer(PATH).encode(t) for t in texts] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_documents(spark):
    long = "the cat sat " * 900
    rows = [(1, "hello"), (2, None), (3, ""), (4, long), (1, "hello"), (None, "x y z")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id bigint, text string, length int")
    got = packing.pack_documents(df).collect()
    whole = Tokenizer.from_file(PATH)
    ids = [*whole.encode(long, add_special_tokens=False).ids, 2]
    own = sorted((r for r in got if r.doc_id == 4), key=lambda r: r.piece)
    assert [x for r in own for x in r.ids] == ids
    assert [r.length for r in own] == [len(ids) % 1024] + [1024] * (len(ids) // 1024)
    assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1].tolist()]
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    assert [r.ids for r in got if r.doc_id in (2, 3)] == [[2], [2]] and sum(r.doc_id == 1 for r in got) == 2
    used = defaultdict(list)
    for r in got:
        used[r.sequence_id].append((r.offset, r.length))
    for own in used.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 1024
    assert packing.pack_documents(df.limit(0)).count() == 0


def fewest(sizes, capacity):
    """The least number of bins, by trying every place for every item."""
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for room in set(bins):
            if room >= sizes[i]:
                rest = list(bins)
                rest.remove(room)
                place(i + 1, [*rest, room - sizes[i]])
        place(i + 1, [*bins, capacity - sizes[i]])

    place(0, [])
    return best


def test_plan_against_the_optimum():
    rng = random.Random(17)
    equal = 0
    for _ in range(400):
        cap = rng.choice([10, 16, 30])
        sizes = sorted((rng.randint(1, cap) for _ in range(rng.randint(1, 9))), reverse=True)
        bins = packing.packing_plan(Counter(sizes), cap)[1]
        least = fewest(sizes, cap)
        assert least <= bins <= 11 * least / 9 + 1
        equal += bins == least
    assert equal >= 380


def test_full_pieces_and_parts(spark, monkeypatch):
    rng = random.Random(18)
    rows = [(i, rng.choice([16, 16, 16, 1, 1, 1, 1, rng.randint(1, 15)]), "x") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, length bigint, rank_ string").repartition(7)
    monkeypatch.setattr(packing, "PART_ROWS", 100)
    got = packing.pack_pieces(df, ["doc_id"], 16).collect()
    assert sorted((r.doc_id, r.length) for r in got) == [r[:2] for r in rows]
    used = defaultdict(list)
    for r in got:
        used[r.sequence_id].append((r.offset, r.length))
    for own in used.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 16
    assert len(used) <= -(-sum(r[1] for r in rows) // 16) + 2


def test_ids_of_many_parts_grow_with_the_rows(spark, monkeypatch):
    df = spark.range(1000).selectExpr("id AS doc_id", "cast(3 AS bigint) AS length")
    monkeypatch.setattr(packing, "PART_ROWS", 50)
    parts = set()
    real = np.zeros

    def seen(shape, *args):
        if isinstance(shape, tuple) and shape[0] == 17:
            parts.add(shape[1])
        return real(shape, *args)

    monkeypatch.setattr(packing.np, "zeros", seen)
    packing.pack_pieces(df, ["doc_id"], 16)
    packing.pack_pieces(df.limit(120), ["doc_id"], 16)
    assert parts == {20, 3}
