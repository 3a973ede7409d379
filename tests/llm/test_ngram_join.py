from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from tracklake.llm import components, ngram_join
from tracklake.llm.common import Tokens
from tracklake.llm.ngram_join import near_duplicates_stage, ngram_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            o = len(a & sets[j])
            if a and sets[j] and 100 * o >= 75 * (len(a) + len(sets[j]) - o):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min(x for x in (least.get(r), d) if x is not None) if d is not None or r in least else None
    return sorted(((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def corpus(seed, originals=6, copies=25, edits=(0, 9), length=(3, 90)):
    """Originals, edited copies at all distances around the threshold, shared passages, and unrelated texts."""
    rng = random.Random(seed)
    new = lambda n: [f"w{rng.randint(0, 5000)}" for _ in range(n)]
    passage = new(30)
    out = []
    for _ in range(originals):
        base = new(rng.randint(*length))
        if rng.random() < 0.5:
            base += passage
        out.append(base)
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randint(*edits)):
                k = rng.randrange(len(own))
                own[k : k + rng.randint(0, 2)] = new(rng.randint(0, 2))
                own = own or ["w"]
            out.append(own)
    out += [new(rng.randint(1, 60)) for _ in range(20)]
    rng.shuffle(out)
    return [(i * 3 + 1, rng.choice([" ", "\n", "\t "]).join(w if rng.random() < 0.9 else w.upper() for w in x)) for i, x in enumerate(out)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(spark, seed):
    rows = corpus(seed)
    got = ngram_components(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_group_of_copies_that_meet_only_at_their_original(spark):
    rows = corpus(7, originals=1, copies=150, edits=(2, 4), length=(100, 100))
    got = ngram_components(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_odd_rows_and_stage(spark):
    text = "one two three four five six seven"
    rows = [(5, text), (3, text.upper()), (5, text), (9, None), (8, ""), (7, " \n"), (2, "a b"), (1, "A  b"), (4, "a b"), (6, "x")]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id bigint, text string, n bigint, class string")
    assert sorted(map(tuple, ngram_components(df).collect()), key=repr) == brute(rows)
    kept = near_duplicates_stage(spark, df, "")
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 6, 7, 8, 9]
    assert ngram_components(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, text), (None, text), (4, text), (None, "q")], "doc_id bigint, text string")
    assert sorted(map(tuple, ngram_components(nulls).collect()), key=repr) == sorted([(None, 3, 4), (None, 3, 4), (4, 3, 4), (None, 1, None)], key=repr)


@pytest.mark.parametrize("bits", [8, 11, 17])
def test_whole_hashes_come_back(spark, bits):
    texts = [" ".join(f"w{random.Random(i // 2).randint(0, 10**6) + j}" for j in range(40)) for i in range(12)] + ["one two", "one two three"]
    df = spark.createDataFrame([(i, t + (" end" if i % 2 else "")) for i, t in enumerate(texts)], "doc_id bigint, text string")
    found = ngram_join.shared_shingles(ngram_join.packed_shingles(df, "text", bits, 4), bits, 4).collect()
    got = {(int(c), int(h)) for r in found if not r.totals for c, h in zip(np.repeat(np.frombuffer(r.classes, "<u8"), np.frombuffer(r.counts, "<u4")), np.frombuffer(r.hashes, "<u8"), strict=True)}
    tokens = Tokens([(t + (" end" if i % 2 else "")).encode() for i, t in enumerate(texts)])
    h, at = ngram_join.shingle_sets(tokens, np.arange(len(texts)))
    keys = tokens.sequence_keys().view(np.uint64)
    times = Counter(h.tolist())
    want = {(int(keys[d]), x) for x, d in zip(h.tolist(), at.tolist(), strict=True) if times[x] > 1}
    assert got == want and len(want) > 100
    sizes = {int(c): int(n) for r in found if r.totals for c, n in zip(np.frombuffer(r.classes, "<u8"), np.frombuffer(r.totals, "<u4"), strict=True)}
    assert sizes == {int(k): int((at == d).sum()) for d, k in enumerate(keys)}


def test_stage_knows_rows_by_their_text(spark):
    text, other = "a b c d e f g h i j k l", "quite other words than those that stand there now"
    rows = [(1, text, 1), (2, text, 2), (2, other, 3), (None, text, 4), (3, None, 5), (4, "", 6), (1, text, 7), (5, text + " m", 8)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, text_key int")
    got = ngram_join.near_duplicates_stage(spark, df, "")
    assert got.columns == df.columns
    assert sorted(r.text_key for r in got.collect()) == [1, 3, 4, 5, 6, 7]


def test_components_of_stars_chains_and_rings(spark, monkeypatch):
    """A hub with more links than one part takes, a chain, a ring, and repeated, null and self links, against union and find."""
    monkeypatch.setattr(components, "PARTS", 8)
    links = [(500, 1000 + i) for i in range(60)] + [(i, i + 1) for i in range(2000, 2040)] + [(3000 + i, 3000 + (i + 1) % 7) for i in range(7)]
    links += [(1003, 2003), (500, 1000), (7, 7), (None, 4), (4, None)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    found = components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.root for r in found} == {x: find(x) for x in root} and len(found) == len(root)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).isEmpty()


def union_find(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        lo, hi = sorted((find(a), find(b)))
        root[hi] = lo
    return {x: find(x) for x in root}


def test_components_of_a_chain_take_few_checkpoints(spark, monkeypatch):
    """A chain whose least node lies far from where it is joined, among stars: tasks contract it, so one round settles it."""
    order = list(range(300))
    random.Random(5).shuffle(order)
    links = list(zip(order, order[1:], strict=False)) + [(5000, 6000 + i) for i in range(400)] + [(order[150], 5000)]
    cuts = []
    whole = components.cut
    monkeypatch.setattr(components, "cut", lambda df: cuts.append(1) or whole(df))
    found = components.connected_components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()
    assert {r.node: r.root for r in found} == union_find(links) and len(found) == 701
    assert len(cuts) <= 4


def test_components_that_many_tasks_contract(spark, monkeypatch):
    """No task sees all links of a component, nor holds a whole forest: the rounds do the rest."""
    monkeypatch.setattr(components, "LINKS", 20)
    monkeypatch.setattr(components, "PARTS", 8)
    rng = random.Random(6)
    links = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(90)] + [(1000, 1001 + i) for i in range(150)] + [(-7, 1100), (2000, 2001)]
    links = [(a, b) for a, b in links if a != b]
    found = components.connected_components(spark.createDataFrame(links, "a long, b long").repartition(3)).collect()
    assert {r.node: r.root for r in found} == union_find(links) and len(found) == len(union_find(links))
