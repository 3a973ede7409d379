from __future__ import annotations

import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tracklake.llm import lm_score
from tracklake.llm.common import Tokens, word_hashes
from tracklake.llm.lattice import SPACE, pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary():
    return pieces(PATH)


def segmentations(word, known):
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        if word[:k] in known or k == 1:
            for rest in segmentations(word[k:], known):
                yield [word[:k], *rest]


def brute(word, v, weights):
    """Adds up every way to cut the word, and how often each piece is in them."""
    known = {v.text[i]: i for i in v.normal}
    ids = lambda p: [known[p]] if p in known else [int(v.byte[b]) for b in p.encode()]
    total, counts = 0.0, Counter()
    for cut in segmentations(word, known):
        own = [i for p in cut for i in ids(p)]
        share = math.exp(sum(weights[i] for i in own))
        total += share
        for i in own:
            counts[i] += share
    return math.log(total), {i: c / total for i, c in counts.items()}


def test_forward_and_expected_counts_match_brute_force(vocabulary):
    weights = lm_score.first_weights(vocabulary).piece
    words = ["the", "thering", "ß", "あa", "x", "aaaa", "the."]
    times = np.array([3.0, 1.0, 2.0, 1.0, 1.0, 5.0, 0.5])
    got = lm_score.word_log_probabilities(words, vocabulary, weights)
    counts = np.zeros(vocabulary.size)
    for w, n, g in zip(words, times, got, strict=True):
        score, expected = brute(SPACE + w, vocabulary, weights)
        assert g == pytest.approx(score)
        for i, c in expected.items():
            counts[i] += c * n
    assert np.allclose(lm_score.expected_counts(words, times, vocabulary, weights), counts)


def test_weights_are_a_distribution_and_fitting_helps(vocabulary):
    rng = random.Random(1)
    words = ["".join(rng.choices(["th", "er", "ing", "on", "re"], k=3)) for _ in range(300)]
    times = np.ones(len(words))
    w = lm_score.first_weights(vocabulary)
    last = -math.inf
    for _ in range(4):
        assert np.exp(w.piece).sum() + math.exp(w.end) == pytest.approx(1.0)
        now = lm_score.word_log_probabilities(words, vocabulary, w.piece).sum() + 10 * w.end
        assert now > last
        last = now
        w = lm_score.refitted(vocabulary, lm_score.expected_counts(words, times, vocabulary, w.piece), 10)


def test_tokens_are_the_words():
    texts = ["One two\tTHREE\n", "", " \x0b", "é É x", "one", "z" * 3_000_000 + " two"]
    data = [t.encode() for t in texts]
    tokens = Tokens(data)
    words = [t.lower().split() for t in data]
    assert tokens.counts.tolist() == [len(w) for w in words]
    flat = [w for d in words for w in d]
    assert tokens.words(np.arange(len(flat))) == flat
    assert tokens.hashes.tolist() == word_hashes(flat).tolist()
    assert len(set(tokens.hashes.tolist())) == len(set(flat))
    keys = Tokens([b"a b", b"b a", b"A\nb", b"a", b"a b a"]).classes()
    assert keys[0] == keys[2] and len(set(keys)) == 4


def test_scores(spark):
    rng = random.Random(5)
    rows = [(i, " ".join("".join(rng.choices(["th", "er", "ing", "on", "re", "and"], k=rng.randint(1, 3))) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    rows += [(100, None), (101, ""), (3, "The END"), (None, "the end the"), (103, "zqézq unseenword")]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id bigint, text string, n_tokens int, class string")
    got = lm_score.score_documents(df.repartition(3))
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    trained = [(t or "").lower().split() for i, t in rows if not held(i)]
    counts = Counter(w for t in trained for w in t)
    n, v = sum(counts.values()) + len(trained), len(counts) + 1
    want = []
    for i, t in rows:
        own = (t or "").lower().split()
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own) + math.log10((len(trained) + 1) / (n + v + 1))
        want.append((i, held(i), len(own) + 1, sum(counts[w] > 0 for w in own) + 1, n, round(base, 6)))
    rows_got = got.collect()
    assert sorted(((*r[:5], round(r.base_score, 6)) for r in rows_got), key=repr) == sorted(want, key=repr)
    ends = {r.score for r in rows_got if r.n_tokens == 1}
    assert len(ends) == 1 and all(r.score < 0 for r in rows_got)
    by = {r.doc_id: r for r in rows_got}
    assert by[103].score / by[103].n_tokens < by[0].score / by[0].n_tokens
    assert lm_score.score_documents(df.limit(0)).count() == 0


def test_one_word_equals_the_batch(vocabulary, monkeypatch):
    rng = random.Random(8)
    words = ["".join(rng.choices(["th", "er", "ing", "ß", "q", "あ", "0"], k=rng.randint(1, 60))) for _ in range(200)] + ["a", "aa" * 500]
    times = np.array([rng.random() for _ in words])
    weights = lm_score.first_weights(vocabulary).piece
    monkeypatch.setattr(lm_score, "FEW", 10**9)
    monkeypatch.setattr(lm_score, "PLACES", 37)
    one = lm_score.word_log_probabilities(words, vocabulary, weights), lm_score.expected_counts(words, times, vocabulary, weights)
    monkeypatch.setattr(lm_score, "FEW", 0)
    many = lm_score.word_log_probabilities(words, vocabulary, weights), lm_score.expected_counts(words, times, vocabulary, weights)
    assert np.allclose(one[0], many[0]) and np.allclose(one[1], many[1])


def test_a_very_long_word_takes_seconds(vocabulary):
    rng = random.Random(9)
    word = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789+/", k=300_000))
    weights = lm_score.first_weights(vocabulary).piece
    began = time.perf_counter()
    assert lm_score.word_log_probabilities([word], vocabulary, weights)[0] < -300_000
    assert lm_score.expected_counts([word], np.ones(1), vocabulary, weights).sum() > 100_000
    assert time.perf_counter() - began < 20


def test_scores_through_hash_ranges_and_parts(spark, vocabulary, monkeypatch):
    rng = random.Random(6)
    pool = ["".join(rng.choices(["th", "er", "ing", "on", "re", "and"], k=rng.randint(1, 4))) for _ in range(300)]
    rows = [(i, "every " + " ".join(rng.choices(pool, k=rng.randint(0, 30))) + (" every" if i % 3 else "")) for i in range(80)]
    rows += [(90, rows[4][1]), (91, None), (92, "x" * 3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    by_common = {r.doc_id: r for r in lm_score.score_documents(df, rounds=1).collect()}
    monkeypatch.setattr(lm_score, "GROUP", 25)  # 83 documents have one word, so its occurrences are parted
    for common in (2, 40):
        monkeypatch.setattr(lm_score, "COMMON", common)
        got = {r.doc_id: r for r in lm_score.score_documents(df, rounds=1).collect()}
        assert got.keys() == by_common.keys()
        for i, r in got.items():
            assert r[:5] == by_common[i][:5] and r[5:] == pytest.approx(by_common[i][5:])
    # Whole texts by brute force, the fitted weights taken from the module's own fit.
    words = lm_score.word_counts(df.select("text", lm_score.held_out(F.col("doc_id")).alias("held_out")))
    ends = words.filter("length(word) = 0").first().times
    weights = lm_score.fit(words.filter("length(word) > 0"), ends, PATH, 1)
    for i, text in rows[:3]:
        want = sum(brute(SPACE + w, vocabulary, weights.piece)[0] for w in text.lower().split() if len(w) < 14) + weights.end
        want += sum(lm_score.word_log_probabilities([w], vocabulary, weights.piece)[0] for w in text.lower().split() if len(w) >= 14)
        assert by_common[i].score == pytest.approx(want / math.log(10))


def test_words_of_one_hash_are_an_error():
    with pytest.raises(ValueError, match="one hash"):
        lm_score.Known.of(np.array([5, 5], np.uint64), np.ones(2), np.zeros(2), 10.0)
