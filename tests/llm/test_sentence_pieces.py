from __future__ import annotations

import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tracklake.llm import sentence_pieces as sp
from tracklake.llm.lattice import BPE, SPACE, UNIGRAM, pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "   a", "a  ", "▁x", "日本語テキスト", "\U0001f600 hi", "a\tb\nc", "x" * 600 + " y" + "ab" * 300, " Hello    world\n\nfoo\tbar あ", "<s> </s> <unk>", "\x00", "е́", "the the the"]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces(PATH)


def sample(n, seed=3):
    rng = random.Random(seed)
    parts = ["th", "er", "ing", "tion", "the", "é", "ß", "12", ".", ",", "a", "qu", "ñ", "X"]
    return [" ".join("".join(rng.choices(parts, k=rng.randint(1, 6))) for _ in range(rng.randint(1, 40))) for _ in range(n)]


def test_ids_are_sentencepiece_s(vocabulary):
    texts = ODD + sample(300)
    ((ids, _),) = sp.Encoder(vocabulary).encode(texts)
    assert [x.tolist() for x in ids] == sentencepiece.SentencePieceProcessor(model_file=PATH).encode(texts)


def best_path(word, v):
    """Brute force: the best sum of scores over every cut."""
    lowest = v.score[v.normal].min() - sp.UNKNOWN_PENALTY
    known = {v.text[i]: v.score[i] for i in v.normal}
    best = [0.0]
    for end in range(1, len(word) + 1):
        best.append(max(best[s] + known.get(word[s:end], lowest if end - s == 1 else float("-inf")) for s in range(end)))
    return best[-1]


def test_viterbi_is_the_best_path(vocabulary):
    words = [SPACE + w for t in sample(20, 5) for w in t.split()] + ["あ\n", SPACE * 3, "é"]
    for places, ids, counts, best in sp.viterbi(words, vocabulary):
        at = 0
        for place, n, score in zip(places, counts, best, strict=True):
            own = ids[at : at + n].tolist()
            at += n
            assert score == pytest.approx(best_path(words[place], vocabulary))
            assert b"".join(vocabulary.bytes_of[i] for i in own).decode() == words[place].replace(SPACE, " ")


def test_both_rules_decode_to_the_text(vocabulary):
    texts = [t for t in ODD if SPACE not in t] + sample(50, 7)
    for ids, _ in sp.Encoder(vocabulary, BPE, UNIGRAM).encode(texts):
        assert [sp.decode(x, vocabulary) for x in ids] == texts


def test_table(spark):
    rows = [(1, "the thing"), (2, None), (3, ""), (1, "the thing"), (None, "a")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id bigint, text string, ids string, score string")
    out = sp.encode_documents(df)
    assert out.columns == ["doc_id", "ids", "score"] and out.count() == 5
    back = sp.decode_documents(out).orderBy("doc_id").collect()
    assert [(r.doc_id, r.text) for r in back] == [(None, "a"), (1, "the thing"), (1, "the thing"), (2, ""), (3, "")]
    assert sp.encode_documents(df.limit(0)).count() == 0


def test_very_long_words(spark):
    rng = random.Random(12)
    v = pieces(PATH)
    word = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789+/ß", k=200_000))
    began = time.perf_counter()
    for kind in (sp.UNIGRAM, sp.BPE):
        ((ids, _),) = sp.Encoder(v, kind).encode([word])
        assert sp.decode(ids[0], v) == word
    assert time.perf_counter() - began < 20
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    short = word[:5000]
    assert sp.Encoder(v).encode([short])[0][0][0].tolist() == model.encode(short)


def test_one_word_equals_the_batch(monkeypatch):
    rng = random.Random(13)
    v = pieces(PATH)
    words = [SPACE + "".join(rng.choices(["th", "er", "ing", "ß", "q", "0"], k=rng.randint(1, 40))) for _ in range(300)]
    ids = []
    for few in (0, 10**9):
        monkeypatch.setattr(sp, "FEW", few)
        found = {}
        for places, flat, counts, scores in sp.viterbi(words, v):
            for place, own, score in zip(places, np.split(flat, np.cumsum(counts)[:-1]), scores, strict=True):
                found[int(place)] = (own.tolist(), round(float(score), 6))
        ids.append(found)
    assert ids[0] == ids[1]


def test_query_columns(spark, tmp_path):
    texts = ["", None, "Hello  world", "naïve é ß 日本", "x" * 700, "the cat sat " * 30, "tab\tand\nline"]
    rows = [(f"d{i}", t) for i, t in enumerate(texts)] + [(None, "again"), ("d2", "Hello  world")]
    spark.createDataFrame(rows, "doc_id string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in sp.query(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts) + 1
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    for key, t in rows:
        ids = model.encode(t or "")
        r = got[key]
        assert (r.n_ids, r.ids_crc32) == (len(ids), crc(ids))
        assert r.text_crc32 == r.decoded_crc32 == r.path_decoded_crc32 == zlib.crc32((t or "").encode())
