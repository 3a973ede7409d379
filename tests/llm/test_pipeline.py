"""The stages, one after another, against plain versions of each on a small corpus."""

from __future__ import annotations

import random

import corpus_pipeline
import numpy as np
import test_line_dedup
import test_ngram_join
from tracklake.llm import packing, quality, secrets


def plain_grammars(texts):
    """The automata and the model of ordinary text as the texts tell them, gathered without Spark."""
    values = {v for t in texts for v in secrets.labelled_values(t)}
    follows = np.zeros((secrets.SYMBOLS, secrets.SYMBOLS))
    for t in texts:
        spans = [(s, e) for s, _, e, _ in secrets.base_spans(t)]
        for part, sign in [(t, 1), *((t[s:e], -1) for s, e in spans)]:
            code = [0, *(1 + secrets.ALPHABET.index(c) if c in secrets.ALPHABET else 0 for c in part), 0]
            for a, b in zip(code, code[1:], strict=False):
                follows[a, b] += sign
    follows[0, 0] = 0  # between tokens
    return secrets.Grammars([secrets.Automaton(sorted(v for k, v in values if k == kind)) for kind in range(3) if any(k == kind for k, _ in values)], secrets.Ordinary(follows))


def test_run(spark, tmp_path):
    rng = random.Random(2)
    parts = "th er ing on re and es st en at ed nd ti ha ou ea nt or ly wh an in he sh ble".split()
    prose = lambda n: "\n".join(" ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(rng.randint(6, 14))) for _ in range(n))
    base = [prose(rng.randint(4, 12)) for _ in range(15)]
    texts = base + [b + " extra" for b in base[:5]] + base[:3] + ["the same words " * 60, "", None, base[4] + '\ntoken = "04dbebab91ab85687d33eeaaf9ac699e1188f962"']
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = [(i, t) for i, t in rows if quality.judge([(t or "").encode()])[-1][0]]
    assert 0 < len(kept) < len(rows)
    deduped = test_line_dedup.stage(kept)
    assert not {20, 21, 22} & {i for i, _ in deduped}  # exact copies of several lines end as one document
    component = {d: c for d, _, c in test_ngram_join.brute(deduped)}
    left = [(i, t) for i, t in deduped if component[i] == i]
    grammars = plain_grammars([t for _, t in left])
    clean = [(i, secrets.redact(t, secrets.all_spans(t, grammars)[1])) for i, t in left]
    coder = packing.tokenizer(packing.public_tokenizers.path("byte_bpe_50k.json"))
    want = {(i, k, hi - lo) for i, t in clean for e in [packing.piece_edges(len(coder.encode(t)) + 1, 1024)] for k, (lo, hi) in enumerate(zip(e, e[1:], strict=False))}
    assert {(r.doc_id, r.piece, r.length) for r in got} == want
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "secret scans", "best-fit packing"]


def test_run_with_automata(spark, tmp_path):
    rng = random.Random(3)
    parts = "th er ing on re and es st en at ed nd ti ha ou ea nt or ly wh an in he sh ble".split()
    prose = lambda n: " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n))
    key = lambda n: "0d" + "".join(rng.choices("0123456789abcdef", k=n - 2))
    texts = [f"{prose(60)} token = {key(40)}" for _ in range(30)] + [f"{prose(60)} AUTH={key(20)}" for _ in range(3)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.length for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    kept = [(i, t) for i, t in enumerate(texts) if quality.judge([t.encode()])[-1][0]]
    assert len([i for i, _ in kept if i < len(texts) - 3]) >= 20 and {i for i, _ in kept} >= set(range(len(texts) - 3, len(texts)))
    grammars = plain_grammars([t for _, t in kept])
    coder = packing.tokenizer(packing.public_tokenizers.path("byte_bpe_50k.json"))
    clean = {i: secrets.redact(t, secrets.all_spans(t, grammars)[1]) for i, t in kept}
    assert all(clean[i].endswith("AUTH=[secret]") for i in range(len(texts) - 3, len(texts)))
    assert got == {i: len(coder.encode(t)) + 1 for i, t in clean.items()}
