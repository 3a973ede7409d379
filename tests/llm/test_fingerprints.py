from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tracklake.llm import fingerprints as fp


def shingles(text):
    words = (text or "").split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def likeness(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 400)}" for _ in range(50)]
    out = []
    for i in range(60):
        own = base[: rng.randint(0, 50)] + [f"v{rng.randint(0, 99)}" for _ in range(rng.randint(0, 30))]
        out.append((i * 7 % 61, " ".join(own)))
    return [*out, (100, ""), (101, None), (102, "é one")]


def test_small_sets_are_exact(spark, texts, tmp_path):
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in fp.query(spark, str(tmp_path)).collect()}
    order = sorted(texts, key=lambda r: -r[0])
    assert len(got) == len(texts)
    for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        t, n = t or "", n or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].near_edited == pytest.approx(likeness(shingles(t), shingles(edited)))
        union = shingles(t) | shingles(edited)
        if shingles(edited):
            assert got[i].edited_in_text == pytest.approx(len(shingles(t) & shingles(edited)) / len(shingles(edited)) if union else 1.0)
        assert got[i].n_shingles == len(shingles(t))
        assert got[i].near_next == pytest.approx(likeness(shingles(t), shingles(n)))
    assert got[100].fingerprint == got[101].fingerprint == ""


@pytest.mark.parametrize("rows", [2, 5, 17])
def test_next_row_over_many_ranges(spark, monkeypatch, rows):
    monkeypatch.setattr(fp, "RANGE_ROWS", rows)
    data = [(i * 5, f"t{i}") for i in range(40)] + [(None, "n")]
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    got = {r.text: r.next_text for r in fp.with_next(df, "doc_id", "text", ["text"]).collect()}
    order = [t for _, t in sorted(data[:-1], key=lambda r: -r[0])] + ["n"]
    assert got == dict(zip(order, order[1:] + order[:1], strict=True))
    assert fp.with_next(df.limit(0), "doc_id", "text", ["text"]).count() == 0
    assert [r.next_text for r in fp.with_next(df.limit(1), "doc_id", "text", ["text"]).collect()] == ["t0"]


def test_estimates_and_merging(spark):
    words = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    df = fp.fingerprints(spark.createDataFrame([(1, words(0, 3000), "x"), (2, words(1000, 4000), "x")], "doc_id bigint, text string, sketch string"))
    a, b = df.filter("doc_id = 1"), df.filter("doc_id = 2").select(F.col("sketch").alias("other"))
    r = a.crossJoin(b).select(fp.resemblance("sketch", "other"), fp.containment("sketch", "other"), fp.distinct_shingles("sketch")).first()
    assert r[0] == pytest.approx(0.5, abs=0.15) and r[1] == pytest.approx(2 / 3, abs=0.2) and r[2] == pytest.approx(2996, rel=0.3)
    merged = fp.merge_sketches(df.withColumn("g", F.lit(1)), ["g"]).first().sketch
    parts = df.select("sketch").collect()
    assert merged == sorted({h for p in parts for h in p.sketch})[: fp.K]


def test_no_python_on_the_executors(spark):
    df = spark.createDataFrame([(1, "a b c d e f")], "doc_id bigint, text string")
    plan = fp.with_next(fp.fingerprints(df), "doc_id", "text", ["text", "sketch"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan and "InArrow" not in plan


@pytest.mark.parametrize(("rows", "first"), [(2, 4), (1, 8), (3, 2)])
def test_next_row_over_ranges_in_ranges(spark, monkeypatch, rows, first):
    monkeypatch.setattr(fp, "RANGE_ROWS", rows)
    monkeypatch.setattr(fp, "FIRST", first)
    data = [(i * i % 997 * (-1 if i % 5 == 0 else 1), f"t{i}") for i in range(1, 45)] + [(None, "n")]
    df = spark.createDataFrame(data, "doc_id bigint, text string").repartition(3)
    ranges = fp.with_ranges(df.withColumn("order_", F.coalesce("doc_id", F.lit(-(2**63)))), "order_")
    told = {r.text: r.range_ for r in ranges.collect()}
    by_key = sorted(data, key=lambda r: (r[0] is not None, r[0]))
    assert [told[t] for _, t in by_key] == sorted(told.values()) and len(set(told.values())) > first
    got = {r.text: r.next_text for r in fp.with_next(df, "doc_id", "text", ["text"]).collect()}
    order = [t for _, t in sorted(data[:-1], key=lambda r: (-r[0], r[1]))] + ["n"]
    assert got == dict(zip(order, order[1:] + order[:1], strict=True))


def test_ids_that_are_no_integers_are_refused(spark):
    with pytest.raises(TypeError, match="integer"):
        fp.with_next(spark.createDataFrame([("a", "t")], "doc_id string, text string"), "doc_id", "text", ["text"])
