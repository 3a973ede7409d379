from __future__ import annotations

import hashlib
import random
import re

import pytest

from tracklake.llm import line_dedup


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def chunks(text):
    lines = (text or "").split("\n")
    long = [len(WORD.findall(x)) > line_dedup.PASSAGE_WORDS for x in lines]
    value = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    rolled = [v + line_dedup.WEIGHT * (value[i - 1] if i else 0) for i, v in enumerate(value)]
    out, own = [], []
    for i, line in enumerate(lines):
        own.append(line)
        near = [long[j] if 0 <= j < len(lines) else None for j in (i - 1, i + 1, i + 2)]
        least = near == [False] * 3 and rolled[i - 1] > rolled[i] <= rolled[i + 1]
        if i == len(lines) - 1 or long[i] or long[i + 1] or least:
            out.append(own)
            own = []
    return out


def counts(chunk):
    return any(chunk) and (len(chunk) > 1 or len(WORD.findall(chunk[0])) > line_dedup.PASSAGE_WORDS)


def brute(rows):
    first = {}
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        for k, c in enumerate(chunks(t)):
            if counts(c):
                first.setdefault(tuple(c), (d, k))
    out = []
    for d, t in rows:
        kept = [c for k, c in enumerate(chunks(t)) if tuple(c) not in first or first[tuple(c)] == (d, k)]
        left = [x for c in kept for x in c]
        out.append((d, "\n".join(left), len((t or "").split("\n")), len((t or "").split("\n")) - len(left)))
    return sorted(out, key=repr)


def test_matches_brute_force(spark):
    rng = random.Random(1)
    lines = ["", "a", "b c", "long line of words", "é", *[f"line {i}" for i in range(40)]]
    lines += ["word " * 50, "word " * 51, "passage " * 60, " ".join(map(str, range(80)))]
    passage = [f"shared {i}" for i in range(12)]
    rows = []
    for i in range(150):
        own = rng.choices(lines, k=rng.randint(1, 15))
        if rng.random() < 0.4:
            at = rng.randrange(len(own))
            own[at:at] = passage
        rows.append((i, "\n".join(own)))
    rows += [(300, "\n".join(["same"] * 40)), (301, "\n".join(["same"] * 40)), (302, "passage " * 60), (303, "one short line"), (304, "one short line")]
    rows += [(200, None), (201, ""), (202, "\n\n\n"), (3, rows[3][1]), (None, rows[5][1])]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id bigint, text string, n_lines int, gone string")
    out = line_dedup.remove_repeated_chunks(df)
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect()), key=repr) == brute(rows)
    assert {r.gone for r in out.collect()} == {"k"}
    assert line_dedup.remove_repeated_chunks(df.limit(0)).count() == 0


def test_cuts_resist_shifts(spark):
    passage = "\n".join(f"shared line {i}" for i in range(30))
    df = spark.createDataFrame([(1, passage), (2, "own start\n" + passage + "\nown end")], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in line_dedup.remove_repeated_chunks(df).collect()}
    assert rows[1].n_removed == 0 and rows[2].n_removed >= 15
    assert "own start" in rows[2].text and "own end" in rows[2].text


@pytest.mark.parametrize("columns", [["doc_id", "text", "n_chars"], ["text", "n_chars", "doc_id"]])
def test_stage_keeps_columns(spark, columns):
    df = spark.createDataFrame([(1, "a\nb", 3)], "doc_id bigint, text string, n_chars bigint").select(*columns)
    out = line_dedup.line_dedup_stage(spark, df, "")
    assert out.columns == columns and out.first().n_chars == len(out.first().text)


def test_no_python_on_the_executors(spark):
    df = spark.createDataFrame([(1, "a\nb")], "doc_id bigint, text string")
    assert "Arrow" not in line_dedup.remove_repeated_chunks(df)._jdf.queryExecution().executedPlan().toString()


def test_passages_of_one_line_go(spark):
    passage = " ".join(f"w{i}" for i in range(51))
    df = spark.createDataFrame([(1, f"a\n{passage}\nb"), (2, f"c\nd\n{passage}\ne\nf"), (3, passage[:-4] + "\nx")], "doc_id bigint, text string")
    rows = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.remove_repeated_chunks(df).collect()}
    assert rows[1][1] == 0 and rows[2] == ("c\nd\ne\nf", 1) and rows[3][1] == 0


def test_ids_of_other_types(spark):
    text = "a a\nb b\nc c\nd d"
    for kind, ids in (("string", ["k2", "k1", None]), ("double", [2.5, 1.5, None])):
        df = spark.createDataFrame([(i, text) for i in ids], f"doc_id {kind}, text string")
        rows = {r.doc_id: r.n_removed for r in line_dedup.remove_repeated_chunks(df).collect()}
        assert rows == {ids[0]: 4, ids[1]: 4, None: 0}


def stage(rows):
    """The stage by its plain words: what is left of each document, and no document of which 75 % of the words were repeats."""
    size = lambda t: len(WORD.findall(t or ""))
    was = {d: size(t) for d, t in rows}
    return [(d, t) for d, t, _, _ in brute(rows) if not was[d] or 100 * (was[d] - size(t)) < line_dedup.COPY_PERCENT * was[d]]


def test_stage_drops_copies(spark):
    rng = random.Random(4)
    prose = lambda n: "\n".join(" ".join(f"w{rng.randint(0, 9999)}" for _ in range(rng.randint(5, 70))) for _ in range(n))
    base = [prose(rng.randint(5, 20)) for _ in range(12)]
    rows = list(enumerate(base + [b.replace("w1", "x1", 2) for b in base] + base[:4] + [base[0] + "\n" + prose(20), base[5] + "\nend", "", None, "one line", "one line"]))
    df = spark.createDataFrame([(i, t, "u", len(t or "")) for i, t in rows], "doc_id bigint, text string, n_lines string, n_chars bigint")
    got = line_dedup.line_dedup_stage(spark, df, "")
    assert got.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in got.collect()) == sorted(stage(rows))
    kept = {d for d, _ in stage(rows)}
    assert set(range(12)) <= kept and not kept & {24, 25, 26, 27} and {28, 30, 31, 32, 33} <= kept
    assert all(r.n_chars == len(r.text) and r.n_lines == "u" for r in got.collect())
