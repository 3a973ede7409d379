from __future__ import annotations

from collections import Counter, defaultdict

import pytest

from tracklake.llm import sharding


def simulate(counts, nodes, room):
    """Brute force: row by row, the own arcs' rows first, then the rest clockwise, step by step."""
    room, where, over = list(room), defaultdict(Counter), []
    for arc, (_, s) in enumerate(nodes):
        for _ in range(counts.get(arc, 0)):
            if room[s]:
                room[s] -= 1
                where[arc][s] += 1
            else:
                over.append(arc)
    for arc in over:
        i = arc
        while not room[nodes[i % len(nodes)][1]]:
            i += 1
        s = nodes[i % len(nodes)][1]
        room[s] -= 1
        where[arc][s] += 1
    return where


@pytest.mark.parametrize("n", [0, 1, 7, 500])
def test_plan_is_the_walk(n):
    nodes = sharding.ring(5, 4)
    counts = {a: (a * 37 + n) % 11 * n // 20 for a in range(len(nodes))}
    room = sharding.capacities(sum(counts.values()), 5, 0.0)
    got = defaultdict(Counter)
    slots = defaultdict(list)
    for arc, lo, hi, shard, slot in sharding.bounded_plan(counts, nodes, room):
        got[arc][shard] += hi - lo + 1
        slots[shard] += range(slot, slot + hi - lo + 1)
    assert got == simulate(counts, nodes, room)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_cells_cover_the_ring():
    nodes = sharding.ring(6, 10)
    cells = sharding.arc_cells(nodes, 5)
    assert cells[0][1] == -(2**63) and cells[-1][2] == 2**63 - 1
    assert all(a[2] + 1 == b[1] for a, b in zip(cells, cells[1:], strict=False))
    for cell, low, high, arc in cells:
        assert all((x + 2**63) >> 59 == cell for x in (low, high))
        assert next((i for i, (p, _) in enumerate(nodes) if p >= high), 0) == arc


def test_rows(spark):
    rows = [(i, f"text {i % 50}") for i in range(3000)] + [(None, None)] * 5 + [(None, "x"), (1, "text 1"), (1, "other")]
    df = spark.createDataFrame([(*r, 9, 9) for r in rows], "doc_id bigint, text string, shard int, cell bigint")
    got = sharding.shard_rows(df, shards=7, virtual=32).collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == len(rows) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    assert sharding.shard_rows(df.limit(0), shards=7, virtual=8).count() == 0


def test_slack_bounds_loads_and_movement(spark):
    df = spark.range(20000).select("id", "id")
    df = spark.range(20000).selectExpr("id AS doc_id", "cast(id AS string) AS text")
    a = {r.doc_id: r.shard for r in sharding.shard_rows(df, shards=10, virtual=64, slack=0.1).collect()}
    b = {r.doc_id: r.shard for r in sharding.shard_rows(df, shards=11, virtual=64, slack=0.1).collect()}
    assert max(Counter(a.values()).values()) <= 2200
    assert sum(a[i] != b[i] for i in a) / len(a) < 0.25


def test_no_python_on_the_executors(spark):
    df = spark.range(100).selectExpr("id AS doc_id", "cast(id AS string) AS text")
    plan = sharding.shard_rows(df, shards=3, virtual=4)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
