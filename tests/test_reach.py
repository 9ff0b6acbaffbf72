"""Tables reached by bitmaps, and clusters of endpoints over them, against plain Python."""

from __future__ import annotations

import random

import pytest

from graphloom.operators import analysis as ops
from graphloom.operators.reach import reached_tables, table_counts, without

HOPS = 4


def graph(seed: int, n: int):
    """Steps with cycles, starts 0 .. n/4, tables from 3n/4 on; table 3n/4 is a hub that many point at."""
    dice = random.Random(seed)
    steps = {(dice.randrange(n), dice.randrange(n)) for _ in range(2 * n)} | {(x, 3 * n // 4) for x in range(n // 4, n // 2)}
    return steps, range(n // 4), range(3 * n // 4, n)


def reach_of(steps, starts, tables):
    out = {}
    for s in starts:
        seen = now = {s}
        for _ in range(HOPS):
            now = {b for a, b in steps if a in now} - seen
            seen = seen | now
        out[s] = (seen - {s}) & set(tables)
    return out


def made(spark, steps, starts, tables, width):
    forward = spark.createDataFrame(list(steps), "here long, there long")
    ends = spark.createDataFrame([(s, f"e{s:03}") for s in starts] * 2, "key long, id string")
    held = spark.createDataFrame([(x, f"t{x:03}") for x in tables], "key long, table string")
    return reached_tables(forward, ends, held, HOPS, width)


def members(reached, sets):
    name = {r.number: r.table for r in reached.tables.collect()}
    out = {}
    for r in sets.collect():
        held = {8 * i + k for i, byte in enumerate(r.bits) for k in range(8) if byte >> k & 1}
        out.setdefault(r.id, set()).update(name[r.chunk * reached.width + at] for at in held)
    return out


@pytest.mark.parametrize("width", [8, 32_768])
def test_reached_tables_counts_and_clusters_are_those_of_plain_walks(spark, width):
    steps, starts, tables = graph(width, 60)
    want = {f"e{s:03}": {f"t{x:03}" for x in held} for s, held in reach_of(steps, starts, tables).items()}
    reached = made(spark, steps, starts, tables, width)
    assert members(reached, reached.sets) == {e: held for e, held in want.items() if held}
    fan = {}
    for held in want.values():
        for x in held:
            fan[x] = fan.get(x, 0) + 1
    assert {(r.table, r.n) for r in table_counts(reached).collect()} == set(fan.items())

    # The tables that most reach are left out, so that some endpoints stay apart.
    gone = {x for x, _ in sorted(fan.items(), key=lambda kv: -kv[1])[:10]}
    hubs = spark.createDataFrame([(x,) for x in gone], "table string")
    rest = {e: held - gone for e, held in want.items()}
    assert members(reached, without(reached, hubs)) == {e: held for e, held in rest.items() if held}

    file = {e: f"f{i % 4}" if i % 3 == 0 else None for i, e in enumerate(sorted(want))}
    root = {e: e for e in want}
    alike = lambda a, b: file[a] == file[b] if file[a] or file[b] else bool(rest[a] & rest[b])
    for _ in want:
        root = {a: min([root[a], *(root[b] for b in want if alike(a, b))]) for a in want}
    found = ops.endpoint_clusters(spark.createDataFrame(list(file.items()), "id string, file string"), reached, hubs)
    assert {(r.id, r.root) for r in found.collect()} == set(root.items())
    assert 1 < len(set(root.values())) < len(root)

    asked = set()
    for r in set(root.values()):
        own = sorted(e for e in want if root[e] == r)
        d = {x: sum(x in rest[e] for e in own) for e in own for x in rest[e]}
        first = sorted(d, key=lambda x: (-d[x], x))
        asked |= {(r, f"e{i + 1}", e) for i, e in enumerate(own[:5])} | {(r, f"t{i + 1}", x) for i, x in enumerate(first[: 5 - len(own[:5])])}
    assert {(r.root, r.ref, r.id) for r in ops.cluster_requests(found, reached, hubs, most=5).collect()} == asked


def test_masks_that_are_not_sent_to_all_tasks_give_the_same(spark, monkeypatch):
    steps, starts, tables = graph(3, 40)
    reached = made(spark, steps, starts, tables, 8)
    hubs = reached.tables.where("number % 3 = 0").select("table")
    want = members(reached, without(reached, hubs))
    monkeypatch.setattr("graphloom.operators.reach.FEW_CHUNKS", 0)
    assert members(reached, without(reached, hubs)) == want


def test_nothing_is_reached_in_an_empty_graph(spark):
    reached = made(spark, set(), range(3), range(0), 8)
    assert reached.sets.count() == table_counts(reached).count() == 0
    none = spark.createDataFrame([], "table string")
    ends = spark.createDataFrame([("a", None), ("b", "f"), ("c", "f")], "id string, file string")
    assert {(r.id, r.root) for r in ops.endpoint_clusters(ends, reached, none).collect()} == {("a", "a"), ("b", "b"), ("c", "b")}
