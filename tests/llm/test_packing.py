import random

import pytest
from pyspark.sql import functions as F

from poregrid.llm import packing

SCHEMA = "id bigint, n int, len int, container_id string"  # the last two clash with names inside


def item_by_item(sizes, capacity):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fit = min((r for r in rooms if r >= s), default=None)
        if fit is None:
            rooms.append(capacity - s)
        else:
            rooms[rooms.index(fit)] = fit - s
    return len(rooms)


@pytest.mark.parametrize("seed", range(8))
def test_plan_uses_as_many_containers_as_best_fit_item_by_item(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 50, 101])
    sizes = [min(capacity, max(1, int(rng.expovariate(6 / capacity)))) for _ in range(400)] + [rng.randint(1, capacity)] * rng.randint(0, 300)
    counts = {s: sizes.count(s) for s in set(sizes)}
    segments, opened = packing.plan_fill(counts, capacity)
    fill = {}
    for length in counts:
        own = sorted((a, b) for n, a, b, *_ in segments if n == length)
        assert own[0][0] == 0 and own[-1][1] == counts[length] and all(x[1] == y[0] for x, y in zip(own, own[1:]))
    for length, a, b, first, per, offset in segments:
        for rank in range(a, b):
            c = first + (rank - a) // per
            fill.setdefault(c, []).append((offset + (rank - a) % per * length, length))
    assert len(fill) == opened == item_by_item(sizes, capacity)
    for spans in fill.values():
        spans.sort()
        assert all(s + n <= t for (s, n), (t, _) in zip(spans, spans[1:])) and spans[-1][0] + spans[-1][1] <= capacity


def test_pack_is_whole_and_splits_only_long_items(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART_SIZE", 50)
    rng = random.Random(9)
    rows = [(i, rng.choice([7, 7, 7, rng.randint(1, 30), rng.randint(31, 500)]), 0, "x") for i in range(900)]
    rows += [(5000, 0, 0, ""), (5001, None, 0, ""), (5002, 30, 0, ""), (5003, 61, 0, ""), (5002, 30, 0, "")]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(6), "id", "n", 30).collect()
    size, used = {}, {}
    for r in got:
        size[r.id] = size.get(r.id, 0) + r.piece_size
        if r.container_id is not None:
            used.setdefault(r.container_id, []).append((r.start_in_container, r.piece_size))
        assert r.n_pieces == 1 or r.n_pieces > 1 and r.piece_size == min(30, r.piece_size)
    want = {}
    for i, n, *_ in rows:
        want[i] = want.get(i, 0) + (n or 0)
    assert size == want and {r.id for r in got if r.container_id is None} == {5000, 5001}
    assert {r.id for r in got if r.n_pieces > 1} == {i for i, n, *_ in rows if (n or 0) > 30}
    for spans in used.values():
        spans.sort()
        assert all(s + n <= t for (s, n), (t, _) in zip(spans, spans[1:])) and sum(spans[-1]) <= 30
    total = sum(want.values())
    assert len(used) <= 1.02 * total / 30 + 1


def test_empty_and_errors(spark):
    df = spark.createDataFrame([(1, -2, 0, "")], SCHEMA)
    assert packing.pack(df.where("false"), "id", "n", 30).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, "id", "n", 0)
    with pytest.raises(Exception, match="negative"):
        packing.pack(df, "id", "n", 30).agg(F.count("*")).collect()
