import random

import pytest

from poregrid.llm.topn import last_of, top_items

SCHEMA = "g string, score double, a int, b int, id bigint, heap int, item string"  # the last two clash with names inside


def test_equals_sorting_with_ties_nulls_and_repeats(spark):
    rng = random.Random(2)
    rows = [("hot", rng.choice([0.1, 0.2, 0.3, None]), rng.randint(1, 4), rng.choice([1, 2, None]), i, 0, "") for i in range(3000)]
    rows += [(g, 0.5, 1, 1, k, 0, "") for k, g in enumerate(["one", "two", "two", None])] + [("hot", 0.3, 1, 1, 7, 0, "")] * 2
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = {}
    for r in top_items(df, ["g"], 5, [("score", True), ("a", False), ("b", False), ("id", False)]).collect():
        got.setdefault(r.g, {})[r.rank_no] = (r.score, r.a, r.b, r.id)
    low = float("inf")
    for g in {r[0] for r in rows}:
        best = sorted((r[1:5] for r in rows if r[0] == g), key=lambda r: (-(r[0] if r[0] is not None else -low), r[1], r[2] if r[2] is not None else low, r[3]))[:5]
        assert [got[g][k] for k in sorted(got[g])] == best and sorted(got[g]) == list(range(1, len(best) + 1))


def test_empty_and_bad_n(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert top_items(df, ["g"], 3, [("score", True)]).count() == 0
    with pytest.raises(ValueError):
        top_items(df, ["g"], 0, [("score", True)])


def test_last_row_of_a_key(spark):
    rows = [("k", 1, 10), ("k", 2, 5), ("k", 2, 9), (None, 1, 1), (None, 1, 2)]
    df = spark.createDataFrame(rows, "k string, at int, id int")
    assert {(r.k, r.at, r.id) for r in last_of(df, ["k"], ["at", "id"]).collect()} == {("k", 2, 9), (None, 1, 2)}
