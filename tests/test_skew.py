import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from poregrid.operators import skew

SCHEMA = "key int, value double, freq int, part string"  # the last two clash with names used inside


def brute(rows, percentiles):
    out = {}
    for key in {r[0] for r in rows}:
        values = [r[1] for r in rows if r[0] == key and r[1] is not None and not math.isnan(r[1])]
        counts = Counter(values)
        mode = min((v for v in counts if counts[v] == max(counts.values())), default=None)
        ranks = [float(np.quantile(values, p)) if values else None for p in percentiles]
        out[key] = (sum(r[0] == key for r in rows), len(values), len(counts), mode, *ranks)
    return out


@pytest.mark.parametrize("limit", [200_000, 7])
def test_statistics_equal_brute_force_with_one_hot_key(spark, limit):
    rng = random.Random(1)
    rows = [(1, round(rng.gauss(0, 5), 1)) for _ in range(700)] + [(rng.randint(2, 9), round(rng.random(), 2)) for _ in range(300)]
    rows += [(None, 2.0), (None, 2.0), (5, None), (6, float("nan")), (77, None), (1, -0.0), (1, 0.0)]
    df = spark.createDataFrame([(*r, 3, "x") for r in rows], SCHEMA)
    got = skew.key_statistics(df, F.col("key"), F.col("value"), (0.0, 0.5, 0.9, 1.0), limit).collect()
    want = brute(rows, (0.0, 0.5, 0.9, 1.0))
    assert {r.key for r in got} == set(want)
    for r in got:
        have = (r.n_rows, r.n_values, r.n_distinct, r.mode, r.p0, r.p50, r.p90, r.p100)
        for a, b in zip(have, want[r.key]):
            assert a == b or (b is not None and abs(a - b) < 1e-9), (r.key, have, want[r.key])


def test_heavy_keys_count_every_row(spark):
    df = spark.createDataFrame([(1, 0.5, 1, "")] * 50 + [(None, None, 1, "")] * 30 + [(k, 0.1, 1, "") for k in range(10, 30)], SCHEMA)
    got = {(r.key, r.n_rows) for r in skew.heavy_keys(df, F.col("key"), F.col("value"), 0.3).collect()}
    assert got == {(1, 50), (None, 30)}


def test_empty_input(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert skew.key_statistics(df, F.col("key"), F.col("value")).count() == 0
    assert skew.heavy_keys(df, F.col("key"), F.col("value"), 0.01).count() == 0
