import numpy as np

from poregrid.llm.sketches import merge, percentiles, rank_error, sketch, tall

WANTED = {"p10": 0.1, "p50": 0.5, "p90": 0.9}


def test_rank_error_holds_for_merged_days(spark):
    rng = np.random.default_rng(4)
    values = rng.lognormal(0, 2, 60_000)
    df = spark.createDataFrame([("g", int(i % 9), float(v)) for i, v in enumerate(values)], "g string, day int, value double").repartition(6)
    days = sketch(df, ["g", "day"], "value")
    assert days.count() == 9
    ordered = np.sort(values)
    for got in (percentiles(merge(days, ["g"]), WANTED).first(), percentiles(sketch(df, ["g"], "value"), WANTED).first()):
        assert got.n == len(values)
        for name, p in WANTED.items():
            assert abs(np.searchsorted(ordered, got[name]) / len(ordered) - p) <= 2 * rank_error(800)


def test_small_groups_are_exact_and_missing_values_left_out(spark):
    rows = [("a", 1.0, None), ("a", 3.0, float("nan")), ("a", None, 2.0), ("b", None, None), (None, 5.0, 5.0)] + [("c", 7.0, 7.0)] * 50
    df = spark.createDataFrame(rows, "g string, u double, sketch double")  # a column called like a result
    got = {(r.g, r.field_name): (r.n, r.p10, r.p90) for r in percentiles(sketch(tall(df, ["g"], ["u", "sketch"]), ["g", "field_name"], "value"), WANTED).collect()}
    assert got == {("a", "u"): (2, 1.0, 3.0), ("a", "sketch"): (1, 2.0, 2.0), (None, "u"): (1, 5.0, 5.0), (None, "sketch"): (1, 5.0, 5.0), ("c", "u"): (50, 7.0, 7.0), ("c", "sketch"): (50, 7.0, 7.0)}


def test_empty(spark):
    df = spark.createDataFrame([], "g string, value double")
    assert percentiles(merge(sketch(df, ["g"], "value"), ["g"]), WANTED).count() == 0
