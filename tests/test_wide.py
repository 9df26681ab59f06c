import datetime as dt

from pyspark.sql import functions as F

from poregrid.operators import wide

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "e string, axis string, v string, at timestamp, id bigint, k0 int, a string"  # k0 and a clash with names inside
CATALOG = [wide.Attribute("X", "sphere_x", "array<double>", True), wide.Attribute("layer", "layers", "array<int>"), wide.Attribute("Note", "note", "string")]


def make(spark, rows):
    return spark.createDataFrame([(e, a, v, T0 + dt.timedelta(days=d), i, 0, "") for e, a, v, d, i in rows], SCHEMA)


ROWS = [
    ("t1", "X", "1.0, -, 2e0", 1, 1), ("t1", " 'x': ", "nan,n/a", 2, 2), ("t1", "LAYER", "0,1,2", 1, 3), ("t1", "note", " hello ", 1, 4),
    ("t2", "x", "-,-", 1, 5), ("t2", "X", "5", 1, 6), ("t2", "X", "5", 1, 6), (None, "X", "7,+8.5E-1", 1, 7), ("t3", "charge", "1,2", 1, 8), ("t4", "X", None, 1, 9),
]


def test_last_row_wins_even_if_it_holds_nothing(spark):
    got = {r.e: r for r in wide.widen(make(spark, ROWS), {"e": F.col("e")}, "axis", "v", ["at", "id"], CATALOG).collect()}
    assert set(got) == {"t1", "t2", "t3", "t4", None}
    assert got["t1"].sphere_x is None and got["t1"].layers == [0, 1, 2] and got["t1"].note == "hello"
    assert got["t2"].sphere_x == [5.0] and got[None].sphere_x == [7.0, 0.85] and got["t3"].sphere_x is None


def test_missing_required(spark):
    w = wide.widen(make(spark, ROWS), {"e": F.col("e")}, "axis", "v", ["at", "id"], CATALOG)
    assert sorted((r.e, r.axis) for r in wide.missing_required(w, ["e"], CATALOG, "axis").collect()) == [("t1", "X"), ("t3", "X"), ("t4", "X")]


def test_discovery_types_unknown_attributes(spark):
    rows = ROWS + [("t5", "hydro", "0.5,-", 1, 10), ("t5", "free text!", "a b", 1, 11), ("t5", "layer", "1", 1, 12)]
    found = {a.name: a for a in wide.discover(make(spark, rows), "axis", "v", CATALOG)}
    assert found["charge"].value_type == "array<int>" and found["hydro"].value_type == "array<double>" and found["free text"].value_type == "string"
    assert len(found) == 6 and found["free text"].column == "free_text"


def test_empty_and_cells_with_no_finite_number(spark):
    empty = make(spark, ROWS).where("false")
    assert wide.widen(empty, {"e": F.col("e")}, "axis", "v", ["at", "id"], CATALOG).count() == 0
    df = spark.createDataFrame([("inf,NaN,-,",), ("1,inf",), ("",), (None,)], "v string")
    assert [r.n for r in df.select(wide.numbers(F.col("v")).alias("n")).collect()] == [None, [1.0, None], None, None]
