import random

import pytest

from poregrid.operators import packed

CASES = [
    ("A1, A2;A3", [(1, "A1"), (2, "A2"), (3, "A3")]),
    ("A1   A2\tA3", [(1, "A1"), (2, "A2"), (3, "A3")]),
    (" ,B2 | --/C3, ", [(2, "B2"), (4, "C3")]),
    ('"a, b";c', [(1, "a, b"), (2, "c")]),
    ("'x y' 'it''s'", [(1, "x y"), (2, "it's")]),
    ('"say ""hi""",z', [(1, 'say "hi"'), (2, "z")]),
    ('"open, b', [(1, '"open'), (2, "b")]),
    ("5'-x;y", [(1, "5'-x"), (2, "y")]),
    ("", []), ("   ", []), ("-", []), ("---", []), (None, []), ('"";"-";k', [(3, "k")]),
]


@pytest.mark.parametrize("field,want", CASES)
def test_slots(field, want):
    texts = packed.slots(field)[0] if field and field.strip() else []
    assert [(k, t) for k, t in enumerate(texts, 1) if not packed._is_missing(t)] == want


def unpacked(spark, fields, **options):
    df = spark.createDataFrame(list(enumerate(fields)), "id int, f string")
    got: dict[int, list[str]] = {}
    for r in packed.unpack(df, "id", "f", **options).orderBy("id", "pos").collect():
        got.setdefault(r.id, []).append(r.value)
    return got


@pytest.mark.parametrize("options", [{}, {"every_delimiter_parts": True}])
def test_unpack_keeps_rows_positions_and_repeats(spark, options):
    rows = [(i, f, "extra") for i, (f, _) in enumerate(CASES)] + [(0, CASES[0][0], "again"), (None, "n", "null id")]
    df = spark.createDataFrame(rows, "row_id bigint, f string, pos string")  # pos clashes with a result column
    got = [(r.row_id, r.pos, r.residue) for r in packed.unpack(df, "row_id", "f", "residue", **options).collect()]
    want = [(i, *w) for i, (_, ws) in enumerate(CASES) for w in ws] + [(0, *w) for w in CASES[0][1]] + [(None, 1, "n")]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_columns_are_carried_along(spark):
    df = spark.createDataFrame([(1, "a;b", "x", 2.5), (2, None, "y", None)], "id int, f string, k string, v double")
    got = packed.unpack(df, "id", "f", keep=("k", "v"))
    assert got.columns == ["id", "pos", "value", "k", "v"]
    assert sorted(map(tuple, got.collect())) == [(1, 1, "a", "x", 2.5), (1, 2, "b", "x", 2.5)]


def test_very_long_field_and_empty_table(spark):
    fields = [";".join(f"R{k}" for k in range(30_000)), '"R1;R2";R3']
    df = spark.createDataFrame(list(enumerate(fields)), "row_id bigint, f string")
    got = packed.unpack(df, "row_id", "f", every_delimiter_parts=True).where("row_id = 0")
    assert got.count() == 30_000 and got.where("pos = 30000").first().value == "R29999"
    assert packed.unpack(df.where("false"), "row_id", "f").count() == 0


@pytest.mark.parametrize("constant", ["ALA12;GLY13;SER14", "ALA12,GLY13 ; SER14", "221_C|150_B,48_B;111_A; 47_B"])
def test_values_that_always_stand_together_are_not_glued(spark, constant):
    got = unpacked(spark, [constant] * 100 + [f"R{k},S{k}" for k in range(50)])
    want = [v.strip() for v in constant.replace(",", ";").replace("|", ";").split(";")]
    assert all(got[i] == want for i in range(100))


@pytest.mark.parametrize("alone", [5, 15, 40])
def test_a_value_known_from_quotes_is_found_without_them(spark, alone):
    rng = random.Random(alone)
    others = [f"N{k}" for k in range(30)]
    fields = [f"{rng.choice(others)};Smith, John;{rng.choice(others)}" for _ in range(100)] + ['"Smith, John"'] * 10
    fields += [rng.choice(["Smith", "John"]) for _ in range(alone)] + [";".join(rng.sample(others, 3)) for _ in range(40)]
    got = unpacked(spark, fields)
    assert all(got[i][1] == "Smith, John" and len(got[i]) == 3 for i in range(100))
    assert all(got[i] == fields[i].split(";") for i in range(110, len(fields)))
    parted = unpacked(spark, fields, every_delimiter_parts=True)
    assert all(parted[i][1:3] == ["Smith", "John"] for i in range(100)) and parted[100] == ["Smith, John"]


def test_a_quoted_pair_does_not_bind_common_neighbours(spark):
    """Writers quote what holds a delimiter: then neighbours by chance stay apart though their pair is quoted once."""
    rng = random.Random(3)
    names = [f"R{k}" for k in range(40)]
    fields = ["/".join(rng.sample(names, 4)) for _ in range(400)] + [f'"{names[k]}/{names[k + 1]}",{names[k + 2]}' for k in range(38)]
    got = unpacked(spark, fields)
    assert all(got[i] == fields[i].split("/") for i in range(400))


def test_forward_backward_expects_one_value_per_slot():
    lattice = packed.Lattice("x;a,b;y", [(1, 2, "a,b")])
    into, gaps = packed.Counter(), packed.Counter()
    weight = {"a": -1.0, "b": -1.5, "a,b": -2.0}
    lattice.expect(weight, {",": (-0.5, -0.9), ";": (-9.0, 0.0)}, 2.0, into, gaps)
    whole = into["a,b"]
    assert 0 < whole < 2 and abs(into["a"] + whole - 2) < 1e-9 and abs(into["b"] + whole - 2) < 1e-9 and gaps == {",": whole}
    assert lattice.best(weight, {",": (-0.5, -0.9), ";": (-9.0, 0.0)}) == [(1, 2)]
    assert lattice.best(weight, {",": (-3.0, -0.05), ";": (-9.0, 0.0)}) == []


def test_candidates_survive_the_bitmap(spark):
    texts = [f"T{k},U{k}" for k in range(500)] + ["é,ß"]
    bits = packed._bitmap(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert all(packed._has(bits, t) for t in texts)
    assert sum(packed._has(bits, f"no{k};x") for k in range(2_000)) < 20
