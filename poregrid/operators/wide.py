"""Entity-attribute-value rows into one wide, typed row per entity.

First the attributes are discovered: their names are brought to one spelling, counted, and typed by
what their values hold. Then one conditional aggregate per attribute picks the value loaded last,
all in a single grouping of the rows, and the picked texts are cast to the column's type.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most attributes that become columns; more are an error, not a silent cut.
MAX_ATTRIBUTES = 2_000


@dataclass(frozen=True)
class Attribute:
    name: str  # as it is to be spelled
    column: str
    value_type: str = "array<double>"
    required: bool = False


def attribute_key(name: Column) -> Column:
    """One spelling of an attribute name: without case and without blanks and punctuation around it."""
    return F.lower(F.regexp_replace(name, r"^[\s\p{Z}\p{P}\p{S}]+|[\s\p{Z}\p{P}\p{S}]+$", ""))


def _plain_key(name: str) -> str:
    import regex

    return regex.sub(r"^[\s\p{Z}\p{P}\p{S}]+|[\s\p{Z}\p{P}\p{S}]+$", "", name).lower()


def numbers(cells: Column) -> Column:
    """The cells of a text as doubles, null where a cell is no finite number; null if no cell is one."""
    parsed = F.transform(F.split(cells, ","), lambda c: F.trim(c).try_cast("double"))
    kept = F.transform(parsed, lambda v: F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v))
    return F.when(F.exists(kept, lambda v: v.isNotNull()), kept)


def typed(text: Column, value_type: str) -> Column:
    """``text`` as ``value_type``; null where it holds no such value."""
    if value_type == "array<double>":
        return numbers(text)
    if value_type.startswith("array<"):
        inner = value_type[len("array<"):-1]
        if inner == "string":
            return F.transform(F.split(text, ","), lambda c: F.trim(c))
        return F.transform(numbers(text), lambda v: v.try_cast(inner))
    plain = F.trim(text)
    if value_type == "string":
        return F.when(plain != "", plain)
    if value_type in ("double", "float"):
        value = plain.try_cast(value_type)
        return F.when(~F.isnan(value), value)
    return plain.try_cast(value_type)


def discover(df: DataFrame, attribute: str, value: str, catalog: Sequence[Attribute] = ()) -> list[Attribute]:
    """The attributes that occur, those of ``catalog`` first and always, others typed by their values.

    An attribute whose every non-missing cell is a whole number is ``array<int>``, one whose cells are
    numbers ``array<double>``, any other ``string``. The distinct names come to the driver; beyond
    ``MAX_ATTRIBUTES`` an error is raised.
    """
    known = {_plain_key(a.name): a for a in catalog}
    missing = r"(?i)^\s*(-+|nan|n/?a|null|none)?\s*$"
    cells = F.filter(F.split(F.coalesce(F.col(value), F.lit("")), ","), lambda c: ~c.rlike(missing))
    seen = (
        df.select(attribute_key(F.col(attribute)).alias("a"), cells.alias("c"))
        .groupBy("a")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.bool_and(F.forall("c", lambda c: c.rlike(r"^\s*[+-]?[0-9]+\s*$"))).alias("whole"),
            F.bool_and(F.forall("c", lambda c: F.trim(c).try_cast("double").isNotNull())).alias("numeric"),
        )
        .where((F.col("a") != "") & ~F.col("a").isin(list(known)))
        .orderBy("a").limit(MAX_ATTRIBUTES + 1).collect()
    )
    if len(known) + len(seen) > MAX_ATTRIBUTES:
        raise ValueError(f"more than {MAX_ATTRIBUTES} attributes; keep fewer of them, or widen with a catalog of attributes alone")
    found = list(known.values())
    used = {a.column for a in found}
    for r in seen:
        column = "".join(ch if ch.isalnum() else "_" for ch in r.a)
        while column in used:
            column += "_"
        used.add(column)
        found.append(Attribute(r.a, column, "array<int>" if r.whole else "array<double>" if r.numeric else "string"))
    return found


def widen(
    df: DataFrame, entity: dict[str, Column], attribute: str, value: str, last: Sequence[str], attributes: Sequence[Attribute]
) -> DataFrame:
    """One row per entity with a column for each of ``attributes``.

    ``entity`` names the key columns; a null in a key is a key like any other. Of several rows of one
    entity and attribute the one with the greatest ``last`` columns counts, even if its value holds
    nothing. A column is null where the entity has no row of the attribute or the row holds no value
    of the type. Rows with an unknown attribute still make their entity appear. Empty input: no row.
    """
    rows = df.select(
        *[c.alias(f"k{i}") for i, c in enumerate(entity.values())],
        attribute_key(F.col(attribute)).alias("a"),
        F.struct(*[F.col(c) for c in last], F.col(value).alias("v")).alias("r"),
    )
    keys = [f"k{i}" for i in range(len(entity))]
    picked = rows.groupBy(*keys).agg(
        *[F.max(F.when(F.col("a") == _plain_key(a.name), F.col("r"))).getField("v").alias(f"a{i}") for i, a in enumerate(attributes)]
    )
    return picked.select(
        *[F.col(k).alias(name) for k, name in zip(keys, entity)],
        *[typed(F.col(f"a{i}"), a.value_type).alias(a.column) for i, a in enumerate(attributes)],
    )


def missing_required(wide: DataFrame, keys: Sequence[str], attributes: Sequence[Attribute], name: str) -> DataFrame:
    """``keys`` and the name of each required attribute whose column is null in the wide row."""
    absent = F.array_compact(F.array(*[F.when(F.col(a.column).isNull(), F.lit(a.name)) for a in attributes if a.required]))
    return wide.select(*keys, F.explode(absent).alias(name))
