"""Fields that hold several values: one row per value, with its position.

A field is a row of slots between delimiters. A column may be defined to part at every unquoted delimiter;
then its slots are its values. Otherwise, whether an unquoted delimiter parts two values or stands inside
one (``Smith, John``) is settled by a model of the whole column:

    P(field) = product of the frequencies of its values
               x, per gap, the chance that a delimiter of this kind is literal, or that it is not

1. *Counts.* One pass counts every slot, every quoted value and every gap by its kind. A value that
   stands quoted somewhere with a delimiter inside may stand unquoted elsewhere: it is a candidate.
   Neighbours that merely occur together are none, however often they do; copies of a field prove nothing.
2. *EM.* The lattice of a field has an edge for each slot and one for each run of unquoted slots that
   spells a candidate. Forward-backward sums the expected frequency of each value and of literal gaps
   of each kind; these are the next round's parameters. Fields without a candidate have one path, so
   their counts are the same in every round and enter as constants.
3. *Viterbi.* The likeliest path of each lattice gives the values and their positions.

Where writers quote what holds a delimiter, the chance of a literal one falls to nothing within a few
rounds and every unquoted delimiter parts; where they often leave the quotes out, it rises. Quoted spans
are single edges whatever they hold.

Nothing is capped: the candidates reach the tasks as a bitmap of fixed size (a hit is confirmed by a
join), and the frequencies that a lattice needs are joined to it.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poregrid.session import materialize, spread_rows

#: Distinct texts a task counts before it hands its counts on.
FLUSH_AT = 300_000
#: Bits of the bitmap that stands for the candidates; 2 MB at any number of them.
BITMAP_BITS = 1 << 24
#: Chance of a literal delimiter before the first round, of every kind.
START_CHANCE = 0.5

DELIMITER = re.compile(r"(\s*[,;|/]\s*|\s+)")
#: A quoted span at the start of a slot, closed before a delimiter or the end; or bare text up to one.
QUOTED = re.compile(r"""(?:"((?:[^"]|"")*)"|'((?:[^']|'')*)')(?=\s*[,;|/]|\s|$)""")
BARE = re.compile(r"[^\s,;|/]*")
DASHES = re.compile(r"-+")


def slots(field: str) -> tuple[list[str], list[str], list[bool]]:
    """The slot texts of a field (quotes resolved), the delimiters between them, and which were quoted."""
    field = field.strip()
    if '"' not in field and "'" not in field:
        parts = DELIMITER.split(field)
        texts = parts[::2]
        return texts, parts[1::2], [False] * len(texts)
    texts: list[str] = []
    between: list[str] = []
    quoted: list[bool] = []
    at = 0
    while True:
        found = QUOTED.match(field, at)
        if found:
            double, single = found.groups()
            texts.append(double.replace('""', '"') if double is not None else single.replace("''", "'"))
        else:
            found = BARE.match(field, at)
            texts.append(found.group())
        quoted.append(field[at : at + 1] in ('"', "'") and found.re is QUOTED)
        gap = DELIMITER.match(field, found.end())
        if not gap:
            return texts, between, quoted
        between.append(gap.group())
        at = gap.end()


def _is_missing(text: str) -> bool:
    return not text or DASHES.fullmatch(text) is not None


def _kind(gap: str) -> str:
    return gap.strip() or " "


def _key(texts: list[str], between: list[str]) -> str:
    """The slots as one text in which blanks around a delimiter do not count."""
    return "".join(t + g for t, g in zip(texts, [*map(_kind, between), ""]))


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``what, text, size, n``: values (v), candidates (c, with their number of slots) and gaps (g) of one-column batches."""
    values: Counter = Counter()
    candidates: Counter = Counter()
    gaps: Counter = Counter()

    def out() -> Iterator[pa.RecordBatch]:
        rows = [("v", t, 1, n) for t, n in values.items()] + [("c", t, size, n) for (t, size), n in candidates.items()] + [("g", t, 1, n) for t, n in gaps.items()]
        for i in range(0, len(rows), 50_000):
            yield _batch(rows[i : i + 50_000], ["what", "text", "size", "n"], [pa.string(), pa.string(), pa.int32(), pa.int64()])
        for counter in (values, candidates, gaps):
            counter.clear()

    for batch in batches:
        for field in batch.column(0).to_pylist():
            texts, between, quoted = slots(field)
            gaps.update(map(_kind, between))
            if True not in quoted:
                values.update(texts)
                continue
            for text, is_quoted in zip(texts, quoted):
                if is_quoted and DELIMITER.search(text.strip()):
                    parts, inside, nested = slots(text)
                    text = _key(parts, inside)
                    if True not in nested and all(parts):
                        candidates[text, len(parts)] += 1
                values[text] += 1
        if len(values) + len(candidates) > FLUSH_AT:
            yield from out()
    yield from out()


def _bitmap(candidates: DataFrame) -> bytearray:
    """A bit for the hash of each candidate; of fixed size, so it may be sent to every task."""
    place = F.pmod(F.crc32(F.col("text").cast("binary")), F.lit(BITMAP_BITS))
    parts = candidates.select(F.bitmap_bucket_number(place).alias("b"), F.bitmap_bit_position(place).alias("p"))
    bits = bytearray(BITMAP_BITS // 8 + 4096 * 2)
    for r in parts.groupBy("b").agg(F.bitmap_construct_agg("p").alias("m")).collect():
        bits[r.b * 4096 : (r.b + 1) * 4096] = r.m
    return bits


def _hit(bits: bytes, code: int) -> bool:
    # buckets are numbered from 1 and hold 32,768 bits from bit 0 on, as bitmap_bucket_number has it; bucket 0 has but one bit
    at = code % BITMAP_BITS
    bit = at - 1 + 32768 if at else 0
    return bool(bits[bit >> 3] >> (bit & 7) & 1)


def _has(bits: bytes, key: str) -> bool:
    return _hit(bits, zlib.crc32(key.encode()))


class Lattice:
    """The slots of one field and the runs ``(first, last, key)`` that spell a candidate."""

    def __init__(self, field: str, runs: list[tuple[int, int, str]]):
        self.texts, self.between, _ = slots(field)
        self.ends: dict[int, list[tuple[int, str]]] = {}
        for a, b, key in runs:
            self.ends.setdefault(b, []).append((a, key))
        spans: list[list[int]] = []
        for a, b, _ in sorted(runs):
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], b)
            else:
                spans.append([a, b])
        #: Stretches of slots that runs overlap; outside them every path is the same.
        self.spans = spans

    def slots(self) -> list[str]:
        return [t for a, b in self.spans for t in self.texts[a : b + 1]]

    def edges(self, a: int, b: int, weight: dict[str, float], chance: dict[str, tuple[float, float]]) -> list[list[tuple[int, str, float, list[str]]]]:
        """For each boundary of the span, the edges that end there: (start, key, log weight, literal gaps)."""
        out: list[list[tuple[int, str, float, list[str]]]] = [[]]
        for i in range(a, b + 1):
            here = []
            for start, key in [(i, self.texts[i]), *self.ends.get(i, [])]:
                literal = [_kind(g) for g in self.between[start:i]]
                w = weight[key] + sum(chance[g][0] for g in literal)
                if start > a:
                    w += chance[_kind(self.between[start - 1])][1]
                here.append((start - a, key, w, literal))
            out.append(here)
        return out

    def expect(self, weight, chance, times: float, into: Counter, literal_gaps: Counter) -> None:
        """Adds the expected frequency of each value and of literal gaps, by forward-backward."""
        for a, b in self.spans:
            edges, n = self.edges(a, b, weight, chance), b - a + 1
            forward, backward = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
            for t in range(1, n + 1):
                for s, _, w, _ in edges[t]:
                    forward[t] = _log_add(forward[t], forward[s] + w)
            for t in range(n, 0, -1):
                for s, _, w, _ in edges[t]:
                    backward[s] = _log_add(backward[s], w + backward[t])
            for t in range(1, n + 1):
                for s, key, w, literal in edges[t]:
                    p = math.exp(forward[s] + w + backward[t] - forward[n]) * times
                    into[key] += p
                    for g in literal:
                        literal_gaps[g] += p

    def best(self, weight, chance) -> list[tuple[int, int]]:
        """Runs of more than one slot on the likeliest path; of equal paths the one of fewest slots a value."""
        joined = []
        for a, b in self.spans:
            edges = self.edges(a, b, weight, chance)
            score, back = [0.0], [0]
            for ends in edges[1:]:
                top, start = max((score[s] + w, s) for s, _, w, _ in ends)
                score.append(top)
                back.append(start)
            at = b - a + 1
            while at:
                if at - back[at] > 1:
                    joined.append((a + back[at], a + at - 1))
                at = back[at]
        return sorted(joined)


def _log_add(a: float, b: float) -> float:
    high, low = (a, b) if a > b else (b, a)
    return high if low == -math.inf else high + math.log1p(math.exp(low - high))


def _log(p: float) -> float:
    return math.log(max(p, 1e-300))


RUNS = "array<struct<a:int,b:int,key:string>>"
_RUN_TYPE = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("key", pa.string())]))


def _ambiguous(fields: DataFrame, candidates: DataFrame) -> DataFrame:
    """``fid, f, n, runs``: the distinct fields in which candidates stand unquoted, and where."""
    sizes = {r.size for r in candidates.select("size").distinct().collect()}
    most = max(sizes)
    shared = fields.sparkSession.sparkContext.broadcast(bytes(_bitmap(candidates)))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            rows = []
            for field in batch.column(0).to_pylist():
                texts, between, quoted = slots(field)
                coded, gaps = [t.encode() for t in texts], [_kind(g).encode() for g in between]
                runs = []
                for i, text in enumerate(coded):
                    code, size = zlib.crc32(text), 1
                    # the hash of a run goes on from that of the run one slot shorter
                    for k in range(i, min(i + most - 1, len(gaps))):
                        code, size = zlib.crc32(gaps[k] + coded[k + 1], code), size + 1
                        if size in sizes and _hit(bits, code) and True not in quoted[i : i + size]:
                            runs.append({"a": i, "b": i + size - 1, "key": _key(texts[i : i + size], between[i : i + size - 1])})
                if runs:
                    rows.append((field, runs))
            yield _batch(rows, ["f", "runs"], [pa.string(), _RUN_TYPE])

    found = fields.mapInArrow(find, f"f string, runs {RUNS}")
    found = materialize(found.groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.any_value("runs").alias("runs")).withColumn("fid", F.sha1(F.col("f").cast("binary"))), "packed-found")
    true_runs = found.select("fid", F.explode("runs").alias("r")).join(candidates.select(F.col("text").alias("key")), F.col("r.key") == F.col("key"), "left_semi")
    return materialize(found.drop("runs").join(true_runs.groupBy("fid").agg(F.array_sort(F.collect_list("r")).alias("runs")), "fid"), "packed-ambiguous")


def _weighed(ambiguous: DataFrame, needed: DataFrame, frequencies: DataFrame) -> DataFrame:
    """``f, n, runs, w``: each ambiguous field with the frequencies (text to number) its lattice needs."""
    w = needed.join(frequencies, "text").groupBy("fid").agg(F.map_from_entries(F.collect_list(F.struct("text", "n"))).alias("w"))
    return ambiguous.join(w, "fid").select("f", F.col("n").cast("double").alias("n"), "runs", "w")


def _lattices(batch: pa.RecordBatch) -> Iterator[tuple[Lattice, str, float, dict]]:
    for field, n, runs, w in zip(*(batch.column(k).to_pylist() for k in range(4))):
        yield Lattice(field, [(r["a"], r["b"], r["key"]) for r in runs]), field, n, dict(w)


def literal_runs(fields: DataFrame, max_rounds: int = 12) -> DataFrame | None:
    """``f, joined`` of the distinct fields whose likeliest path has values of several slots; None if there is none.

    ``fields``: one column ``f`` of non-blank texts, a row for each occurrence.
    """
    counts = fields.mapInArrow(_tally, "what string, text string, size int, n bigint").groupBy("what", "text", "size").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "packed-counts")
    candidates = counts.where("what = 'c'").select("text", "size")
    if candidates.isEmpty():
        return None
    ambiguous = _ambiguous(fields, candidates)
    if ambiguous.isEmpty():
        return None
    total = float(counts.where("what = 'v'").agg(F.sum("n")).first()[0])
    gaps = {r.text: float(r.n) for r in counts.where("what = 'g'").groupBy("text").agg(F.sum("n").alias("n")).collect()}  # five kinds
    chance = dict.fromkeys(gaps, START_CHANCE)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for fid, field, n, runs in zip(*(batch.column(k).to_pylist() for k in range(4))):
                lattice = Lattice(field, [(r["a"], r["b"], r["key"]) for r in runs])
                rows += [(fid, t, float(n), 0.0) for t in lattice.slots()] + [(fid, r["key"], 0.0, float(n)) for r in runs]
            yield _batch(rows, ["fid", "text", "slots", "runs"], [pa.string(), pa.string(), pa.float64(), pa.float64()])

    places = materialize(ambiguous.select("fid", "f", "n", "runs").mapInArrow(once, "fid string, text string, slots double, runs double"), "packed-places")
    needed = places.select("fid", "text").distinct()
    here = places.groupBy("text").agg(F.sum("slots").alias("slots"), F.sum("runs").alias("runs"))
    values = counts.where("what = 'v'").select("text", F.col("n").cast("double").alias("all"))
    # A text's occurrences outside the ambiguous stretches are the same in every round; to begin with, every run counts as a value too.
    known = materialize(here.join(values, "text", "left").select("text", (F.coalesce("all", F.lit(0.0)) - F.col("slots")).alias("fixed"), (F.coalesce("all", F.lit(0.0)) + F.col("runs")).alias("n")), "packed-known")
    frequencies, merged = known.select("text", "n"), 0.0
    for _ in range(max_rounds):
        logs = {g: (_log(p), _log(1 - p)) for g, p in chance.items()}
        size = math.log(max(total - merged, 1.0))

        def expect(batches: Iterator[pa.RecordBatch], logs=logs, size=size) -> Iterator[pa.RecordBatch]:
            into: Counter = Counter()
            literal: Counter = Counter()
            for batch in batches:
                for lattice, _, n, w in _lattices(batch):
                    lattice.expect({t: _log(v) - size for t, v in w.items()}, logs, n, into, literal)
            rows = [("v", t, x) for t, x in into.items()] + [("g", t, x) for t, x in literal.items()]
            yield _batch(rows, ["what", "text", "x"], [pa.string(), pa.string(), pa.float64()])

        got = materialize(_weighed(ambiguous, needed, frequencies).mapInArrow(expect, "what string, text string, x double").groupBy("what", "text").agg(F.sum("x").alias("x")), "packed-em")
        literal = {r.text: r.x for r in got.where("what = 'g'").collect()}
        new = {g: min(literal.get(g, 0.0) / n, 1.0) for g, n in gaps.items()}
        moved, merged = max(abs(new[g] - chance[g]) for g in gaps), sum(literal.values())
        chance = new
        frequencies = known.join(got.where("what = 'v'").drop("what"), "text", "left").select("text", (F.col("fixed") + F.coalesce("x", F.lit(0.0))).alias("n"))
        if moved < 1e-5:
            break
    logs = {g: (_log(p), _log(1 - p)) for g, p in chance.items()}
    size = math.log(max(total - merged, 1.0))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lattice, field, _, w in _lattices(batch):
                joined = lattice.best({t: _log(v) - size for t, v in w.items()}, logs)
                if joined:
                    rows.append((field, [{"a": a, "b": b} for a, b in joined]))
            yield _batch(rows, ["f", "joined"], [pa.string(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))])

    joined = materialize(_weighed(ambiguous, needed, frequencies).mapInArrow(decide, "f string, joined array<struct<a:int,b:int>>"), "packed-joined")
    return None if joined.isEmpty() else joined


def _values(field: str, joined: list[dict] | None) -> list[str]:
    texts, between, _ = slots(field)
    if not joined:
        return texts
    for run in reversed(joined):
        a, b = run["a"], run["b"]
        texts[a : b + 1] = ["".join(t + g for t, g in zip(texts[a : b + 1], [*between[a:b], ""]))]
        del between[a:b]
    return texts


def unpack(
    df: DataFrame, id_col: str, field_col: str, out: str = "value", keep: tuple[str, ...] = (), every_delimiter_parts: bool = False, max_rounds: int = 12
) -> DataFrame:
    """``id_col, pos, <out>`` and the ``keep`` columns: a row for each value packed in ``field_col``.

    ``pos`` counts the values from 1. A slot that is empty or only dashes keeps its position and gives
    no row; a null, blank or dashes-only field gives none. Blanks around another delimiter
    (``, ; | /``) belong to it, blanks alone are one delimiter, and those at the ends of a field are
    ignored. A span in double or single quotes is one value, without its quotes and with doubled
    quotes made single; a quote that is not closed before a delimiter is ordinary text. A row is
    unpacked once for each time it stands in ``df``; a null id is kept as null.

    An unquoted delimiter stands inside a value only if that value also stands quoted somewhere in the
    column and the model finds it likelier than its parts. ``every_delimiter_parts`` is for columns
    defined to part at each of them: there is nothing to learn then, and the model does not run.
    """
    names = [id_col, *keep]
    picked = [F.col(c).alias(f"k{i}") for i, c in enumerate(names)]
    source = spread_rows(df.select(F.col(field_col).alias("f"), *picked).where(F.trim(F.col("f")) != ""))
    joined = None if every_delimiter_parts else literal_runs(source.select("f"), max_rounds)
    rows = source if joined is None else source.join(joined, "f", "left")
    rows = rows.select("f", *[f"k{i}" for i in range(len(names))], *([] if joined is None else ["joined"]))
    several = joined is not None
    result = [id_col, "pos", out, *keep]
    types = {c: df.schema[c].dataType.simpleString() for c in names}

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos, values, took = [], [], []
            found = batch.column(batch.num_columns - 1).to_pylist() if several else repeat(None)
            for row, (field, runs) in enumerate(zip(batch.column(0).to_pylist(), found)):
                for k, text in enumerate(_values(field, runs), 1):
                    if text and (text[0] != "-" or not _is_missing(text)):
                        took.append(row)
                        pos.append(k)
                        values.append(text)
            at = pa.array(took, pa.int64())
            kept = [batch.column(1 + i).take(at) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([kept[0], pa.array(pos, pa.int32()), pa.array(values, pa.string()), *kept[1:]], result)

    schema = ", ".join(f"`{c}` {t}" for c, t in [(id_col, types[id_col]), ("pos", "int"), (out, "string"), *[(c, types[c]) for c in keep]])
    return rows.mapInArrow(emit, schema)
