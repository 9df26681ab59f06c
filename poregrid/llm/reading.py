"""Reading level of posts by regularised ordinal regression.

For every post the English prose outside code is measured: lexical diversity, word rarity, length of
words and sentences, connectives, and subordinate clauses as a stand-in for clause depth. Word rarity
is minus the logarithm of a word's share of all words of the corpus, or of ``FLOOR`` if that is more:
what it says of a word does not depend on the size of the corpus, and as shares sum to 1 at most
1/``FLOOR`` words are above the floor and need to reach the tasks. A proportional-odds model with an
L2 penalty is fitted to what readers said of a sample of the posts, and scores every post in the JVM.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poregrid.llm.prose import ADVERBIAL, COORDINATING, SENTENCE, SUBORDINATING, english_lines
from poregrid.session import materialize, spread_rows

LEVELS = ("basic", "intermediate", "advanced")
FEATURES = (
    "mean_rarity", "rare_share", "long_share", "very_long_share", "word_length", "connectives_per_sentence",
    "subordinate_share", "sentence_length", "commas_per_sentence", "root_type_ratio", "type_ratio",
    "long_type_ratio", "long_types_root", "log_words",
)
MIN_WORDS = 50
#: Share of all words below which words are equally rare; at most 1/FLOOR words are above it.
FLOOR = 1e-5
#: Most labelled posts a model is fitted on; of more, those with the lowest hash of their id.
MAX_LABELLED = 20_000
LONG, VERY_LONG = 10, 13


def extract(df: DataFrame, id_col: str, text_col: str, min_words: int = MIN_WORDS) -> DataFrame:
    """``id_col, n_words, n_sentences, n_commas, words``: the English prose of every post.

    ``words`` (lower case, parted by blanks) is null for posts of fewer than ``min_words`` words. A
    null, empty or blank text has 0 words.
    """
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                lines, words = english_lines(text) if text else ([], [])
                prose = "\n".join(lines) if len(words) >= min_words else ""
                rows.append((len(words), len(SENTENCE.findall(prose)), prose.count(","), " ".join(words) if prose else None))
            columns = zip(*rows) if rows else ([], [], [], [])
            types = (pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types)]], [id_col, "n_words", "n_sentences", "n_commas", "words"]
            )

    source = spread_rows(df.select(F.col(id_col), F.col(text_col)))
    return source.mapInArrow(run, f"`{id_col}` {id_type}, n_words int, n_sentences int, n_commas int, words string")


def common_words(extracted: DataFrame, floor: float = FLOOR) -> dict[str, float]:
    """The share of all words of every word above ``floor``; at most 1/``floor`` of them."""
    counts = extracted.where(F.col("words").isNotNull()).select(F.explode(F.split("words", " ")).alias("word")).groupBy("word").count()
    counts = materialize(counts, "word-counts")
    total = counts.agg(F.sum("count")).first()[0] or 1
    return {r["word"]: r["count"] / total for r in counts.where(F.col("count") > F.lit(floor * total)).collect()}


class WordTraits(dict):
    """Word to (rarity, rare, letters, long, very long, connective, subordinating)."""

    def __init__(self, shares: dict[str, float], floor: float = FLOOR):
        self.shares, self.floor = shares, floor

    def __missing__(self, word: str) -> tuple:
        rarity = -math.log(self.shares.get(word, self.floor))
        n = len(word)
        joins = word in COORDINATING or word in SUBORDINATING or word in ADVERBIAL
        got = (rarity, rarity > 9, n, n >= LONG, n >= VERY_LONG, joins, word in SUBORDINATING)
        if len(self) < 500_000:
            self[word] = got
        return got


def measure(words: list[str], n_sentences: int, n_commas: int, traits: WordTraits) -> list[float]:
    """The features of one text of at least one word, in the order of ``FEATURES``."""
    n, types = len(words), Counter(words)
    sentences = max(1, n_sentences)
    rarity = rare = letters = long = very_long = joins = clauses = long_types = 0.0
    for word, k in types.items():
        r, is_rare, length, is_long, is_very_long, is_join, is_clause = traits[word]
        rarity += r * k
        letters += length * k
        if is_rare:
            rare += k
        if is_long:
            long += k
            long_types += 1
            if is_very_long:
                very_long += k
        if is_join:
            joins += k
            if is_clause:
                clauses += k
    root = math.sqrt(n)
    return [
        rarity / n, rare / n, long / n, very_long / n, letters / n, joins / sentences, clauses / n, n / sentences, n_commas / sentences,
        len(types) / root, len(types) / n, long_types / long if long else 0.0, long_types / root, math.log(n),
    ]


def features(extracted: DataFrame, id_col: str, shares: dict[str, float], floor: float = FLOOR) -> DataFrame:
    """``id_col, n_words`` and a double for each of ``FEATURES``, null where ``words`` is null."""
    shared = extracted.sparkSession.sparkContext.broadcast((shares, floor))
    id_type = extracted.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        traits = WordTraits(*shared.value)
        nothing = [None] * len(FEATURES)
        for batch in batches:
            stats = zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)))
            rows = [measure(w.split(" "), s, c, traits) if w else nothing for s, c, w in stats]
            columns = zip(*rows) if rows else [[]] * len(FEATURES)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(c, pa.float64()) for c in columns]], [id_col, "n_words", *FEATURES]
            )

    schema = f"`{id_col}` {id_type}, n_words int, " + ", ".join(f"{f} double" for f in FEATURES)
    return extracted.mapInArrow(run, schema)


@dataclass
class OrdinalModel:
    """P(level <= j) = sigmoid(cut_j - score); the score is linear in the standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray

    def score(self, names=FEATURES) -> Column:
        slopes = self.weights / self.scale
        terms = [F.col(n) * F.lit(float(s)) for n, s in zip(names, slopes)]
        return sum(terms[1:], terms[0]) - F.lit(float(slopes @ self.mean))

    def level(self, score: Column, levels=LEVELS) -> Column:
        got = F.lit(levels[-1])
        for name, cut in reversed(list(zip(levels, self.cuts))):
            got = F.when(score <= float(cut), F.lit(name)).otherwise(got)
        return F.when(score.isNotNull(), got)


def fit_ordinal(x: np.ndarray, votes: np.ndarray, penalty: float = 1.0, rounds: int = 1500) -> OrdinalModel:
    """Proportional odds with an L2 penalty on the weights, by gradient ascent.

    ``votes[i, j]`` is how often row i was given level j; every vote weighs the same.
    """
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-12] = 1.0
    z = (x - mean) / scale
    levels, total = votes.shape[1], votes.sum()
    weights, cuts = np.zeros(x.shape[1]), np.linspace(-1.0, 1.0, levels - 1)
    first, second = np.zeros(len(weights) + len(cuts)), np.zeros(len(weights) + len(cuts))
    for step in range(1, rounds + 1):
        below = 1 / (1 + np.exp(-np.clip(cuts[None, :] - (z @ weights)[:, None], -30, 30)))
        below = np.hstack([np.zeros((len(z), 1)), below, np.ones((len(z), 1))])
        slope = below * (1 - below)
        per = votes / np.maximum(np.diff(below, axis=1), 1e-9)
        by_cut = (per[:, :-1] - per[:, 1:]) * slope[:, 1:-1]
        gradient = np.concatenate([-(z.T @ by_cut.sum(1)) - penalty * weights, by_cut.sum(0)]) / total
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        move = 0.03 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weights, cuts = weights + move[: len(weights)], np.sort(cuts + move[len(weights):])
    return OrdinalModel(mean, scale, weights, cuts)


def votes_of(labels: DataFrame, id_col: str, level_col: str, reader_col: str | None) -> DataFrame:
    """``id_col, v0, v1, v2``: how many readers gave each level; other spellings of case and blanks count, other texts do not.

    A reader's vote sent again counts once; a reader who gave several levels has a vote for each. Rows
    without a reader, and all rows if there is no reader column, count one by one.
    """
    level = F.lower(F.trim(F.col(level_col)))
    usable = labels.where(F.col(id_col).isNotNull() & level.isin(*LEVELS))
    if reader_col is not None:
        usable = usable.select(F.col(id_col).alias("d"), F.col(reader_col).alias("r"), level.alias("l"))
        usable = usable.where("r is not null").distinct().unionByName(usable.where("r is null"))
    else:
        usable = usable.select(F.col(id_col).alias("d"), level.alias("l"))
    counted = [F.count(F.when(F.col("l") == name, 1)).alias(f"v{j}") for j, name in enumerate(LEVELS)]
    return usable.groupBy(F.col("d").alias(id_col)).agg(*counted)


def reading_levels(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", level_col: str = "reading_level",
    reader_col: str | None = "reader_id", min_words: int = MIN_WORDS, floor: float = FLOOR, max_labelled: int = MAX_LABELLED, penalty: float = 1.0,
) -> DataFrame:
    """``id_col, n_words, score, level`` for every row of ``df``.

    ``n_words`` counts the words of English prose outside code, whatever language the row claims.
    Score and level are null below ``min_words``, for null, empty and code-only texts among them, and
    everywhere if no labelled post has enough prose or all labels are of one level. Repeated rows get
    equal results.
    """
    extracted = materialize(extract(df, id_col, text_col, min_words), "prose")
    measured = materialize(features(extracted, id_col, common_words(extracted, floor), floor), "features")
    votes = votes_of(labels, id_col, level_col, reader_col)
    labelled = measured.where(F.col(FEATURES[0]).isNotNull()).join(votes, id_col)
    sample = labelled.orderBy(F.xxhash64(id_col), id_col).limit(max_labelled).select(*FEATURES, "v0", "v1", "v2").collect()
    table = np.array([list(r) for r in sample], dtype=float).reshape(-1, len(FEATURES) + len(LEVELS))
    given = table[:, len(FEATURES):]
    if (given.sum(0) > 0).sum() < 2:
        return measured.select(id_col, "n_words", F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("level"))
    model = fit_ordinal(table[:, : len(FEATURES)], given, penalty)
    scored = measured.select(id_col, "n_words", model.score().alias("score"))
    return scored.select("*", model.level(F.col("score")).alias("level"))
