import os

import numpy as np
import pytest

from poregrid.llm import reading
from poregrid.llm.prose import english_lines, strip_code

TABLES = "/root/testdata/sf0.1"


@pytest.mark.parametrize("text,gone,kept", [
    ("before\n```py\nx = 1\n```\nafter", "x = 1", ["before", "after"]),
    ("<p>```sh\n$ run\n```</p>\n<p>the rest</p>", "run", ["the rest"]),
    ("a\n\n    code here\n\nb", "code here", ["a", "b"]),
    ("<pre><code>int i;</code></pre> tail", "int i", ["tail"]),
    ("use `flag` and https://x.example/y?z now", "flag", ["use", "and", "now"]),
    ("open\n~~~\nnever closed", "never", ["open"]),
])
def test_code_is_left_out(text, gone, kept):
    got = strip_code(text)
    assert gone not in got and all(k in got for k in kept)


def test_only_english_counts():
    de = "Das Programm zeigt einen größeren Ordner obwohl nichts geändert wurde und die Datei ist neu."
    en = "The small dog of the house took that bone to your garden before the rain came."
    assert english_lines(de)[1] == []
    assert len(english_lines(f"{de}\n{en}\n{en}\nThanks!")[1]) == 33
    assert english_lines("窓は昨日から同じ番号を変えますか")[1] == []


def test_levels_of_odd_inputs(spark):
    from pyspark.sql import functions as F

    text = "The small dog of the house took that bone to your garden before the rain came. " * 5
    hard = "Notwithstanding the categorical incommensurability of the phenomenology, this transcendental methodology systematized our epistemology. " * 5
    rows = [(1, text), (2, hard), (3, None), (4, ""), (5, "short"), (2, hard), (6, text * 2000)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([(1, " Basic "), (2, "ADVANCED"), (2, "advanced"), (9, "basic"), (None, "basic"), (1, None), (1, "hm")], "doc_id bigint, reading_level string").withColumn("reader_id", F.lit(1))
    got = sorted((r.doc_id, r.level, r.n_words > 49) for r in reading.reading_levels(docs, labels).collect())
    assert got == [(1, "basic", True), (2, "advanced", True), (2, "advanced", True), (3, None, False), (4, None, False), (5, None, False), (6, "basic", True)]
    assert all(r.level is None for r in reading.reading_levels(docs, labels.where("false")).collect())
    assert reading.reading_levels(docs.where("false"), labels).count() == 0


def test_a_vote_sent_again_counts_once(spark):
    rows = [(1, 7, "basic"), (1, 7, " BASIC"), (1, 8, "advanced"), (1, 7, "advanced"), (2, None, "basic"), (2, None, "basic"), (None, 1, "basic"), (3, 1, "hm")]
    labels = spark.createDataFrame(rows, "doc_id bigint, reader_id int, reading_level string")
    assert sorted(map(tuple, reading.votes_of(labels, "doc_id", "reading_level", "reader_id").collect())) == [(1, 1, 0, 2), (2, 2, 0, 0)]
    assert sorted(map(tuple, reading.votes_of(labels, "doc_id", "reading_level", None).collect())) == [(1, 2, 0, 2), (2, 2, 0, 0)]


def test_rarity_does_not_depend_on_the_size_of_the_corpus(spark):
    text = "the small dog of the house took that bone to your garden before the rain came and " * 5
    rare = text + " zygote quixotic"
    docs = spark.createDataFrame([(i, rare if i == 0 else text) for i in range(40)], "doc_id int, text string")
    one = reading.common_words(reading.extract(docs, "doc_id", "text"), 1e-4)
    many = reading.common_words(reading.extract(docs.unionByName(docs).unionByName(docs), "doc_id", "text"), 1e-4)
    assert one == pytest.approx(many) and "zygote" in one and abs(sum(one.values()) - 1) < 1e-9
    coarse = reading.common_words(reading.extract(docs, "doc_id", "text"), 1e-3)
    assert "zygote" not in coarse and len(coarse) <= 1_000
    assert reading.WordTraits(coarse, 1e-3)["zygote"][0] == pytest.approx(-np.log(1e-3))


@pytest.mark.skipif(not os.path.exists(TABLES), reason="no test tables here")
def test_held_out_accuracy(spark):
    """Levels of posts whose labels the operator has not seen, against what their readers said."""
    from pyspark.sql import functions as F

    labels = spark.read.parquet(f"{TABLES}/reading_labels.parquet")
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    seen = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    got = reading.reading_levels(docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi"), labels.where(seen))
    votes = reading.votes_of(labels.where(~seen), "doc_id", "reading_level", "reader_id")
    rows = got.where("level is not null").join(votes, "doc_id").collect()
    v = np.array([[r.v0, r.v1, r.v2] for r in rows])
    guess = np.array([reading.LEVELS.index(r.level) for r in rows])
    clear = v.max(1) == v.sum(1)
    sure = clear & (v.sum(1) >= 2)
    per_level = {n: (int((v[clear].argmax(1) == k).sum()), float((guess[clear & (v.argmax(1) == k)] == k).mean())) for k, n in enumerate(reading.LEVELS)}
    print("held out: posts and share right by level", per_level, "two or more readers", int(sure.sum()), float((guess[sure] == v[sure].argmax(1)).mean()))
    assert clear.sum() > 50 and (guess[clear] == v[clear].argmax(1)).mean() > 0.85
    assert (guess[sure] == v[sure].argmax(1)).mean() > 0.93
