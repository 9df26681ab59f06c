import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from poregrid.llm import bpe
from poregrid.llm.tokens import count_tokens, decode_column, encode_column

if not os.path.exists(bpe.TOKENIZER_DIR):
    pytest.skip("no tokenizer files here", allow_module_level=True)
tiktoken = pytest.importorskip("tiktoken")
ENCODER = bpe.load_encoder()
REFERENCE = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ENCODER.ranks, special_tokens={})
PARTS = [" ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "　", "½", "é", "漢", "👩‍💻", "the", "ing", "12", "'s", "'ll", "_", "...", "<|endoftext|>", "\x00", "K"]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.lists(st.sampled_from(PARTS), max_size=40).map("".join)))
def test_equals_the_merge_loop(text):
    text = text.encode("utf-8", "ignore").decode()
    ids = ENCODER.encode(text)
    assert ids == REFERENCE.encode_ordinary(text) and ENCODER.decode(ids) == text


@pytest.mark.parametrize("text", ["a" * 4000, "ab" * 3000, "=" * 4097, "aaaaaaab" * 500, "".join(random.Random(1).choice("abcde") for _ in range(5000))])
def test_long_pieces(text):
    assert ENCODER.encode(text) == REFERENCE.encode_ordinary(text)


def test_blocks_do_not_change_the_ids(monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 40)
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(PARTS + [" word", "x y"]) for _ in range(60))
        assert ENCODER.encode(text) == REFERENCE.encode_ordinary(text)


def test_whole_vocabulary_round_trip():
    assert all(ENCODER.decode_bytes([i]) == t for t, i in ENCODER.ranks.items())
    assert all(ENCODER.encode_piece(t) == [i] for t, i in list(ENCODER.ranks.items())[::97])


def test_columns(spark):
    texts = ["Hello world", "", None, " \n", "word " * 300_000, "Hello world"]
    df = spark.createDataFrame([(i // 2, t, i) for i, t in enumerate(texts)], "doc_id bigint, text string, ids int")
    ids = encode_column(df, "doc_id", "text")
    got = sorted((r.doc_id, r.ids) for r in ids.collect())
    assert got == sorted((i // 2, REFERENCE.encode_ordinary(t or "")) for i, t in enumerate(texts))
    assert sorted(r.n_tokens for r in count_tokens(df, "doc_id", "text").collect()) == sorted(len(i) for _, i in got)
    back = sorted((r.doc_id, r.text) for r in decode_column(ids, "doc_id", "ids").collect())
    assert back == sorted((i // 2, t or "") for i, t in enumerate(texts))
    assert encode_column(df.where("false"), "doc_id", "text").count() == 0
