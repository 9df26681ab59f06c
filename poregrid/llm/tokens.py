"""Token ids and token counts of a text column, by the encoder of ``bpe``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poregrid.llm.bpe import TOKENIZER_DIR, load_encoder
from poregrid.session import spread_rows


def _source(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    return spread_rows(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))), df.schema[id_col].dataType.simpleString()


def encode_column(
    df: DataFrame, id_col: str, text_col: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR, out: str = "ids"
) -> DataFrame:
    """``id_col, out``: the ids of every text, without special tokens, as ``array<int>``.

    The name of a special token inside a text is ordinary text. An empty or null text gives an empty
    list, never null; repeated rows give repeated results.
    """
    source, id_type = _source(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load_encoder(tokenizer, folder)
        for batch in batches:
            packed = [encoder.encode_packed(t) for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(packed) + 1, dtype=np.int32)
            np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
            values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(packed))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], [id_col, out])

    return source.mapInArrow(run, f"`{id_col}` {id_type}, `{out}` array<int>")


def count_tokens(
    df: DataFrame, id_col: str, text_col: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR, out: str = "n_tokens"
) -> DataFrame:
    """``id_col, out``: the number of tokens of every text; 0 for an empty or null text."""
    source, id_type = _source(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load_encoder(tokenizer, folder)
        for batch in batches:
            counts = [len(encoder.encode_packed(t)) // 4 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int32())], [id_col, out])

    return source.mapInArrow(run, f"`{id_col}` {id_type}, `{out}` int")


def decode_column(
    df: DataFrame, id_col: str, ids_col: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR, out: str = "text"
) -> DataFrame:
    """``id_col, out``: the text of every list of ids; an empty or null list gives an empty text."""
    source = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load_encoder(tokenizer, folder)
        for batch in batches:
            texts = [encoder.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, out])

    return source.mapInArrow(run, f"`{id_col}` {id_type}, `{out}` string")
