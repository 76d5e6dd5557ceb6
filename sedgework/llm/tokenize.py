"""Encoding of a whole corpus with a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgework.llm.bpe import BYTE_BPE_50K, PATTERN, TOKENIZERS, tokenizer

#: Texts are encoded in slices of about this many characters, so that memory doesn't depend on how long a batch's texts are.
SLICE_CHARS = 4_000_000


def _texts(column: pa.Array) -> list[str | None]:
    """The texts of a binary column; bytes that are no UTF-8 become U+FFFD."""
    return [None if b is None else b.decode("utf-8", "replace") for b in column.to_pylist()]


def encoded(documents: DataFrame, name: str = BYTE_BPE_50K, folder: str = TOKENIZERS, pattern: str = PATTERN) -> DataFrame:
    """doc_id and ids, a list of int, of each row of documents (doc_id, text); other columns are ignored.

    Null and empty texts have the empty list; rows are neither joined nor dropped, so repeated rows and null doc_ids come
    out as they are. Names of special tokens are ordinary text. One pass over the texts, without shuffle.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(name, folder, pattern)
        for batch in batches:
            texts = _texts(batch.column(1))
            begin = 0
            while begin < len(texts):
                end, chars, parts = begin, 0, []
                while end < len(texts) and (end == begin or chars < SLICE_CHARS):
                    parts.append(np.fromiter(own.encode(texts[end]), dtype=np.int32))
                    chars += len(texts[end] or "")
                    end += 1
                offsets = np.zeros(len(parts) + 1, dtype=np.int32)
                np.cumsum([len(p) for p in parts], out=offsets[1:])
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), ids], names=["doc_id", "ids"])
                begin = end

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", F.col("text").cast("binary")).mapInArrow(encode, f"doc_id {kind}, ids array<int>")


def token_counts(documents: DataFrame, name: str = BYTE_BPE_50K, folder: str = TOKENIZERS, pattern: str = PATTERN) -> DataFrame:
    """doc_id and n_tokens of each row of documents; 0 for null and empty texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(name, folder, pattern)
        for batch in batches:
            numbers = np.fromiter((own.count(t) for t in _texts(batch.column(1))), dtype=np.int64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(numbers)], names=["doc_id", "n_tokens"])

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", F.col("text").cast("binary")).mapInArrow(count, f"doc_id {kind}, n_tokens bigint")
