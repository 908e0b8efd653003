"""Token counts by heap-and-linked-list byte-pair merging; no identifiers are made."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from confluo.llm.bpe import MergeCounter, once
from confluo.llm.common import id_type, narrow


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row, in one scan without a shuffle.

    A null text counts as empty (0 bytes, 0 tokens); a null id stays null; repeated rows each get a row; an
    empty table gives an empty result; other columns are ignored. ``tokenizer``: a tokenizers .json file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = once(MergeCounter, tokenizer)
        for b in batches:
            texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            n = [counter.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, texts), pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return narrow(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type(docs, id_col)}, n_bytes long, n_tokens long, over_limit boolean")
