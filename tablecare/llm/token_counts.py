"""Token counts by the whole-token shortcut (see ``bpe``).

Null and empty texts have no bytes and no tokens; any length of text is
counted whole; rows that repeat are counted each; an empty table gives none.
"""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_bpe
from .common import batch_of, slices

DEFAULT_TOKENIZER = "byte_bpe_50k.json"


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = DEFAULT_TOKENIZER,
                 limit: int = 512) -> DataFrame:
    """One row per row of ``df``: id, n_bytes (UTF-8), n_tokens, over_limit.

    ``tokenizer`` names a byte-level BPE file of the installed vocabularies.
    No shuffle: one scan of two columns, and Python gets them in Arrow batches.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def count(batches):
        bpe = byte_bpe(public_tokenizers.path(tokenizer))
        for part in slices(batches):
            texts = part.column(1).to_pylist()
            yield batch_of(schema, part.column(0), [len(t.encode()) if t else 0 for t in texts],
                           [bpe.count(t) for t in texts])
        bpe.forget()

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return (rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > limit))
