"""Token lengths by a tokenizer file: a text column in, a length column out. No special tokens are added."""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..plans.staging import worker_path


@lru_cache(4)
def _measure(path: str, pattern: str | None) -> Callable[[list[str]], list[int]]:
    """Loaded once a worker."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(own.encode_ordinary(x)) for x in texts]
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    return lambda texts: [len(x.ids) for x in own.encode_batch(texts, add_special_tokens=False)]


def lengths(path: str, pattern: str | None = None) -> Callable[[Column], Column]:
    """Length in tokens by a .json, .model or .tiktoken file (the last with its pattern) that every machine has at path.

    0 without text.
    """

    @F.pandas_udf(IntegerType())
    def measured(texts: pd.Series) -> pd.Series:
        return pd.Series(_measure(path, pattern)([t or "" for t in texts]), dtype="int32")

    def column(text: Column) -> Column:
        from pyspark.sql import SparkSession

        worker_path(SparkSession.active())
        return F.when(F.length(F.coalesce(text, F.lit(""))) == 0, 0).otherwise(measured(text))

    return column
