"""Token counts of whole texts with a public tokenizer; its vocabulary file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from folioforge.functions.staging import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: fixed value: how byte-level BPE vocabularies of this family split text
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoding(path: str):  # noqa: ANN201
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("folioforge", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str | None, path: str = VOCABULARY) -> int:
    if not text:
        return 0
    return len(encoding(path).encode_ordinary(text.encode("utf-8", "replace").decode("utf-8", "replace")))


def with_token_counts(df: DataFrame, text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``df`` with ``n_tokens`` in place of the text column; null texts have 0 tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.drop(columns=text).assign(n_tokens=np.array([count(t, path) for t in pdf[text]], np.int64))

    rest = [f for f in df.schema.fields if f.name != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + ", n_tokens long"
    return spread(df).mapInPandas(run, schema)
