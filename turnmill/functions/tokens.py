"""Token counts by a public byte-level tokenizer whose file is a parameter."""

from __future__ import annotations

import base64
import re
from functools import cache

import pandas as pd
import regex
import tiktoken
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rank file (one base64 token and its rank a line), on every executor.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: how the rank files' tokenizer splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ANY = regex.compile(PATTERN)
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+")


@cache
def encoding(ranks: str = RANKS) -> tiktoken.Encoding:
    """The tokenizer, once a Python worker."""
    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(ranks, pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def splits(text: str) -> list[str]:
    """The pieces that are tokenized on their own; joined, they are the text."""
    return (_ASCII if text.isascii() else _ANY).findall(text)


class _Counts(dict):
    """Tokens of the splits met so far, started anew before it grows large."""

    def __init__(self, ranks: str) -> None:
        self.ranks = ranks

    def __missing__(self, split: str) -> int:
        if len(self) > 1 << 18:
            self.clear()
        n = self[split] = len(encoding(self.ranks).encode_ordinary(split))
        return n


@cache
def counts(ranks: str = RANKS) -> _Counts:
    return _Counts(ranks)


def n_tokens(text: Column, ranks: str = RANKS) -> Column:
    """Tokens of a text; none for null and empty texts."""

    @F.pandas_udf(T.LongType())
    def counted(texts: pd.Series) -> pd.Series:
        e = encoding(ranks)
        return pd.Series([len(e.encode_ordinary(x)) if x else 0 for x in texts], dtype="int64")

    return counted(text)
