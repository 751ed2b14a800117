"""Sizes of texts in tokens of a public tokenizer, exactly, at the speed of a dictionary.

A byte-level BPE never merges across the pieces its pattern cuts a text into. The size of a text is thus the sum of the sizes of its
pieces, and as pieces are mostly words, their sizes are looked up; only a piece not met before is encoded.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Where the vocabulary is; a parameter of every operator that counts tokens.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that belongs to this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class TokenCounter:
    """Counts tokens; keeps the sizes of up to `most` pieces."""

    def __init__(self, vocabulary: str = VOCABULARY, most: int = 500_000):
        import regex
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("counted", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = regex.compile(PATTERN).findall
        self.most = most
        counter = self

        class Sizes(dict):
            def __missing__(self, piece: str) -> int:
                if len(self) >= counter.most:
                    self.clear()
                n = self[piece] = len(counter.encoding.encode_ordinary(piece))
                return n

        self.sizes = Sizes()

    def __call__(self, text: str | None) -> int:
        return sum(map(self.sizes.__getitem__, self.pieces(text))) if text else 0


def sized(documents: DataFrame, keep: tuple[str, ...] = (), vocabulary: str = VOCABULARY) -> DataFrame:
    """`doc_id, <keep>, n_tokens` of each row; NULL and empty texts have 0 tokens."""
    kinds = dict(documents.dtypes)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = TokenCounter(vocabulary)
        for b in batches:
            n = [counter(t) for t in b["text"]]
            yield b.drop(columns="text").assign(n_tokens=pd.Series(n, dtype="int64", index=b.index))

    schema = ", ".join([f"doc_id {kinds['doc_id']}", *(f"{c} {kinds[c]}" for c in keep), "n_tokens bigint"])
    return documents.where("doc_id is not null").select("doc_id", *keep, F.col("text")).mapInPandas(count, schema)
