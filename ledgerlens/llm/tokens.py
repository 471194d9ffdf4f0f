"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files (a path on every executor) and the one used.
FOLDER = os.environ.get("LEDGERLENS_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class PieceSizes(dict):
    """piece -> number of tokens. Merges never cross pieces, so a text's size is the sum over its pieces."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, piece: str) -> int:
        if len(self) > 400_000:
            self.clear()
        n = self[piece] = len(self.encoding.encode_ordinary(piece))
        return n


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), path: str | None = None) -> DataFrame:
    """(key, *keep, tokens int): the size of each text; null text has none. Rows are neither dropped nor merged."""
    import regex

    where = path or f"{FOLDER}/{VOCABULARY}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes, split = PieceSizes(where), regex.compile(PATTERN).findall
        for pdf in batches:
            n = [0 if t is None else sum(map(sizes.__getitem__, split(t))) for t in pdf["__text"]]
            yield pdf.drop(columns="__text").assign(tokens=pd.Series(n, dtype="int32", index=pdf.index))

    rows = df.select(key, *keep, F.col(text).alias("__text"))
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInPandas(run, f"{shape}, tokens int")
