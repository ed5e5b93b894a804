"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial

import pandas as pd
from pyspark.sql import DataFrame

#: Folder of the vocabulary files.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
#: The splitting pattern that belongs to the byte-level vocabularies (a fixed value of their published form).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longer texts are cut at white space before they are encoded, so that one text cannot hold a worker's memory.
_PIECE = 200_000


@lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str | None, path: str) -> int:
    """Tokens of a text; 0 for null or empty."""
    if not text:
        return 0
    enc = _encoding(path)
    if len(text) <= _PIECE:
        return len(enc.encode_ordinary(text))
    total, at = 0, 0
    while at < len(text):
        end = min(len(text), at + _PIECE)
        if end < len(text):
            # a token never holds a blank but at its start, so a cut before a lone blank changes no token
            cut = text.rfind(" ", at + 1, end)
            while cut > at and (text[cut - 1].isspace() or text[cut + 1 : cut + 2].isspace()):
                cut = text.rfind(" ", at + 1, cut)
            end = cut if cut > at else end
        total += len(enc.encode_ordinary(text[at:end]))
        at = end
    return total


def _sized(batches: Iterable[pd.DataFrame], text: str, path: str) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = pdf.drop(columns=text)
        out["n_tokens"] = [count(x, path) for x in pdf[text]]
        yield out


def token_sizes(documents: DataFrame, keep: list[str], text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """The columns ``keep`` and ``n_tokens``: tokens of the whole text (0 for a null or empty one).

    ``tokenizer``: a ranks file; by default the byte-level one of 50,256 tokens in ``TOKENIZERS``.
    """
    path = tokenizer or os.path.join(TOKENIZERS, "byte_bpe_50k.tiktoken")
    kinds = {f.name: f.dataType.simpleString() for f in documents.schema}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ["n_tokens long"])
    return documents.select(*keep, text).mapInPandas(partial(_sized, text=text, path=path), schema)
