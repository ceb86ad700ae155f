"""Byte-pair encoding with a rank table, in Arrow batches. The table is a vocabulary file of fixed size and is sent to the tasks once."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_R50K = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: The pattern that cuts texts before merging, by encoding.
PATTERNS = {
    "gpt2": _R50K,
    "r50k_base": _R50K,
    "p50k_base": _R50K,
    "p50k_edit": _R50K,
    "cl100k_base": r"""'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}++|\p{N}{1,3}+| ?[^\s\p{L}\p{N}]++[\r\n]*+|\s++$|\s*[\r\n]|\s+(?!\S)|\s""",
    "o200k_base": r"""[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]*[\p{Ll}\p{Lm}\p{Lo}\p{M}]+(?i:'s|'t|'re|'ve|'m|'ll|'d)?|[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]+[\p{Ll}\p{Lm}\p{Lo}\p{M}]*(?i:'s|'t|'re|'ve|'m|'ll|'d)?|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n/]*|\s*[\r\n]+|\s+(?!\S)|\s+""",
}
PATTERNS["o200k_harmony"] = PATTERNS["o200k_base"]
#: Special tokens by encoding.
SPECIAL = {
    "gpt2": {"<|endoftext|>": 50256},
    "r50k_base": {"<|endoftext|>": 50256},
    "p50k_base": {"<|endoftext|>": 50256},
    "p50k_edit": {"<|endoftext|>": 50256, "<|fim_prefix|>": 50281, "<|fim_middle|>": 50282, "<|fim_suffix|>": 50283},
    "cl100k_base": {"<|endoftext|>": 100257, "<|fim_prefix|>": 100258, "<|fim_middle|>": 100259, "<|fim_suffix|>": 100260, "<|endofprompt|>": 100276},
    "o200k_base": {"<|endoftext|>": 199999, "<|endofprompt|>": 200018},
}
#: Encodings of model families.
MODELS = {
    "gpt2": "gpt2", "davinci": "r50k_base", "text-davinci-003": "p50k_base", "code-davinci-002": "p50k_base", "text-davinci-edit-001": "p50k_edit",
    "gpt-3.5-turbo": "cl100k_base", "gpt-4": "cl100k_base", "text-embedding-3-small": "cl100k_base", "gpt-4o": "o200k_base", "o1": "o200k_base", "gpt-oss": "o200k_harmony",
}


def encoding_of(model: str) -> str:
    """The encoding of a model, by its name or the longest family's name that it begins with."""
    found = [m for m in MODELS if model == m or model.startswith(m + "-")]
    if not found:
        raise KeyError("unknown model")
    return MODELS[max(found, key=len)]


class Encoding:
    """ranks: token bytes to rank. Special tokens are ordinary text unless allowed; one that is denied and occurs is an error."""

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int], pattern: str, special: dict[str, int] | None = None):
        if len(set(ranks.values())) != len(ranks):
            raise ValueError("repeated rank")
        self._sent = spark.sparkContext.broadcast((ranks, pattern, special or {}))

    def encode(self, text: Column, allowed: tuple[str, ...] = (), denied: tuple[str, ...] = ()) -> Column:
        sent = self._sent

        @F.pandas_udf("array<int>")
        def run(texts: pd.Series) -> pd.Series:
            made = _encoding(sent)
            return texts.map(lambda t: None if t is None else made.encode(t, allowed_special=set(allowed), disallowed_special=set(denied)))

        return run(text)

    def decode(self, ids: Column) -> Column:
        sent = self._sent

        @F.pandas_udf("string")
        def run(rows: pd.Series) -> pd.Series:
            made = _encoding(sent)
            return rows.map(lambda x: None if x is None else made.decode([int(i) for i in x]))

        return run(ids)

    def offsets(self, text: Column) -> Column:
        """array<struct<id, byte_start, byte_end>>: the tokens' bytes follow one another."""
        sent = self._sent

        @F.pandas_udf("array<struct<id:int,byte_start:int,byte_end:int>>")
        def run(texts: pd.Series) -> pd.Series:
            made = _encoding(sent)

            def one(t):
                at, out = 0, []
                for i in made.encode_ordinary(t):
                    size = len(made.decode_single_token_bytes(i))
                    out.append((i, at, at + size))
                    at += size
                return out

            return texts.map(lambda t: None if t is None else one(t))

        return run(text)


_made: dict[int, object] = {}


def _encoding(sent):
    if id(sent) not in _made:
        import tiktoken

        ranks, pattern, special = sent.value
        _made[id(sent)] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return _made[id(sent)]
