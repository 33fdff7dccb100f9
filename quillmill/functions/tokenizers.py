"""Tokenizers as plug-ins. A tokenizer has encode(text) -> ids and decode(ids) -> text.

``WordTokenizer`` needs no files: words, digits runs and single other characters are
tokens, white space is not. Its column form gives the same ids inside the JVM.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from typing import Protocol

from pyspark.sql import Column, DataFrame, functions as F

TOKEN = r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9\s]"


class Tokenizer(Protocol):
    def encode(self, text: str) -> list[int]: ...

    def decode(self, ids: list[int]) -> str: ...


@lru_cache(maxsize=1 << 16)
def _word_id(token: str) -> int:
    return int(hashlib.md5(token.encode()).hexdigest()[:7], 16)


class WordTokenizer:
    """Ids are the first 28 bits of a token's MD5; decoding knows the tokens seen by this object, unless it is to remember none."""

    def __init__(self, remembers: bool = True) -> None:
        self.pattern, self.seen, self.remembers = re.compile(TOKEN), {}, remembers

    def encode(self, text: str) -> list[int]:
        tokens_ = self.pattern.findall(text)
        ids = [_word_id(t) for t in tokens_]
        if self.remembers:
            self.seen.update(zip(ids, tokens_, strict=True))
        return ids

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.seen.get(i, "?") for i in ids)


class HubTokenizer:
    """A tokenizer of the ``tokenizers`` library from a JSON file."""

    def __init__(self, path: str) -> None:
        self.path, self._loaded = path, None

    def _inner(self):
        if self._loaded is None:
            from tokenizers import Tokenizer as Loaded

            self._loaded = Loaded.from_file(self.path)
        return self._loaded

    def __getstate__(self) -> dict:
        return {"path": self.path, "_loaded": None}

    def encode(self, text: str) -> list[int]:
        return self._inner().encode(text, add_special_tokens=False).ids

    def decode(self, ids: list[int]) -> str:
        return self._inner().decode(ids, skip_special_tokens=True)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?U){TOKEN}"), F.lit(0))


def token_ids(text: Column) -> Column:
    """WordTokenizer.encode as a column."""
    return F.transform(tokens(text), lambda t: F.conv(F.substring(F.md5(t.cast("binary")), 1, 7), 16, 10).cast("int"))


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"(?U){TOKEN}"))


def encoded(df: DataFrame, tokenizer: Tokenizer, text: str, into: str) -> DataFrame:
    """df with the ids of a text column."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            values = b.column(b.schema.get_field_index(text)).to_pylist()
            yield b.append_column(into, pa.array([None if v is None else tokenizer.encode(v) for v in values], pa.list_(pa.int32())))

    kinds = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema)
    return df.mapInArrow(run, f"{kinds}, `{into}` array<int>")
