"""Where the public vocabularies lie; operators get these paths as parameters."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable
from functools import lru_cache


def byte_level() -> tuple[str, str]:
    """Rank file and split pattern of the byte-level vocabulary; its ids are those of the JSON file of the same name, which adds byte_level_added."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def byte_level_added() -> dict[str, int]:
    """Ids of the tokens that the JSON file adds to the rank file; the tokenizers library finds them in texts before it splits."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        tokens = json.load(f)["added_tokens"]
    plain = not any(t[k] for t in tokens for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if not plain:
        raise ValueError("added tokens that take in their surroundings aren't handled")
    return {t["content"]: t["id"] for t in tokens}


@lru_cache(maxsize=4)
def library_encoder(ranks_path: str, pattern: str) -> Callable[[str], list[int]]:
    """The tiktoken library's encoding of ordinary text; one per Python worker."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
