"""Word shingles as 64-bit hashes, computed in numpy over batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves about half of the output's."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts, and where each text's begin and end.

    Words are runs without ASCII white space, in lower case and without their
    punctuation, unless they have nothing else: copies that were punctuated or
    capitalised anew have the same words.
    """
    import xxhash

    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    words = lists.flatten()
    full = np.asarray(pc.binary_length(words)) > 0
    counts = np.diff(np.asarray(lists.offsets))
    ends = np.cumsum(np.bincount(np.repeat(np.arange(len(texts)), counts), weights=full, minlength=len(texts)).astype(np.int64)) if len(words) else np.zeros(len(texts), np.int64)
    coded = pc.dictionary_encode(words.filter(pa.array(full)))
    lower = pc.utf8_lower(coded.dictionary)
    bare = pc.replace_substring_regex(lower, r"[^\p{L}\p{N}]+", "")
    plain = pc.if_else(pc.equal(pc.binary_length(bare), 0), lower, bare).cast(pa.large_binary()).to_pylist()
    table = np.fromiter(map(xxhash.xxh3_64_intdigest, plain), np.uint64, len(plain))
    return table[np.asarray(coded.indices)] if len(table) else np.zeros(0, np.uint64), np.r_[0, ends]


def document_shingles(texts: pa.Array, size: int = 5) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct shingles, ascending, and how often each occurs.

    A text of fewer words than size, but at least one, has one shingle of all its words.
    """
    h, at = word_hashes(texts)
    k = _ODD[np.arange(size) % len(_ODD)] * np.uint64(2 * size + 1)
    if len(h) >= size:
        every = np.zeros(len(h) - size + 1, np.uint64)
        for j in range(size):
            every += h[j : len(h) - size + 1 + j] * k[j]
        every = mix(every)
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= size:
            yield np.unique(every[a : b - size + 1], return_counts=True)
        elif b > a:
            yield mix(np.array([(h[a:b] * k[: b - a]).sum() + np.uint64(b - a)], np.uint64)), np.ones(1, np.int64)
        else:
            yield np.zeros(0, np.uint64), np.zeros(0, np.int64)


def sliced(texts: pa.Array, most_bytes: int = 2_000_000) -> Iterator[tuple[int, pa.Array]]:
    """(start, slice) of texts such that a slice has about most_bytes, or one text."""
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64))
    start = 0
    while start < len(texts):
        base = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, base + most_bytes, "right")))
        yield start, texts.slice(start, stop - start)
        start = stop
