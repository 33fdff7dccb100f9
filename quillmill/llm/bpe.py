"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is cut by a split pattern into matches, and the bytes of each match are
merged by rank. Both are reduced up a tree, without a look at the text as a whole:

Text. Blocks of ``leaf`` characters are split on their own and joined pairwise up
the tree. A block is a list of units, each of one match or of several whole ones.
Units of the left block that end ``look`` characters or more before the seam stand,
as the pattern looks no further than that beyond a match; from there the text is
split anew until a match ends where one of the right block's units does. As the
pattern looks at nothing before a match, all that follows is the same as in the
right block. A match that crosses the seam is joined from its two parts' tokens.

Match. Bytes beyond ``least`` are halved too. At a join, the tokens next to the seam
are merged anew in a window that grows on either side until the tokens inside and
outside agree: a sequence of tokens is that of its bytes exactly if each two
neighbours are that of theirs (the first merge across a border would otherwise
happen between those two alone as well), so the tokens beyond the window provably
stay.

Joins are associative, so the tree's shape doesn't change the result. The left part
of a join is the largest power of two of leaves, which keeps runs of one character
aligned with their tokens. Decoding concatenates bytes up such a tree.

The pattern must match every character and have no match with a space behind a
character that is none, as that of byte-level vocabularies does, and every single
byte must have a rank.

Defined results: null text is empty text, with no ids. Repeated rows, null ids
and empty tables need nothing special: every row is encoded by itself.
"""

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

#: Characters of a text's leaf and ids of a decoded one.
LEAF = 512
#: Bytes of a match that are merged at once.
LEAST = 64
#: Characters that the pattern may look at beyond a match (contractions and runs of white space take two).
LOOK = 4
#: Matches, and pairs of tokens, that a worker keeps the result of (about 150 MB).
KEPT = 1 << 20
#: White space before a space.
_WIDE = re.compile("[\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000] ")


class _Kept(dict):
    """Results of a function that says whether to keep them; all are forgotten when there are too many."""

    def __init__(self, f) -> None:
        super().__init__()
        self.f = f

    def __missing__(self, key):
        out, keep = self.f(key)
        if keep:
            if len(self) >= KEPT:
                self.clear()
            self[key] = out
        return out


class Codec:
    """Encodes by a rank file and a split pattern; needs no special tokens."""

    def __init__(self, ranks_path: str, pattern: str, leaf: int = LEAF, least: int = LEAST, look: int = LOOK) -> None:
        import regex

        with open(ranks_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.leaf, self.least, self.look = max(1, leaf), max(1, least), look
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for b, i in self.ranks.items():
            self.bytes_of[i] = b
        self.single = [self.ranks[bytes([x])] for x in range(256)]
        self.tokens_of, self.fits, self.pairs = _Kept(self._of_unit), _Kept(self._fit), _Kept(self._pair)
        self.joins = 0  #: of text blocks so far

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self._block(text, 0, len(text))[1]))

    # A block of text: its units and the tokens of each.

    def _block(self, text: str, lo: int, hi: int) -> tuple[list[str], list[tuple[int, ...]]]:
        if hi - lo > self.leaf:
            mid = lo + _left(hi - lo, self.leaf)
            return self._join(text, mid, hi, *self._block(text, lo, mid), *self._block(text, mid, hi))
        block = text[lo:hi]
        if _WIDE.search(block):
            units = self.pattern.findall(block)
        else:  # every space begins a match
            first, *others = block.split(" ")
            units = [first] if first else []
            units += [" " + x for x in others]
        return units, list(map(self.tokens_of.__getitem__, units))

    def _join(self, text, mid, hi, left, left_tokens, right, right_tokens):
        self.joins += 1
        at, keep = mid, len(left)
        while keep and (keep == len(left) or mid - at < self.look):
            keep -= 1
            at -= len(left[keep])
        units, tokens, edge, skip = [], [], mid, 0
        while at < mid or edge != at:
            stop = self.pattern.match(text, at, hi).end()
            units.append(text[at:stop])
            long = stop - at > self.leaf and len(left[-1]) == mid - at and len(right[0]) == stop - mid
            whole = long and all(self.pattern.match(x).end() == len(x) for x in (left[-1], right[0]))
            tokens.append(tuple(self._glued(left_tokens[-1], right_tokens[0])) if whole else self.tokens_of[units[-1]])
            at = stop
            while edge < at:
                edge += len(right[skip])
                skip += 1
        left[keep:], left_tokens[keep:] = units, tokens
        left += right[skip:]
        left_tokens += right_tokens[skip:]
        return left, left_tokens

    def _of_unit(self, unit: str) -> tuple[tuple[int, ...], bool]:
        """Tokens; only those of single matches are kept."""
        matches = self.pattern.findall(unit)
        if len(matches) > 1:
            return tuple(chain.from_iterable(map(self.tokens_of.__getitem__, matches))), False
        data = unit.encode()
        known = self.ranks.get(data)
        return (known,) if known is not None else tuple(self._halved(data)), len(data) <= self.least

    # The bytes of a match.

    def _halved(self, data: bytes) -> list[int]:
        if len(data) <= self.least:
            return self._merged(data)
        mid = _left(len(data), self.least)
        return self._glued(self._halved(data[:mid]), self._halved(data[mid:]))

    def _glued(self, left, right) -> list[int]:
        """The tokens of both sides' bytes together."""
        a = b = 1
        while True:
            window = self._merged(b"".join(map(self.bytes_of.__getitem__, chain(left[-a:], right[:b]))))
            fits_left = a >= len(left) or self.fits[left[-a - 1], window[0]]
            fits_right = b >= len(right) or self.fits[window[-1], right[b]]
            if fits_left and fits_right:
                return [*left[:-a], *window, *right[b:]]
            a, b = (a if fits_left else min(2 * a, len(left))), (b if fits_right else min(2 * b, len(right)))

    def _fit(self, pair: tuple[int, int]) -> tuple[bool, bool]:
        return self._merged(self.bytes_of[pair[0]] + self.bytes_of[pair[1]]) == [*pair], True

    def _merged(self, data: bytes) -> list[int]:
        """Neighbours merge as long as any two have a rank together, the least rank first and of equals the first."""
        if len(data) > 4 * self.least:
            return self._merged_long(data)
        parts, pairs, none = [self.single[x] for x in data], self.pairs, len(self.bytes_of)
        ranks = [pairs[p] for p in zip(parts, parts[1:], strict=False)]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            parts[i] = least
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = pairs[least, parts[i + 1]]
            if i:
                ranks[i - 1] = pairs[parts[i - 1], least]
        return parts

    def _pair(self, pair: tuple[int, int]) -> tuple[int, bool]:
        return self.ranks.get(self.bytes_of[pair[0]] + self.bytes_of[pair[1]], len(self.bytes_of)), True

    def _merged_long(self, data: bytes) -> list[int]:
        """The same by a heap of (rank, place): a window may hold very many tokens."""
        n = len(data)
        stop, before = list(range(1, n + 1)), list(range(-1, n - 1))  # by a part's first byte: its end, the part before
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := self.ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            mid = stop[i]
            if mid <= i or mid >= n or stop[mid] != end:
                continue  # one of the two has merged since
            stop[i], stop[mid] = end, -1
            if end < n:
                before[end] = i
                if (r := self.ranks.get(data[i : stop[end]])) is not None:
                    heapq.heappush(heap, (r, i, stop[end]))
            if i and (r := self.ranks.get(data[before[i] : end])) is not None:
                heapq.heappush(heap, (r, before[i], end))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[data[i : stop[i]]])
            i = stop[i]
        return out

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        mid = _left(len(ids), self.leaf)
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


def _left(n: int, leaf: int) -> int:
    """The most leaves, a power of two, that leave something on the right."""
    return leaf << ((n - 1) // leaf).bit_length() - 1


@lru_cache(maxsize=4)
def codec(ranks_path: str, pattern: str, leaf: int = LEAF) -> Codec:
    """One per Python worker; building it takes longer than many texts do."""
    return Codec(ranks_path, pattern, leaf)


def encoded(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with a column ids of token ids."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(ranks_path, pattern)
        for batch in texts:
            yield pd.Series([c.encode(t) if t else [] for t in batch])

    return docs.withColumn("ids", run(F.col(text)))


def decoded(rows: DataFrame, ranks_path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """rows with a column decoded of bytes."""

    @F.pandas_udf(T.BinaryType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(ranks_path, pattern)
        for batch in batches:
            yield pd.Series([c.decode(i.tolist()) if i is not None else b"" for i in batch])

    return rows.withColumn("decoded", run(F.col(ids)))


def round_trip_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and whether decoding gave the text back.

    Encoding, decoding and digesting share one pass, so no ids leave the worker.
    """
    rows = docs.select("doc_id", "text")
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        c = codec(ranks_path, pattern)
        digits = [str(i) for i in range(len(c.bytes_of))]
        for b in batches:
            n, ids_sha, text_sha, same = [], [], [], []
            for t in b.column("text"):
                t = t.as_py() or ""
                ids = c.encode(t)
                back = c.decode(ids)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(digits.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(back).hexdigest())
                same.append(back == t.encode())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string()), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"])

    return rows.mapInArrow(run, f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean")
