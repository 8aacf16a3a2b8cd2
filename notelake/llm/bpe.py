"""Byte-level BPE encoding and decoding of whole texts.

A text is split by the pre-tokenizer pattern; each piece of the split is merged on its
own. The merge loop keeps a segment tree over the byte positions of the piece. The leaf of
a position holds the rank of the pair that starts there, an inner node the leftmost
smallest rank below it, so the next merge is read at the root and a merge updates the
leaves of the merged position, of the position it swallowed and of the live neighbour on
the left, each in logarithmic time. A piece of n bytes therefore costs O(n log n), also
when a text is one piece of a million bytes.

Work is per row and needs no shuffle. Encoded pieces are remembered per Python worker in a
table of bounded size. The rank file is a parameter and is read by each worker once; on a
cluster it has to be installed on, or shipped to, every executor.

Defined cases: a null text counts as empty; an empty text has no ids and decodes to no
bytes; special tokens are never produced; repeated rows give repeated results; columns of
the input other than the named one pass through, and an existing output column is replaced.
"""

from __future__ import annotations

import base64
import re
from array import array
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelake.llm.common import text_batches

#: Unicode White_Space, spelled out because Python's own class has four characters more.
_SPACE = r"\t-\r \x85\xa0  -     　"
#: Characters for which the ranges in _NARROW are exact: up to U+024F without superscripts and fractions.
_BEYOND_NARROW = re.compile("[^\x00-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]")
_CONTRACTION = "'(?:s|t|re|ve|m|ll|d)"


def _splitter(letter: str, digit: str) -> str:
    """The pre-tokenizer pattern with the branches that exclude each other put by frequency."""
    return (
        f" ?[{letter}]+| ?[{digit}]+|{_CONTRACTION}| ?[^{_SPACE}{letter}{digit}]+"
        f"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
    )


_NARROW = re.compile(_splitter(r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9"))
_WIDE = regex.compile(_splitter(r"\p{L}", r"\p{N}"))

#: Encoded pieces that one worker remembers, in two halves by age, and the length from which a piece is not remembered.
MAX_REMEMBERED, MAX_REMEMBERED_CHARS = 200_000, 32


def pieces(text: str) -> list[str]:
    """The matches of the pre-tokenizer pattern, which together are the whole text."""
    return (_WIDE if _BEYOND_NARROW.search(text) else _NARROW).findall(text)


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece: lowest rank first, leftmost first among equal ranks."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    bits = n.bit_length()
    none, low = 1 << 62, (1 << bits) - 1
    get = ranks.get
    # a node is rank << bits | position, so the smaller number is the lower rank, then the leftmost
    tree = [none] * (2 * n)
    for i in range(n - 1):
        if (rank := get(piece[i : i + 2])) is not None:
            tree[n + i] = rank << bits | i
    for i in range(n - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after = list(range(1, n + 1))  # start of the next live token
    before = list(range(-1, n - 1))
    while (least := tree[1]) < none:
        i = least & low
        j = after[i]
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            rank = get(piece[i : after[k]])
            tree[n + i] = none if rank is None else rank << bits | i
        else:
            tree[n + i] = none
        tree[n + j] = none
        if (h := before[i]) >= 0:
            rank = get(piece[h:k])
            tree[n + h] = none if rank is None else rank << bits | h
            climb = (n + h, n + i, n + j)
        else:
            climb = (n + i, n + j)
        for node in climb:
            node >>= 1
            while node:
                a = tree[2 * node]
                b = tree[2 * node + 1]
                if b < a:
                    a = b
                if tree[node] == a:
                    break
                tree[node] = a
                node >>= 1
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class _Encoder(dict):
    """Piece -> packed ids; what is missing is merged and remembered.

    When half of ``MAX_REMEMBERED`` is reached, what is remembered becomes the older half and a new one begins; what is asked for again
    comes over from the older half, so frequent pieces are not merged again.
    """

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.pop(piece, None)
        if ids is None:
            ids = array("I", merge(piece.encode("utf-8", "surrogatepass"), self.ranks)).tobytes()
        if len(piece) <= MAX_REMEMBERED_CHARS:
            if 2 * len(self) >= MAX_REMEMBERED:
                self.older = self.copy()
                self.clear()
            self[piece] = ids
        return ids

    def pack(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, pieces(text))) if text else b""


@lru_cache(maxsize=4)
def _encoder(path: str) -> _Encoder:
    return _Encoder(load_ranks(path))


@lru_cache(maxsize=4)
def _tokens(path: str) -> list[bytes | None]:
    ranks = load_ranks(path)
    table: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def encode(text: Column, ranks_path: str) -> Column:
    """Ids of a text as little-endian unsigned 32-bit integers in one binary value."""

    @F.pandas_udf(T.BinaryType())
    def bpe_encode(texts: pd.Series) -> pd.Series:
        pack = _encoder(ranks_path).pack
        return pd.Series([pack(t) for t in texts], dtype=object)

    # else the optimizer may run it once for each use of its result
    return bpe_encode.asNondeterministic()(text)


def decode(ids: Column, ranks_path: str) -> Column:
    """Bytes behind packed ids; an id that the rank file lacks is an error."""

    @F.pandas_udf(T.BinaryType())
    def bpe_decode(packed: pd.Series) -> pd.Series:
        token = _tokens(ranks_path).__getitem__
        return pd.Series([b"".join(map(token, memoryview(p).cast("I"))) if p else b"" for p in packed], dtype=object)

    return bpe_decode(ids)


def encode_texts(df: DataFrame, ranks_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with the packed ids of ``text_col`` in ``ids_col``."""
    text_batches(df.sparkSession)
    return df.withColumn(ids_col, encode(F.coalesce(df[text_col].cast("string"), F.lit("")), ranks_path))


def decode_ids(df: DataFrame, ranks_path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``df`` with the bytes behind ``ids_col`` in ``bytes_col``; null ids decode to no bytes."""
    return df.withColumn(bytes_col, decode(df[ids_col], ranks_path))
