"""Byte-level BPE encoding and decoding in linear time.

A text is cut by a pattern; each piece is encoded on its own. Bytes are mapped to the 256 characters of Latin-1, so that
the trie of a pyahocorasick automaton over the vocabulary finds the longest token that starts at a byte. The encoding is then walked from left to right: take the longest token; if it cannot stand beside the token before
it, try the next shorter token that is a prefix; if none is left, the position is a dead end, go back one token. Two tokens
can stand side by side exactly if merging their joined bytes gives these two again, which is memoised. A sequence whose
neighbours all fit is the one that the merges make, and each position is left as a dead end at most once.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm.common import text_blocks

#: Entries after which a memo starts afresh, and the longest piece that it holds.
MEMO_ENTRIES, MEMO_CHARS = 300_000, 64


def merged(data: bytes, ranks: dict[bytes, int], least: int = 1) -> list[int]:
    """The ids that merging neighbours of the lowest rank, leftmost first, leaves, or the last ``least`` on the way. For
    short strings."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > least:
        best, at = min((ranks.get(a + b, len(ranks)), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if best == len(ranks):
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class PieceMemo(dict):
    """Ids by piece."""

    def __init__(self, encode):
        self._encode = encode

    def __missing__(self, piece: str) -> list[int]:
        ids = self._encode(piece.encode())
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[piece] = ids
        return ids


class ByteBpe:
    """Encoder and decoder for a vocabulary of ranks that holds every single byte."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary must hold all 256 bytes")
        self.ranks = ranks
        self.bytes_of = {i: token for token, i in ranks.items()}
        self._findall = regex.compile(pattern).findall
        trie = ahocorasick.Automaton()
        for token, i in ranks.items():
            trie.add_word(token.decode("latin-1"), i)
        self._reach = trie.longest_prefix
        self._most = max(map(len, ranks))
        self._shorter: dict[int, int | None] = {}
        self._beside: dict[tuple[int, int], bool] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._memo = PieceMemo(self.encode_piece)

    def _next_shorter(self, token: int) -> int | None:
        """The longest other token that the token begins with."""
        if token not in self._shorter:
            data = self.bytes_of[token]
            self._shorter[token] = next((self.ranks[data[:n]] for n in range(len(data) - 1, 0, -1) if data[:n] in self.ranks), None)
        return self._shorter[token]

    def _last_merge(self, token: int) -> tuple[int, int] | None:
        """The two tokens that are merged last when the token's bytes are merged; None for a single byte."""
        if token not in self._halves:
            data = self.bytes_of[token]
            self._halves[token] = None if len(data) == 1 else tuple(merged(data, self.ranks, 2))
        return self._halves[token]

    def _fit(self, left: int, right: int) -> bool:
        known = self._beside.get((left, right))
        if known is None:
            if len(self._beside) >= MEMO_ENTRIES:
                self._beside.clear()
            known = self._beside[left, right] = self._stays(left, right)
        return known

    def _stays(self, left: int, right: int) -> bool:
        """Undoes the merges of both sides at their seam, the latest first. What meets there at any time must not merge
        before the merge that was undone last: at an equal rank the one further left goes first."""
        if any(len(self._last_merge(t) or ()) > 2 for t in (left, right)):
            return False  # merging never makes this token
        before = len(self.ranks) + 1
        while True:
            across = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if across is not None and across < before:
                return False
            l_halves, r_halves = self._last_merge(left), self._last_merge(right)
            if l_halves is None and r_halves is None:
                return True
            if r_halves is None or l_halves is not None and left > right:
                before, left = left, l_halves[1]
            else:
                before, right = right + 1, r_halves[0]

    def _longest(self, piece: bytes, latin: str, at: int) -> int:
        """The longest token at a byte: the trie says how far any token goes on from there."""
        end = at + self._reach(latin[at : at + self._most])
        ranks = self.ranks
        while (token := ranks.get(piece[at:end])) is None:
            end -= 1
        return token

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        latin, size, bytes_of = piece.decode("latin-1"), len(piece), self.bytes_of
        closed: set[int] = set()
        ids: list[int] = []
        at, token = 0, self._longest(piece, latin, 0) if piece else None
        while at < size:
            while token is not None:
                end = at + len(bytes_of[token])
                if end not in closed and (not ids or self._fit(ids[-1], token)):
                    break
                token = self._next_shorter(token)
            if token is not None:
                ids.append(token)
                at = end
                if at < size:
                    token = self._longest(piece, latin, at)
            else:
                closed.add(at)
                token = ids.pop()
                at -= len(bytes_of[token])
        return ids

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self._memo.__getitem__, self._findall(text))))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    @cached_property
    def tokens(self) -> pa.Array:
        """The bytes of every id from 0 on, null where the vocabulary has none."""
        return pa.array(map(self.bytes_of.get, range(max(self.bytes_of) + 1)), pa.binary())

    def decode_lists(self, lists: pa.ListArray) -> pa.Array:
        """The bytes of each list of ids, none for a null list."""
        ids = lists.flatten()
        if len(ids) and not 0 <= pa.compute.min(ids).as_py() <= pa.compute.max(ids).as_py() < len(self.tokens):
            raise KeyError("an id is outside the vocabulary")
        parts = self.tokens.take(ids)
        if parts.null_count:
            raise KeyError("an id is outside the vocabulary")
        offsets = np.cumsum(np.concatenate([[0], pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)])).astype(np.int32)
        return pa.compute.binary_join(pa.ListArray.from_arrays(offsets, parts), b"")


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBpe:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return ByteBpe(ranks, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int): the tokens of every row's whole text, none for a null or empty one. ``path`` is the
    rank file's place on every machine. Repeated rows and null ids are kept; other columns are not read."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for rows in text_blocks(batches, 4 << 20):
            encoded = [np.array(bpe.encode(t), np.int32) if t else np.empty(0, np.int32) for t in rows.column(1).to_pylist()]
            offsets = np.cumsum([0, *map(len, encoded)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(offsets, np.concatenate(encoded))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """The columns doc_id and ids of ``encoded``, and decoded (binary): the bytes that the ids stand for. Null ids give
    no bytes; an id outside the vocabulary is an error."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), bpe.decode_lists(rows.column(1))], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")
