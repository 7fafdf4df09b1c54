"""Token counts by the whole-token shortcut, for SentencePiece BPE models with byte fallback.

The model turns spaces into a marker and merges characters. Which strings of its vocabulary come out as one token when
they are encoded alone is proved once, before the job, by encoding each of them; texts are then cut where no merge can
cross, pre-tokens among the proven strings count 1, and only the rest is merged, each distinct string once.

A cut is safe where no vocabulary string spans it. Before a run of markers it is if no string has a marker behind another
character, around a line feed if no string holds one; ``prove`` checks both against the vocabulary and names no cuts
otherwise. Merges are chosen by score and a merge in one pre-token never changes another's characters, so the
counts add up to the whole text's.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm.common import text_blocks

#: Fixed value: the character that stands for a space in SentencePiece vocabularies.
MARK = "▁"
MEMO_ENTRIES, MEMO_CHARS = 300_000, 64


#: No merge crosses it where no vocabulary string holds it: before a pre-token it keeps off the marker that some models
#: put at a text's start.
GUARD = "\n"


@lru_cache(maxsize=2)
def load(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


@dataclass(frozen=True)
class Proof:
    """What is known of a vocabulary: whether texts may be cut, the strings that are one token alone, the tokens of the
    guard at a text's start and of a further one, and whether a marker is put before a text."""

    cuts: bool
    singles: frozenset[str] = frozenset()
    guard: int = 0
    line_feed: int = 0
    prefix: bool = False


def prove(path: str) -> Proof:
    model = load(path)
    kinds = (model.is_control, model.is_unknown, model.is_unused, model.is_byte)
    plain = [i for i in range(model.vocab_size()) if not any(kind(i) for kind in kinds)]
    pieces = [model.id_to_piece(i) for i in plain]
    # Spaces must survive one by one, and nothing else may be rewritten, or cuts of the raw text mean nothing.
    kept = model.normalize("b a  b ").removeprefix(MARK) == "b▁a▁▁b▁" and model.normalize("ﬁ\nＡ\u0301").removeprefix(MARK) == "ﬁ\nＡ\u0301"
    if not kept or any(GUARD in p or MARK in p.lstrip(MARK) for p in pieces):
        return Proof(False)
    guard = len(model.encode(GUARD))
    alone = model.encode([GUARD + p for p in pieces], num_threads=1)
    singles = frozenset(p for p, i, ids in zip(pieces, plain, alone) if ids[guard:] == [i])
    return Proof(True, singles, guard, len(model.encode(GUARD + GUARD)) - guard, model.normalize("a") != "a")


class PieceCounts(dict):
    """Tokens by pre-token. The proven ones are there from the start; others are merged when first seen."""

    def __init__(self, model: sentencepiece.SentencePieceProcessor, proof: Proof, lead: str):
        self._model, self._guard, self._lead = model, proof.guard, lead
        self._start = {p.removeprefix(lead): 1 for p in proof.singles if p.startswith(lead) and p != lead}
        self.update(self._start)

    def __missing__(self, piece: str) -> int:
        n = len(self._model.encode(GUARD + self._lead + piece, num_threads=1)) - self._guard
        if len(piece) <= MEMO_CHARS:
            if len(self) >= len(self._start) + MEMO_ENTRIES:
                self.clear()
                self.update(self._start)
            self[piece] = n
        return n


class Counter:
    def __init__(self, path: str, proof: Proof):
        self._model, self._proof = load(path), proof
        self._bare = PieceCounts(self._model, proof, "")
        self._marked = PieceCounts(self._model, proof, MARK)
        self._runs = regex.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall

    def _line(self, line: str) -> int:
        """Tokens of a line in which spaces stand for markers."""
        first, *others = line.split(" ")
        if "" in others:  # several markers in a row, or one at the end
            return sum(map(self._bare.__getitem__, self._runs(line.replace(" ", MARK))))
        return (self._bare[first] if first else 0) + sum(map(self._marked.__getitem__, others))

    def count(self, text: str) -> int:
        if not text or not self._proof.cuts:
            return len(self._model.encode(text, num_threads=1))
        text = text.replace(MARK, " ")
        lines = (" " * self._proof.prefix + text).split("\n")
        return sum(map(self._line, lines)) + (len(lines) - 1) * self._proof.line_feed


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens (longs) of every row's whole text; both 0 for a null or empty one. ``path`` is the
    model's place on every machine. Repeated rows and null ids are kept; other columns are not read."""
    spark = docs.sparkSession
    proof = spark.sparkContext.broadcast(prove(path))  # as large as the vocabulary, whatever the texts are

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, proof.value)
        for rows in text_blocks(batches, 4 << 20):
            sizes = pa.compute.binary_length(rows.column(1)).fill_null(0).cast(pa.int64())
            counts = np.fromiter((counter.count(t) if t else 0 for t in rows.column(1).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([rows.column(0), sizes, pa.array(counts)], ["doc_id", "n_bytes", "n_tokens"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
