"""Language identification by multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; every run of other characters than letters counts as one space, and one stands before and after
the text. The n-grams of 1 to 3 characters are hashed into ``BUCKETS`` buckets. Training sums the counts of each
language and bucket over all training rows, in two aggregates that Spark distributes; the model is the matrix of their
smoothed logarithms, of at most BUCKETS x ``MAX_LANGUAGES`` numbers whatever the corpus holds, and is broadcast. A batch
of texts is scored in numpy: the rows of the matrix at its n-grams' buckets, summed by text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.llm.common import kept_rows, text_blocks
from fieldspark.llm.letters import letters

UNKNOWN = "und"
BUCKETS = 1 << 16
MAX_LANGUAGES = 512
ORDERS = (1, 2, 3)
#: Odd multipliers that mix the characters of an n-gram.
MIXERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
#: Characters scored at once, and bytes of a slice of rows.
PIECE, SLICE = 1 << 18, 2 << 20


def _buckets(codes: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each character."""
    n = len(codes) - order + 1
    if n <= 0:
        return np.empty(0, np.uint32)
    hashed = codes[:n] * np.uint32(MIXERS[0])
    for k in range(1, order):
        hashed = (hashed ^ (hashed >> np.uint32(15))) * np.uint32(MIXERS[k]) + codes[k : n + k]
    hashed = (hashed ^ (hashed >> np.uint32(13))) * np.uint32(MIXERS[order - 1])
    return hashed >> np.uint32(32 - BUCKETS.bit_length() + 1)


def _inside(codes: np.ndarray, order: int) -> np.ndarray:
    """Whether the n-gram that starts at each character lies in one text of several that were joined: only where one
    ends and the next begins, two spaces meet."""
    space = codes == 32
    across = space[:-1] & space[1:]
    n = len(codes) - order + 1
    inside = np.ones(max(n, 0), bool)
    for k in range(order - 1):
        inside &= ~across[k : n + k]
    return inside


def _pieces(codes: np.ndarray) -> Iterator[np.ndarray]:
    """Each n-gram of the texts once, as buckets, in pieces of bounded size."""
    for at in range(0, len(codes), PIECE):
        for order in ORDERS:
            piece = codes[at : at + PIECE + order - 1]
            yield _buckets(piece, order)[_inside(piece, order)]


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    log_prior: np.ndarray
    log_probability: np.ndarray  # buckets x languages

    def scores(self, codes: np.ndarray) -> np.ndarray:
        return self.log_prior + sum(self.log_probability[b].sum(0, dtype=np.float64) for b in _pieces(codes))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The most probable language, the first by name of equal ones, and its posterior probability."""
        codes = letters(text) if text else np.empty(0, np.uint32)
        if not self.languages or not (codes != 32).any():
            return UNKNOWN, 0.0
        scores = self.scores(codes)
        best = int(scores.argmax())
        return self.languages[best], float(1.0 / np.exp(scores - scores[best]).sum())

    def predict_texts(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """As predict for each text; short ones are scored together, as many as keeps the scores' array small."""
        most = (32 << 20) // max(1, len(self.languages))
        names, scores, begin, size = [], [], 0, 0
        for end in range(1, len(texts) + 1):
            size += len(texts[end - 1] or "")
            if end == len(texts) or size + len(texts[end] or "") > most:
                part = texts[begin:end]
                some_names, some_scores = self.predict_batch(part) if size <= most else map(list, zip(*map(self.predict, part)))
                names += some_names
                scores += some_scores
                begin, size = end, 0
        return names, scores

    def predict_batch(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """As predict, for short texts together."""
        codes = [letters(t or "") for t in texts]
        lengths = np.array([len(c) for c in codes])
        known = np.array([bool((c != 32).any()) for c in codes], bool) & bool(self.languages)
        if not known.any():
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        total = np.tile(self.log_prior, (len(texts), 1))
        flat, ends = np.concatenate(codes), np.cumsum(lengths)
        starts = ends - lengths
        for order in ORDERS:
            hashed = _buckets(flat, order)
            each = self.log_probability[hashed]
            each[~_inside(flat, order)] = 0.0
            some = starts < len(hashed)
            if some.any():
                total[some] += np.add.reduceat(each, starts[some], axis=0, dtype=np.float64)
        best = total.argmax(1)
        posterior = 1.0 / np.exp(total - total.max(1)[:, None]).sum(1)
        names = [self.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
        return names, [float(p) if k else 0.0 for p, k in zip(posterior, known)]


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True where crc32 of the id's decimal digits is divisible by ``folds``; null ids are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", smoothing: float = 0.5) -> LanguageModel:
    """Learns from all rows with a text and a language. The counts that reach the driver are one number for each
    language and bucket that occurs. More than MAX_LANGUAGES languages are an error, no rows give a model that answers
    ``und``."""
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        texts: dict[str, int] = {}
        for batch in text_blocks((b.select(["text", "lang"]) for b in batches), SLICE):
            mine: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                mine.setdefault(lang, []).append(letters(text.as_py()))
            for lang, codes in mine.items():
                own = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
                texts[lang] = texts.get(lang, 0) + len(codes)
                if len(totals) > MAX_LANGUAGES:
                    raise ValueError(f"more than {MAX_LANGUAGES} languages")
                for buckets in _pieces(np.concatenate(codes)):
                    own += np.bincount(buckets, minlength=BUCKETS)
        for lang, own in totals.items():
            there = np.flatnonzero(own)
            buckets = np.concatenate([[-1], there]).astype(np.int32)  # -1: the texts
            counts = np.concatenate([[texts[lang]], own[there]])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(buckets)), pa.array(buckets), pa.array(counts)], ["lang", "bucket", "n"])

    counted = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counted.toArrow()
    names = sorted(set(found["lang"].to_pylist()))
    if not names:
        return LanguageModel((), np.empty(0), np.empty((BUCKETS, 0), np.float32))
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    matrix, priors = np.zeros((BUCKETS, len(names))), np.zeros(len(names))
    lang = np.array([names.index(x) for x in found["lang"].to_pylist()])
    bucket, n = found["bucket"].to_numpy(), found["n"].to_numpy()
    priors[lang[bucket < 0]] = n[bucket < 0]
    matrix[bucket[bucket >= 0], lang[bucket >= 0]] = n[bucket >= 0]
    probability = np.log((matrix + smoothing) / (matrix + smoothing).sum(0))
    return LanguageModel(tuple(names), np.log(priors / priors.sum()), probability.astype(np.float32))


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row's whole text: the most probable language and its posterior probability;
    ``und`` and 0 for a null text or one without a letter. Repeated rows and null ids are kept; only the two columns
    are read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for rows in text_blocks(batches, SLICE):
            names, scores = own.predict_texts(rows.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_col: str = "lang", certainty: float = 0.999) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is in the language they state. Rejected: texts without a letter, and
    those that the model is certain are in another of its languages than the one stated. A null language or one that
    the model has not learned is no reason to reject."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(rows: pa.RecordBatch) -> list[bool]:
        own = shared.value
        names, scores = own.predict_texts(rows.column(rows.schema.get_field_index(text_col)).to_pylist())
        stated = rows.column(rows.schema.get_field_index(lang_col)).to_pylist()
        return [n != UNKNOWN and (s not in own.languages or n == s or p < certainty) for n, p, s in zip(names, scores, stated)]

    return kept_rows(docs, text_col, keep)
