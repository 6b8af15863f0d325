"""Text vectors and exact search (V1-V7).

A stated set of questions is multiplied, block by block, with all passage vectors where those are; a
task returns no more than the best ``depth`` passages a question. So the pairs of questions and passages
are never exchanged or stored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import md5
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import textcols as T
from .lexical import TERMS, counted, passage_terms, term_batches

DIM = 384
ROWS = 4096  # passages multiplied at a time
FLOOR = 1e-12
DIGITS = 9  # cosines are rounded before they are ranked; ties go to the passage that comes first


class Embedder(Protocol):
    """V1, V2: (id, text) to (id, slots, vals), unit vectors in sparse form."""

    def embed(self, texts: DataFrame) -> DataFrame: ...


def md5_slot(word: Column, dim: int = DIM) -> Column:
    return (F.conv(F.substring(F.md5(word.cast("binary")), 1, 8), 16, 10).cast("long") % dim).cast("int")


def crc_slot(word: Column, dim: int = DIM) -> Column:
    return (F.crc32(word.cast("binary")) % dim).cast("int")


#: The numbers that slot functions take of a word, where rows are worked off in Arrow batches.
NUMBERS = {md5_slot: lambda w: int.from_bytes(md5(w.encode()).digest()[:4]), crc_slot: lambda w: zlib.crc32(w.encode())}
KNOWN = 1 << 17  # words whose numbers a task remembers


def is_unit(vals: Column | str) -> Column:
    """V7: whether a vector, in sparse form, has length 1 or is zero."""
    norm = F.sqrt(F.aggregate(vals, F.lit(0.0), lambda a, x: a + x * x))
    return (F.abs(norm - 1) < 1e-3) | (norm == 0)


class HashedWords:
    """V3: content words counted in hashed slots, scaled to length 1, within each row."""

    def __init__(self, slot=md5_slot, dim: int = DIM) -> None:
        self.slot, self.dim = slot, dim

    def from_tokens(self, rows: DataFrame, tokens: str) -> DataFrame:
        """``rows`` with slots and vals of the words in the array column ``tokens``."""
        hashed = rows.withColumn("_h", F.transform(tokens, lambda w: self.slot(w, self.dim)))
        own = counted(hashed, "_h", "slots", "_n").withColumn("_n", F.transform("_n", lambda n: n.cast("double")))
        norm = F.greatest(F.sqrt(F.aggregate("_n", F.lit(0.0), lambda a, n: a + n * n)), F.lit(FLOOR))
        return own.withColumn("_l", norm).withColumn("vals", F.transform("_n", lambda n: n / F.col("_l"))).drop("_h", "_n", "_l")

    def passages(self, chunks: DataFrame) -> DataFrame:
        """``chunks(ord, text)`` to ord, len, words, tfs, slots, vals: terms and vectors of passages in one step."""
        number, dim = NUMBERS.get(self.slot), self.dim
        if number is None:
            tokens = F.flatten(F.transform(F.arrays_zip("words", "tfs"), lambda x: F.array_repeat(x["words"], x["tfs"].cast("int"))))
            return self.from_tokens(passage_terms(chunks).withColumn("_t", tokens), "_t").drop("_t")

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            slot = lru_cache(KNOWN)(lambda w: number(w) % dim)
            for b in term_batches(batches):
                words, tfs = b.column(2), b.column(3)
                owner = np.repeat(np.arange(b.num_rows), words.value_lengths().to_numpy())
                names = words.flatten().dictionary_encode()
                own = np.fromiter((slot(w) for w in names.dictionary.to_pylist()), np.int64, len(names.dictionary))
                cells, place = np.unique(owner * dim + own[names.indices.to_numpy()], return_inverse=True)
                n = np.bincount(place, tfs.flatten().to_numpy(), len(cells))
                row = cells // dim
                length = np.maximum(np.sqrt(np.bincount(row, n * n, b.num_rows)), FLOOR)
                ends = pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32))
                slots, vals = (pa.ListArray.from_arrays(ends, pa.array(x)) for x in ((cells % dim).astype(np.int32), n / length[row]))
                yield pa.RecordBatch.from_arrays([*b.columns, slots, vals], ["ord", "len", "words", "tfs", "slots", "vals"])

        return chunks.select("ord", "text").mapInArrow(run, f"{TERMS}, slots array<int>, vals array<double>")

    def embed(self, texts: DataFrame) -> DataFrame:
        words = texts.select("id", F.coalesce(T.tokenize("text"), F.array().cast("array<string>")).alias("_t"))
        return self.from_tokens(words, "_t").select("id", "slots", "vals")


class StoredVectors:
    """Vectors that come with their rows, in a column; scaled to length 1 as they are read."""

    def __init__(self, column: str = "embedding") -> None:
        self.column = column

    def embed(self, texts: DataFrame) -> DataFrame:
        v = F.transform(self.column, lambda x: x.cast("double"))
        norm = F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)), F.lit(FLOOR))
        rows = texts.select("id", v.alias("v"), norm.alias("norm"))
        return rows.select("id", F.sequence(F.lit(0), F.size("v") - 1).alias("slots"), F.transform("v", lambda x: x / F.col("norm")).alias("vals"))


class ModelVectors:
    """V1, V2: vectors of a model that is loaded once in each Python worker.

    ``load`` returns a function from a list of texts to a matrix; it is called in the workers only."""

    def __init__(self, load, dim: int = DIM, batch: int = 64) -> None:
        self.load, self.dim, self.batch = load, dim, batch

    def embed(self, texts: DataFrame) -> DataFrame:
        load, dim, size = self.load, self.dim, self.batch

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = load()
            for b in batches:
                for at in range(0, b.num_rows, size):
                    part = b.slice(at, size)
                    m = np.asarray(model([t or "" for t in part.column(1).to_pylist()]), np.float64)
                    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), FLOOR)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([list(range(dim))] * len(m), pa.list_(pa.int32())), pa.array(m.tolist(), pa.list_(pa.float64()))], ["id", "slots", "vals"])

        kind = dict(texts.dtypes)["id"]
        return texts.select("id", "text").mapInArrow(run, f"id {kind}, slots array<int>, vals array<double>")


def dense(slots: pa.Array, vals: pa.Array, dim: int) -> np.ndarray:
    """Sparse rows as a matrix."""
    out = np.zeros((len(slots), dim))
    owner = np.repeat(np.arange(len(slots)), slots.value_lengths().to_numpy())
    out[owner, slots.flatten().to_numpy()] = vals.flatten().to_numpy()
    return out


def question_blocks(vectors: DataFrame, dim: int, size: int = 1000) -> Iterator[tuple[list[int], np.ndarray]]:
    """The stated questions, (id, slots, vals), as matrices of at most ``size`` rows."""
    ids: list[int] = []
    rows: list[np.ndarray] = []
    for r in vectors.orderBy("id").toLocalIterator():
        v = np.zeros(dim)
        v[r.slots] = r.vals
        ids.append(r.id)
        rows.append(v)
        if len(ids) == size:
            yield ids, np.array(rows)
            ids, rows = [], []
    if ids:
        yield ids, np.array(rows)


def _blocks(batches: Iterable[pa.RecordBatch], dim: int, matrix: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ords, rounded cosines of passages by question), passages rising in each block."""
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            b = whole.slice(at, ROWS)
            ords = b.column(0).to_numpy()
            order = np.argsort(ords, kind="stable")
            scores = np.round(dense(b.column(1), b.column(2), dim) @ matrix.T, DIGITS)
            yield ords[order], scores[order] + 0.0


class Best:
    """The first ``depth`` passages of each of some rankings, by falling score and rising ord."""

    def __init__(self, n: int, depth: int) -> None:
        self.depth = depth
        self.held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * n

    def add(self, ords: np.ndarray, scores: np.ndarray, positive: bool = False) -> None:
        """Another block: rising ords, and a column of scores for each ranking."""
        for k, (o, s) in enumerate(self.held):
            col = scores[:, k]
            keep = col > 0 if positive else np.ones(len(col), bool)
            if len(o) == self.depth:
                keep &= col >= s[-1]
            if keep.any():
                o, s = np.concatenate([o, ords[keep]]), np.concatenate([s, col[keep]])
                first = np.lexsort((o, -s))[: self.depth]
                self.held[k] = o[first], s[first]


def search(vectors: DataFrame, qids: list[int], matrix: np.ndarray, depth: int) -> DataFrame:
    """V4: (qid, ord, cosine): for each task and question the first ``depth`` passages of
    ``vectors(ord, slots, vals)``."""
    dim = matrix.shape[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(qids), depth)
        for ords, scores in _blocks(batches, dim, matrix):
            best.add(ords, scores)
        for q, (o, s) in zip(qids, best.held, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([q] * len(o), pa.int64()), pa.array(o), pa.array(s)], ["qid", "ord", "cosine"])

    return vectors.select("ord", "slots", "vals").mapInArrow(run, "qid long, ord long, cosine double")


def dense_ranking(scored: DataFrame, depth: int) -> DataFrame:
    """(qid, ord, cosine, rank) from the best of all tasks."""
    w = Window.partitionBy("qid").orderBy(F.desc("cosine"), "ord")
    return scored.select("qid", "ord", "cosine", F.row_number().over(w).alias("rank")).where(F.col("rank") <= depth)
