"""Language identification with hyperdimensional profiles (operator 7).

Every letter of any script has a random vector of +1 and -1 of its own, made from its code point; breaks
between words have one as well. A run of three characters is bound into one vector: the product of the
first letter's vector rotated twice, the second's rotated once and the third's. A document bundles, i.e.
adds, the vectors of all its runs; a language's prototype adds those of its training documents, each
scaled to the same length in runs. The prediction is the prototype of the highest cosine. As bundling is
linear, runs are counted first and multiplied by their vectors once for each distinct run of a batch;
batches with very many distinct runs are halved, which bounds the memory and changes no sum.

Cases: a text that is null or has no letter is ``und`` with score 0. Rows without a language are not
learned from. Ties go to the language that sorts first. An empty training set predicts ``und`` for
all. Texts of any length count whole. Extra columns are ignored. Only ``text`` enters a prediction.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64

DIMENSIONS = 1024
SEED = 7
CHUNK_CHARS = 1 << 19
DISTINCT = 1 << 15  # runs bound at a time
CELLS = 1 << 22  # of a matrix of counts
BOUND = 1 << 12  # vectors of runs that are held at once
FEW = 2048  # runs that are not halved any more


def letter_vectors(letters: np.ndarray) -> np.ndarray:
    """The random vectors of code points; 0 stands for a break."""
    words = letters.astype(np.uint64)[:, None] * np.uint64(DIMENSIONS // 64) + np.arange(1, DIMENSIONS // 64 + 1, dtype=np.uint64)
    bits = np.unpackbits(mix64(words + np.uint64(SEED << 40)).astype("<u8").view(np.uint8), axis=1)
    return (bits * 2).astype(np.int8) - np.int8(1)


@lru_cache(1)
def letter_table() -> np.ndarray:
    """Whether a code point of the first plane is a letter."""
    return np.array([chr(cp).isalpha() for cp in range(1 << 16)])


def letters_of(text: str | None) -> np.ndarray:
    """The lower-case letters of a text as code points. White space and signs in a row count as one break, 0,
    also at both ends; without letters the result is empty."""
    cps = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    known = letter_table()[np.minimum(cps, 0xFFFF)]
    if (far := cps > 0xFFFF).any():
        distinct, place = np.unique(cps[far], return_inverse=True)
        known[far] = np.array([chr(cp).isalpha() for cp in distinct.tolist()])[place]
    if not known.any():
        return np.zeros(0, np.uint32)
    keep = known.copy()
    keep[1:] |= known[:-1]
    own = np.where(known, cps, 0)[keep]
    return np.concatenate([[0], own, [0] if own[-1] else []]).astype(np.uint32)


def groups(texts: list[str | None]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Row numbers and letters, in groups of a bounded number of characters (a long text alone)."""
    rows, letters, held = [], [], 0
    for i, t in enumerate(texts):
        rows.append(i)
        letters.append(letters_of(t))
        held += len(letters[-1])
        if held >= CHUNK_CHARS:
            yield rows, letters
            rows, letters, held = [], [], 0
    if rows:
        yield rows, letters


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and the place of each value among them."""
    if values.max() >= 1 << 22:
        return np.unique(values, return_inverse=True)
    present = np.flatnonzero(np.bincount(values))
    number = np.zeros(present[-1] + 1, np.int64)
    number[present] = np.arange(len(present))
    return present, number[values]


def _add_runs(out: np.ndarray, runs: np.ndarray, owner: np.ndarray, vectors: np.ndarray) -> None:
    """Adds to ``out`` the vectors of runs, numbers in base ``len(vectors)``, at the rows that own them."""
    present, number = _numbered(runs)
    first, n = owner[0], owner[-1] - owner[0] + 1
    if len(runs) > FEW and (len(present) > DISTINCT or n * len(present) > CELLS):
        half = len(runs) // 2
        _add_runs(out, runs[:half], owner[:half], vectors)
        _add_runs(out, runs[half:], owner[half:], vectors)
        return
    counts = np.bincount((owner - first) * len(present) + number, minlength=n * len(present)).reshape(n, len(present))
    base = len(vectors)
    for at in range(0, len(present), BOUND):
        own = present[at : at + BOUND]
        bound = np.roll(vectors[own // base**2], 2, axis=1)
        bound *= np.roll(vectors[own // base % base], 1, axis=1)
        bound *= vectors[own % base]
        out[first : first + n] += counts[:, at : at + BOUND].astype(np.float32) @ bound.astype(np.float32)


def bundles(texts: list[np.ndarray]) -> np.ndarray:
    """One bundled vector for each text of a group, given by its letters."""
    out = np.zeros((len(texts), DIMENSIONS))
    sizes = np.array([len(t) for t in texts], np.int64)
    if not sizes.any():
        return out
    alphabet, local = _numbered(np.concatenate(texts).astype(np.int64))
    starts = np.ones(len(local), bool)  # a run starts anywhere but at the last two of a text
    ends = np.cumsum(sizes)[sizes > 0]
    starts[ends - 1] = starts[ends - 2] = False
    at = np.flatnonzero(starts)
    runs = (local[at] * len(alphabet) + local[at + 1]) * len(alphabet) + local[at + 2]
    _add_runs(out, runs, np.repeat(np.arange(len(texts)), np.maximum(sizes - 2, 0)), letter_vectors(alphabet))
    return out


def train(docs: DataFrame) -> dict[str, np.ndarray]:
    """Unit prototypes by language from ``docs(text, lang)``; all rows count.

    Each partition adds up its documents; the sums, ``DIMENSIONS`` numbers a language, are added in a
    second stage, so what comes to the driver depends on the number of languages alone.
    """

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b.column(1).to_pylist()
            for rows, letters in groups(b.column(0).to_pylist()):
                v = bundles(letters) / np.maximum([[len(t) - 2] for t in letters], 1)
                for lang in {langs[i] for i in rows}:
                    own = [k for k, i in enumerate(rows) if langs[i] == lang]
                    total[lang] = total.get(lang, 0) + v[own].sum(axis=0)
        for lang, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMENSIONS), pa.array(np.arange(DIMENSIONS, dtype=np.int32)), pa.array(v)], ["lang", "d", "x"])

    known = docs.where("lang is not null and text is not null").select("text", "lang")
    parts = known.mapInArrow(sums, "lang string, d int, x double")
    whole = parts.groupBy("lang", "d").agg(F.sum(F.round("x", 9).cast("decimal(38,9)")).cast("double").alias("x"))  # exact in any order
    model: dict[str, np.ndarray] = {}
    for r in whole.collect():
        model.setdefault(r.lang, np.zeros(DIMENSIONS))[r.d] = r.x
    return {k: v / n for k, v in sorted(model.items()) if (n := np.linalg.norm(v)) > 0}


def predict(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """``docs`` with lang_pred and score (the cosine, cut to 0..1); all of its columns stay."""
    cols = [c for c in docs.columns if c not in ("lang_pred", "score")]
    held = "_" + max(docs.columns, key=len)  # the text once more, under a name no column has
    names = list(model)
    prototypes = np.array([model[n] for n in names]).reshape(len(names), DIMENSIONS)

    def label(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.names.index(held)).to_pylist()
            pred, score = ["und"] * len(texts), np.zeros(len(texts))
            for rows, letters in groups(texts) if names else ():
                v = bundles(letters)
                norm = np.linalg.norm(v, axis=1)
                cos = v @ prototypes.T / np.maximum(norm, 1e-12)[:, None]
                best = cos.argmax(axis=1)
                for k, i in enumerate(rows):
                    if len(letters[k]) and norm[k] > 0:
                        pred[i], score[i] = names[best[k]], min(1.0, max(0.0, float(cos[k, best[k]])))
            keep = [c for c, n in zip(b.columns, b.schema.names, strict=True) if n != held]
            kept = [n for n in b.schema.names if n != held]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(pred), pa.array(score)], [*kept, "lang_pred", "score"])

    out = docs.select(*cols).schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*cols, F.col("text").alias(held)).mapInArrow(label, out)


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def held_out(column: str = "doc_id"):
    """crc32 of the id as text, modulo 5, is 0; false for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))
