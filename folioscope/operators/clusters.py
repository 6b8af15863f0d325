"""Exact vector search that skips clusters of passages (V4).

Unit vectors are assigned to the nearest of some centres; a cluster knows the widest angle between its centre and any
of its vectors. By the triangle inequality for angles, no vector of a cluster can be nearer to a question than the
angle to the centre less that width. A block of questions is searched in two scans: the first reads, for each
question, the clusters nearest to it until they hold ``depth`` vectors; the depth-th best cosine found tells which
others can hold a better one, and the second scan reads these. Clusters that no question of the block needs are
filtered in the scan itself, whose files are sorted by cluster.

Centres are a bounded sample (``CENTRES`` vectors); which ones are drawn changes what is skipped, not what is found.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import Tables
from .vectors import DIGITS, Best, dense

CENTRES = 256
PER_CENTRE = 128  # vectors that a cluster aims at
SLACK = 1e-7  # radians, for rounding
ROWS = 4096
COLUMNS = "cluster int, ord long, slots array<int>, vals array<double>, turn double"


@dataclass
class Clustered:
    """``rows`` (COLUMNS), written; the centres, and for each its vectors and the widest angle to any."""

    rows: DataFrame
    centres: np.ndarray
    sizes: np.ndarray
    widths: np.ndarray


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def build(vectors: DataFrame, dim: int, tables: Tables, name: str = "clustered") -> Clustered:
    """Clusters of ``vectors(ord, slots, vals)``, unit vectors or zero in sparse form. Zero vectors (cosine 0 with all)
    count as at a right angle to every centre."""
    n = vectors.count()
    size = max(1, min(CENTRES, n // PER_CENTRE))
    drawn = vectors.where(F.size("vals") > 0).orderBy(F.xxhash64("ord"), "ord").limit(size).select("slots", "vals").collect()  # at most CENTRES
    centres = np.zeros((max(1, len(drawn)), dim))
    for k, r in enumerate(drawn):
        centres[k, r.slots] = r.vals

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                turn = _angles(dense(b.column(1), b.column(2), dim), centres)
                own = turn.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *b.columns, pa.array(turn[np.arange(len(own)), own])], ["cluster", "ord", "slots", "vals", "turn"])

    rows = vectors.select("ord", "slots", "vals").mapInArrow(run, COLUMNS)
    rows = tables.keep(rows.repartitionByRange("cluster", "ord").sortWithinPartitions("cluster", "ord"), name)
    sizes, widths = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    for r in rows.groupBy("cluster").agg(F.count("*").alias("n"), F.max("turn").alias("turn")).collect():  # a row for each centre
        sizes[r.cluster], widths[r.cluster] = r.n, r.turn
    return Clustered(rows, centres, sizes, widths)


def bounds(clustered: Clustered, matrix: np.ndarray) -> np.ndarray:
    """The greatest cosine (question, cluster) that any vector of a cluster can have; below -1 where it has none."""
    nearest = np.maximum(_angles(matrix, clustered.centres) - clustered.widths[None, :] - SLACK, 0.0)
    return np.where(clustered.sizes[None, :] > 0, np.cos(nearest), -2.0)


def _scan(clustered: Clustered, qids: list[int], matrix: np.ndarray, wanted: np.ndarray, depth: int) -> DataFrame:
    """(qid, ord, cosine): each task's first ``depth`` vectors of the ``wanted`` (question, cluster)."""
    dim = matrix.shape[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {k: Best(1, depth) for k in np.flatnonzero(wanted.any(axis=1)).tolist()}
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                cluster, ords = b.column(0).to_numpy(), b.column(1).to_numpy()
                x = dense(b.column(2), b.column(3), dim)
                for c in np.unique(cluster):
                    asking = np.flatnonzero(wanted[:, c])
                    here = np.flatnonzero(cluster == c)
                    here = here[np.argsort(ords[here], kind="stable")]
                    scores = np.round(x[here] @ matrix[asking].T, DIGITS) + 0.0
                    for j, k in enumerate(asking.tolist()):
                        best[k].add(ords[here], scores[:, [j]])
        for k, found in best.items():
            o, s = found.held[0]
            if len(o):
                yield pa.RecordBatch.from_arrays([pa.array([qids[k]] * len(o), pa.int64()), pa.array(o), pa.array(s)], ["qid", "ord", "cosine"])

    some = [int(c) for c in np.flatnonzero(wanted.any(axis=0))]
    return clustered.rows.where(F.col("cluster").isin(some)).select("cluster", "ord", "slots", "vals").mapInArrow(run, "qid long, ord long, cosine double")


def search(clustered: Clustered, qids: list[int], matrix: np.ndarray, depth: int, tables: Tables, name: str = "search") -> tuple[DataFrame, np.ndarray]:
    """(qid, ord, cosine) with the first ``depth`` vectors of every question among them, for ``vectors.dense_ranking``;
    and which clusters (question, cluster) were read. The driver holds a number for each question and cluster."""
    most = bounds(clustered, matrix)
    order = np.argsort(-most, axis=1, kind="stable")
    held = np.cumsum(clustered.sizes[order], axis=1)
    first = np.zeros(most.shape, bool)
    np.put_along_axis(first, order, (held - clustered.sizes[order] < depth) & (clustered.sizes[order] > 0), axis=1)
    found = tables.keep(_scan(clustered, qids, matrix, first, depth), f"{name}-first")
    least = np.full(len(qids), -2.0)
    place = {q: k for k, q in enumerate(qids)}
    best = found.groupBy("qid").agg(F.array_sort(F.collect_list("cosine")).alias("s"))  # at most ``depth`` for each task and question
    for r in best.where(F.size("s") >= depth).select("qid", F.element_at("s", -depth).alias("least")).collect():  # a row for each question
        least[place[r.qid]] = r.least
    rest = (most >= least[:, None]) & ~first & (clustered.sizes[None, :] > 0)
    more = tables.keep(_scan(clustered, qids, matrix, rest, depth), f"{name}-rest")
    return found.unionByName(more), first | rest
