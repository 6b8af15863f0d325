"""Near-duplicate vectors by PCA-ordered tiled comparison (operator 3).

Vectors are compared if their labels are equal. Equal vectors form one class first. The principal axes
come from the second moments of all unit vectors. Classes are sorted by label and by cells of the leading
``AXES`` coordinates and cut into tiles, and tiles in blocks of bounded size. A block carries the box of its leading
coordinates; two blocks meet if they share a cell or have neighbouring ones, and boxes near enough for any link.
Of two blocks those tiles are compared whose own boxes, over the first step's axes, are near enough. Inside a pair
of tiles, leading dimensions are multiplied first, and the product of
the norms of what is left bounds the rest: rows and columns whose bound stays below the threshold
drop out, and the comparison stops when none is left. Those that remain get their full cosine from the
original vectors in double precision, which alone decides.

A pair of blocks gives, for each vector, its number of links, and the edges of a spanning forest of its
links; so no task emits all pairs of a group, and the forests have the components of all links. A block is sent once
for each block it meets.

Cases: vectors that are null, empty, zero or hold null or non-finite components, and those with a null
label, link with nothing. Vectors of different length are not compared. Repeated vectors are linked to
each other (cosine 1). A vector without an id links with nothing and is kept; vectors that share an id are one
node. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, connected_components

TILE = 1024
BLOCK = 4 * TILE
AXES = 3  # leading coordinates with cells
STEPS = (8, 8, 16)  # dimensions added before each look at the bound; the rest follow at once
SLACK = 1e-9


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that no finite vector's squares overflow or vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def axes(reps: DataFrame) -> dict[int, np.ndarray]:
    """Principal axes for each vector length, columns by falling weight, over all of ``reps``.

    Each task adds up its second moments; what reaches the driver is a square of the vector length."""

    def moments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            sizes = b.column(0).value_lengths().to_numpy()
            for d in np.unique(sizes):
                u = _unit(_matrix(b.column(0).filter(pa.array(sizes == d))))
                total[int(d)] = total.get(int(d), 0) + u.T @ u
        for d, m in total.items():
            n = d * d
            yield pa.RecordBatch.from_arrays([pa.array([d] * n, pa.int32()), pa.array(np.arange(n, dtype=np.int32)), pa.array(m.ravel())], ["d", "cell", "x"])

    rows = reps.select("vec").mapInArrow(moments, "d int, cell int, x double").groupBy("d", "cell").agg(F.sum("x").alias("x")).collect()
    found: dict[int, np.ndarray] = {}
    for r in rows:
        found.setdefault(r.d, np.zeros(r.d * r.d))[r.cell] = r.x
    return {d: np.linalg.eigh(m.reshape(d, d))[1][:, ::-1].copy() for d, m in found.items()}


def links_mask(ux: np.ndarray, uy: np.ndarray, px: np.ndarray, py: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of ``ux`` and ``uy`` (unit vectors; ``px`` and ``py``: along the axes) have a cosine of at
    least ``threshold``."""
    out = np.zeros((len(ux), len(uy)), bool)
    rows, cols = np.arange(len(ux)), np.arange(len(uy))
    done, d = 0, px.shape[1]
    acc = np.zeros((len(ux), len(uy)))
    for step in STEPS:
        end = min(done + step, d)
        acc += px[rows, done:end] @ py[cols, done:end].T
        done = end
        rx = np.sqrt((px[rows, done:] ** 2).sum(axis=1))
        ry = np.sqrt((py[cols, done:] ** 2).sum(axis=1))
        open_ = acc + rx[:, None] * ry[None, :] >= threshold - SLACK
        keep_r, keep_c = open_.any(axis=1), open_.any(axis=0)
        if not keep_r.any():
            return out
        rows, cols = rows[keep_r], cols[keep_c]
        acc = acc[np.ix_(keep_r, keep_c)]
        if done == d:
            break
    out[np.ix_(rows, cols)] = ux[rows] @ uy[cols].T >= threshold
    return out


def block_links(x: np.ndarray, y: np.ndarray, same: bool, basis: np.ndarray, threshold: float) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row of ``x``, first row of ``y``, mask of links) for the pairs of tiles of two blocks that have links."""
    ux, uy = _unit(x), _unit(y)
    px, py = ux @ basis, uy @ basis
    reach = 2 - 2 * threshold + SLACK  # the square of the greatest distance of linked unit vectors
    tiles = [[(k, p[k : k + TILE, : STEPS[0]]) for k in range(0, len(p), TILE)] for p in (px, py)]
    boxes = [[(k, p.min(axis=0), p.max(axis=0)) for k, p in own] for own in tiles]
    for i, lo, hi in boxes[0]:
        for j, low, high in boxes[1]:
            if same and j < i:
                continue
            apart = np.maximum(np.maximum(lo - high, low - hi), 0)
            if (apart * apart).sum() > reach:
                continue
            a, b = slice(i, i + TILE), slice(j, j + TILE)
            mask = links_mask(ux[a], uy[b], px[a], py[b], threshold)
            if same and i == j:
                np.fill_diagonal(mask, False)
            if mask.any():
                yield i, j, mask


def forest(mask: np.ndarray) -> list[tuple[int, int]]:
    """Edges (row, column) of a spanning forest of the links in ``mask``."""
    edges: list[tuple[int, int]] = []
    row_new, col_new = mask.any(axis=1), mask.any(axis=0)
    for start in np.flatnonzero(row_new):
        if not row_new[start]:
            continue
        row_new[start] = False
        front = np.array([start])
        while len(front):
            sub = mask[front] & col_new
            cols = np.flatnonzero(sub.any(axis=0))
            edges += zip(front[sub[:, cols].argmax(axis=0)].tolist(), cols.tolist(), strict=True)
            col_new[cols] = False
            back = mask[:, cols] & row_new[:, None]
            front = np.flatnonzero(back.any(axis=1))
            edges += zip(front.tolist(), cols[back[front].argmax(axis=1)].tolist(), strict=True) if len(front) else []
            row_new[front] = False
    return edges


def reach_of(threshold: float) -> float:
    """The greatest distance of unit vectors whose cosine reaches the threshold."""
    return math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK


def blocks(reps: DataFrame, basis: dict[int, np.ndarray], n: int, cell: float, ws: Workspace) -> DataFrame:
    """Rows of at most ``BLOCK`` classes: block, label, d, lo and hi of the leading coordinates, ids, copies, data."""
    lead = {d: b[:, :AXES] for d, b in basis.items()}
    kind = "<f4" if dict(reps.dtypes)["vec"] == "array<float>" else "<f8"

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(b.schema.names.index("vec"))
            sizes = v.value_lengths().to_numpy()
            at = np.zeros((len(sizes), AXES))
            for d in np.unique(sizes):
                own = _unit(_matrix(v.filter(pa.array(sizes == d)))) @ lead[int(d)]
                at[sizes == d, : own.shape[1]] = own
            cols = [pa.array(sizes, pa.int32()), *(pa.array(np.ascontiguousarray(c)) for c in at.T)]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, "d", *places])

    places = [f"at{k}" for k in range(AXES)]

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        seen = 0

        def out() -> pa.RecordBatch:
            nonlocal seen
            label, d = held[0][0], held[0][4]
            at = np.array([h[5:] for h in held])
            ids, copies = (np.array([h[k] for h in held], "<i8").tobytes() for k in (1, 2))
            data = np.array([h[3] for h in held], kind).tobytes()
            seen += 1
            block = (TaskContext.get().partitionId() << 32) | seen
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary()]
            row = (block, label, d, at.min(axis=0).tolist(), at.max(axis=0).tolist(), ids, copies, data)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], ["block", "label", "d", "lo", "hi", "ids", "copies", "data"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and (len(held) == BLOCK or (row[0], row[4]) != (held[0][0], held[0][4])):
                    yield out()
                    held = []
                held.append(row)
        if held:
            yield out()

    doubles = ", ".join(f"{c} double" for c in places)
    placed = reps.select("label", "rep", "copies", "vec").mapInArrow(project, f"label string, rep long, copies long, vec {dict(reps.dtypes)['vec']}, d int, {doubles}")
    order = ["label", "d", *[F.floor(F.col(c) / cell) for c in places], "at0", "rep"]
    placed = placed.repartitionByRange(max(1, -(-n // (2 * BLOCK))), *order).sortWithinPartitions(*order)
    return ws.keep(placed.mapInArrow(cut, "block long, label string, d int, lo array<double>, hi array<double>, ids binary, copies binary, data binary"), "blocks")


def block_pairs(blocked: DataFrame, cell: float, reach: float) -> DataFrame:
    """(d, block_a, block_b) of the blocks near enough to each other, each pair once."""

    def cells(df: DataFrame, wider: float) -> DataFrame:
        for k in range(AXES):
            ends = [F.floor((F.col("lo")[k] - wider) / cell), F.floor((F.col("hi")[k] + wider) / cell)]
            df = df.withColumn(f"c{k}", F.explode(F.sequence(*ends)))
        return df

    side = lambda s: blocked.select("label", "d", *[F.col(c).alias(f"{c}_{s}") for c in ("block", "lo", "hi")])
    own = cells(blocked.select("label", "d", "block", "lo", "hi"), 0.0).select("label", "d", F.col("block").alias("block_a"), *[f"c{k}" for k in range(AXES)])
    met = cells(blocked.select("label", "d", "block", "lo", "hi"), reach).select("label", "d", F.col("block").alias("block_b"), *[f"c{k}" for k in range(AXES)])
    pairs = own.join(met, ["label", "d", *[f"c{k}" for k in range(AXES)]]).where("block_a <= block_b").select("d", "block_a", "block_b").distinct()
    gap = lambda k: F.greatest(F.col("lo_a")[k] - F.col("hi_b")[k], F.col("lo_b")[k] - F.col("hi_a")[k], F.lit(0.0))
    apart = sum((gap(k) * gap(k) for k in range(AXES)), F.lit(0.0))
    boxes = pairs.join(side("a").drop("label", "d"), "block_a").join(side("b").drop("label", "d"), "block_b")
    return boxes.where(apart <= reach * reach).select("d", "block_a", "block_b")


def compare(blocked: DataFrame, basis: dict[int, np.ndarray], cell: float, threshold: float, kind: str) -> DataFrame:
    """(a, b, n): a forest edge if b is not null, else n links of a."""
    pairs = block_pairs(blocked, cell, reach_of(threshold))
    side = lambda s: blocked.select(F.col("block").alias(f"block_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("ids", "copies", "data")])
    full = pairs.join(side("a"), "block_a").join(side("b"), "block_b")
    full = full.select("d", F.expr("block_a = block_b").alias("same"), "ids_a", "copies_a", "data_a", "ids_b", "copies_b", "data_b")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                d, same, ia, ca, xa, ib, cb, xb = (c[k].as_py() for c in b.columns)
                ia, ca, ib, cb = (np.frombuffer(v, "<i8") for v in (ia, ca, ib, cb))
                x, y = (np.frombuffer(v, kind).astype(np.float64).reshape(-1, d) for v in (xa, xb))
                na, nb, edges = np.zeros(len(ia), np.int64), np.zeros(len(ib), np.int64), []
                for i, j, mask in block_links(x, y, same, basis[d], threshold):
                    m, p, q = mask.astype(np.float64), slice(i, i + mask.shape[0]), slice(j, j + mask.shape[1])  # exact: sums stay far below 2**53
                    na[p] += (m @ cb[q]).astype(np.int64)
                    if not (same and i == j):
                        (na if same else nb)[q] += (m.T @ ca[p]).astype(np.int64)
                    edges += [(ia[i + r], ib[j + c]) for r, c in forest(mask)]
                parts = [(ia, na)] if same else [(ia, na), (ib, nb)]
                a = np.concatenate([i[c > 0] for i, c in parts])
                n = np.concatenate([c[c > 0] for _, c in parts])
                if len(a):
                    ea, eb = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate([a, ea])), pa.array([None] * len(a) + eb.tolist(), pa.int64()), pa.array(np.concatenate([n, np.zeros(len(edges), np.int64)]))],
                        ["a", "b", "n"],
                    )

    return full.mapInArrow(run, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """``vectors(vec_id, embedding, label)`` to vec_id, n_links, component_id, kept."""
    ws = Workspace(vectors.sparkSession, "vectors")
    kind = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"  # floats are doubles exactly
    vec = F.col("embedding").cast(f"array<{kind}>")
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    plain = F.when(F.coalesce(good, F.lit(False)), F.transform(vec, lambda x: x + F.lit(0.0).cast(kind)))  # turns -0 to 0
    read = vectors.select("vec_id", F.col("label").cast("string").alias("label"), plain.alias("vec"))
    keyed = read.select("vec_id", "label", "vec", F.when(F.col("vec").isNotNull(), F.struct(F.xxhash64("vec").alias("x"), F.xxhash64(F.lit(1), F.col("vec")).alias("y"))).alias("key"))
    valid = keyed.where("vec is not null")
    reps = ws.keep(valid.groupBy("label", "key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vec").alias("vec")), "reps")
    rows = ws.keep(keyed.select("vec_id", "label", "key"), "rows")
    n = reps.count()
    if n:
        basis = axes(reps)
        cell = max(reach_of(threshold), 0.1)
        found = ws.keep(compare(blocks(reps, basis, n, cell, ws), basis, cell, threshold, "<f4" if kind == "float" else "<f8"), "found")
        links = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
        component = connected_components(found.where("b is not null").select("a", "b"), ws).withColumnRenamed("node", "rep")
        by_class = reps.select("label", "key", "rep", "copies").join(links, "rep", "left").join(component, "rep", "left")
    else:
        by_class = reps.select("label", "key", "rep", "copies").withColumns({"links": F.lit(0).cast("long"), "component": F.col("rep")})
    by_class = by_class.select(
        "label", "key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component")
    )
    linked = rows.where("key is not null").join(by_class, ["label", "key"]).select("vec_id", "links", "component")
    alone = rows.where("key is null").select("vec_id", F.lit(0).cast("long").alias("links"), F.col("vec_id").alias("component"))
    return linked.unionByName(alone).select(
        "vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"), F.col("component").eqNullSafe(F.col("vec_id")).alias("kept")
    )
