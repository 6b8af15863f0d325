"""Hard-negative mining with a vantage-point tree (operator 13).

Vectors become whole numbers, their inner products are the scores. With one more component, which brings all rows to
the norm of the largest, and with 0 in its place for an anchor, a higher score is a smaller distance; so a window of
scores is an annulus around the anchor. A vantage-point tree cuts the rows into leaves; each leaf knows how near and
how far its rows are from every vantage point above it, and so, for an anchor, the least and greatest score that any
of its rows can have.

``nearest`` finds the k best rows of every window of every anchor. Leaves are visited nearest first inside the annulus:
first the bucket (a few leaves that travel together) with the nearest leaf; the k-th score found there then tells
which other buckets can hold better rows, and in a bucket every leaf visited raises the bound for the next. A leaf
beyond the outer rim, within the inner one, or below the bound is not looked at. The positives are one such search
among rows of the anchor's label, with a window without ends; they give the windows of the second search, among rows
of other labels. Bounds have a slack for rounding, so the results are exact.

Scale: the tree is fitted on a bounded sample (``SAMPLE`` rows; all else is over all rows) and has at most ``LEAVES``
leaves; the tree and the leaves' rims are broadcast, with that bound. Rows are exchanged by bucket, at most ``BUCKET``
rows each; anchors follow them sorted behind the rows of their bucket, and are streamed. Leaves that are too large are cut
into several buckets. Of rows with equal label and vector only the first k + 1 ids can ever be among k best others, so
no more of them become candidates, in partial ranks before the exchange: no group of copies makes a bucket large.

Cases: rows with a null id, label or vector, or with null or non-finite components, take no part. Shorter vectors count
as if filled up with zeros; a vector of no components has the score 0 with all. Ties go to the smaller id. Repeated
rows are rows: each is an anchor, a positive or a negative of its own. Components and scores beyond 2 ** 62 count as
that. Fewer rows than asked for give what there is; a positive whose score is below 0 has an empty window. Empty
tables, or tables without anchors, give an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # per cent of a positive's score
SAMPLE = 1 << 14  # rows that the tree is fitted on, fewer for more than 1024 components
LEAVES = 1 << 12
LEAF = 512  # rows that a leaf aims at
BUCKET = 4096
SLICE = 256  # anchors worked on together
FAR = 1 << 62
SLACK = 1e-6  # of the squares of the norms: distances near 0 are known to the root of the rounding only
EXACT = 1 << 53
FOUND = "row long, w int, score long, vec_id long"
VISIT = "bucket long, row long, label long, v binary, windows array<struct<lo:long,hi:long>>"


@dataclass
class Shape:
    """What all tasks need to know of the numbers: components of the longest vector, how they are packed, whether
    products of floats are exact, and the square of the largest norm."""

    size: int
    packed: str
    exact: bool
    top: float

    def ints(self, col: pa.Array) -> np.ndarray:
        """Packed vectors, a row each."""
        if not self.size or not len(col):
            return np.zeros((len(col), self.size), self.packed)
        return np.frombuffer(b"".join(col.to_pylist()), self.packed).reshape(len(col), self.size)

    def scores(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """All inner products, as whole numbers."""
        if self.exact:
            return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
        return np.clip(a.astype(object) @ b.astype(object).T, -FAR, FAR).astype(np.int64) if a.shape[1] else np.zeros((len(a), len(b)), np.int64)

    def raised(self, x: np.ndarray) -> np.ndarray:
        """Rows with the component that brings them to the largest norm."""
        x = x.astype(np.float64)
        rest = np.sqrt(np.maximum(self.top - (x * x).sum(axis=1), 0.0))
        return np.hstack([x, rest[:, None]])


@dataclass
class Tree:
    """A complete binary tree: inner node k has a vantage point and a radius; rows within it go to 2k + 1, others to
    2k + 2. The leaves' rims and labels follow when all rows have been placed."""

    depth: int
    points: np.ndarray
    radii: np.ndarray
    near: np.ndarray | None = None  # leaf, level: least distance of the leaf's rows to the vantage point
    far: np.ndarray | None = None
    labels: np.ndarray | None = None  # one bit for each of 64 classes of labels
    single: np.ndarray | None = None  # the leaf has but one label,
    label: np.ndarray | None = None  # and this is one of them
    first: np.ndarray | None = None  # the first of the leaf's buckets
    pieces: np.ndarray | None = None

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf, and distances to the vantage points passed, of each row of ``x``."""
        node, passed = np.zeros(len(x), np.int64), np.zeros((len(x), self.depth))
        for level in range(self.depth):
            d = np.sqrt(((x - self.points[node]) ** 2).sum(axis=1))
            passed[:, level] = d
            node = 2 * node + 1 + (d > self.radii[node])
        return node - ((1 << self.depth) - 1), passed

    def limits(self, q: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest score of each anchor of ``q`` with any row of each leaf, with slack; empty
        leaves have a greatest below the least."""
        q = q.astype(np.float64)
        own = (q * q).sum(axis=1)
        least = np.zeros((len(q), 1 << self.depth))
        most = np.full_like(least, np.inf)
        flat = np.hstack([q, np.zeros((len(q), 1))])
        for level in range(self.depth):
            start = (1 << level) - 1
            p = self.points[start : 2 * start + 1]
            d = np.sqrt(np.maximum(own[:, None] + (p * p).sum(axis=1)[None, :] - 2 * (flat @ p.T), 0.0))
            d = np.repeat(d, 1 << (self.depth - level), axis=1)
            least = np.maximum(least, np.maximum(d - self.far[:, level], self.near[:, level] - d))
            most = np.minimum(most, d + self.far[:, level])
        slack = SLACK * (own[:, None] + shape.top) + 1
        high = (own[:, None] + shape.top - least**2) / 2 + slack
        low = (own[:, None] + shape.top - most**2) / 2 - slack if self.depth else np.full_like(least, -np.inf)
        if not self.depth:
            high = np.full_like(least, np.inf)
        empty = self.pieces == 0
        high[:, empty], low[:, empty] = -np.inf, np.inf
        return low, high


def fit(x: np.ndarray, leaves: int) -> Tree:
    """A tree over the sample ``x``. Of a few rows of a node the one whose distances spread most is its vantage point;
    the radius is their median."""
    depth = max(0, (min(leaves, LEAVES, max(1, len(x) // 4)) - 1).bit_length())
    depth -= (1 << depth) > max(1, len(x) // 2)
    inner = (1 << depth) - 1
    points, radii, own = np.zeros((inner, x.shape[1])), np.zeros(inner), {0: np.arange(len(x))}
    for node in range(inner):
        at = own.pop(node)
        best = None
        for c in at[:: max(1, len(at) // 5)][:5]:
            d = np.sqrt(((x[at] - x[c]) ** 2).sum(axis=1))
            if best is None or d.var() > best[0]:
                best = (d.var(), c, d)
        if best is not None:
            points[node], radii[node] = x[best[1]], np.median(best[2])
            inside = best[2] <= radii[node]
            own[2 * node + 1], own[2 * node + 2] = at[inside], at[~inside]
        else:
            own[2 * node + 1] = own[2 * node + 2] = at
    return Tree(depth, points, radii)


def whole_numbers(vector: Column) -> Column:
    """floor(256 x) of every component."""
    return F.transform(vector, lambda x: F.greatest(F.least(F.floor(SCALE * x.cast("double")), F.lit(FAR)), F.lit(-FAR)))


def taking_part(rows: DataFrame) -> DataFrame:
    """(row, vec_id, label, vec) of the rows of ``rows(vec_id, label, embedding)`` that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    good = rows.where("vec_id is not null and label is not null and embedding is not null").where(~bad)
    return good.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole_numbers(F.col("embedding")).alias("vec"))


def _shape(rows: DataFrame) -> tuple[Shape, int]:
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    big = F.aggregate("vec", F.lit(0).cast("long"), lambda a, x: F.greatest(a, F.abs(x)))
    r = rows.agg(F.max(F.size("vec")).alias("size"), F.max(big).alias("big"), F.max(square).alias("top"), F.count("*").alias("n")).first()
    if not r.n:
        return Shape(0, "<i2", True, 0.0), 0
    packed = "<i2" if r.big < 1 << 15 else "<i4" if r.big < 1 << 31 else "<i8"
    return Shape(r["size"], packed, r["size"] * r.big * r.big < EXACT, r.top * (1 + 1e-9)), r.n


def _pack(rows: DataFrame, shape: Shape) -> DataFrame:
    """``rows`` with ``v``, their vectors packed, in place of ``vec``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec = b.column(3)
            sizes = vec.value_lengths().to_numpy()
            out = np.zeros((len(sizes), shape.size), shape.packed)
            at = np.arange(shape.size)[None, :] < sizes[:, None]
            out[at] = vec.flatten().to_numpy(zero_copy_only=False)
            v = pa.array([x.tobytes() for x in out], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(3)), v], ["row", "vec_id", "label", "v"])

    return rows.select("row", "vec_id", "label", "vec").mapInArrow(run, "row long, vec_id long, label long, v binary")


def _placed(rows: DataFrame, tree: Broadcast, shape: Shape) -> DataFrame:
    """``rows(row, vec_id, label, v)`` with their leaf and the distances to the vantage points above it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                leaf, passed = tree.value.place(shape.raised(shape.ints(b.column(3))))
                far = pa.FixedSizeListArray.from_arrays(pa.array(passed.ravel()), tree.value.depth).cast(pa.list_(pa.float64())) if tree.value.depth else pa.array([[]] * len(leaf), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf), far], ["row", "vec_id", "label", "v", "leaf", "passed"])

    return rows.mapInArrow(run, "row long, vec_id long, label long, v binary, leaf long, passed array<double>")


@dataclass
class Index:
    """Placed rows (bucket, leaf, row, vec_id, label, v) and the tree over them."""

    rows: DataFrame
    tree: Broadcast
    shape: Shape
    buckets: int


def build(rows: DataFrame, shape: Shape, n: int, ws: Workspace) -> Index:
    """The tree over ``rows(row, vec_id, label, v)``: fitted on a sample, its leaves described from all rows."""
    spark = ws.spark
    some = rows.orderBy(F.xxhash64("vec_id", "row"), "row").limit(max(1, min(SAMPLE, (SAMPLE << 10) // max(shape.size, 1)))).select("v")
    sample = shape.raised(np.frombuffer(b"".join(bytes(r.v) for r in some.collect()), shape.packed).reshape(-1, shape.size) if shape.size else np.zeros((1, 0)))
    tree = fit(sample, -(-n // LEAF))
    placed = ws.keep(_placed(rows, spark.sparkContext.broadcast(tree), shape), "placed")
    levels = range(tree.depth)
    stats = placed.groupBy("leaf").agg(
        F.count("*").alias("n"), F.expr("bit_or(shiftleft(1L, cast(pmod(label, 64) AS INT)))").alias("labels"),
        F.min("label").alias("one"), F.max("label").alias("other"),
        *[F.min(F.get("passed", F.lit(k))).alias(f"near{k}") for k in levels], *[F.max(F.get("passed", F.lit(k))).alias(f"far{k}") for k in levels],
    ).collect()  # a row for each leaf, at most LEAVES
    leaves = 1 << tree.depth
    tree.near, tree.far = np.zeros((leaves, tree.depth)), np.zeros((leaves, tree.depth))
    tree.labels, sizes = np.zeros(leaves, np.uint64), np.zeros(leaves, np.int64)
    tree.single, tree.label = np.zeros(leaves, bool), np.zeros(leaves, np.int64)
    for r in stats:
        tree.near[r.leaf], tree.far[r.leaf] = [r[f"near{k}"] for k in levels], [r[f"far{k}"] for k in levels]
        tree.labels[r.leaf], sizes[r.leaf] = np.uint64(r.labels & (2**64 - 1)), r.n
        tree.single[r.leaf], tree.label[r.leaf] = r.one == r.other, r.one
    tree.first, tree.pieces, filled, last = np.zeros(leaves, np.int64), -(-sizes // BUCKET), 0, 0
    for leaf in np.flatnonzero(sizes):
        if tree.pieces[leaf] > 1:
            last += filled > 0
            tree.first[leaf], last, filled = last, last + tree.pieces[leaf], 0
            continue
        if filled + sizes[leaf] > BUCKET:
            last, filled = last + 1, 0
        tree.first[leaf], filled = last, filled + sizes[leaf]
    at = F.col("leaf") + 1
    first, pieces = F.array(*[F.lit(int(x)) for x in tree.first]), F.array(*[F.lit(int(max(x, 1))) for x in tree.pieces])
    bucket = (F.element_at(first, at.cast("int")) + F.pmod(F.xxhash64("row"), F.element_at(pieces, at.cast("int")))).cast("long")
    return Index(placed.select(bucket.alias("bucket"), "leaf", "row", "vec_id", "label", "v"), spark.sparkContext.broadcast(tree), shape, int(last + 1))


def _wanted(low, high, lo, hi, label, tree: Tree, same: bool) -> np.ndarray:
    """Which leaves (anchor, leaf) may hold a row of any window (anchor, window) and of the right label."""
    out = np.zeros(high.shape, bool)
    for w in range(lo.shape[1]):
        out |= (high >= lo[:, w, None]) & (low <= hi[:, w, None]) & (lo[:, w, None] <= hi[:, w, None])
    if same:
        bits = np.left_shift(np.uint64(1), (label % 64).astype(np.uint64))
        return out & ((tree.labels[None, :] & bits[:, None]) != 0)
    return out & ~(tree.single[None, :] & (tree.label[None, :] == label[:, None]))


def _windows(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper ends (anchor, window), as floats would round them: whole numbers; missing windows are empty."""
    sizes = col.value_lengths().to_numpy()
    most = int(sizes.max()) if len(sizes) else 0
    lo, hi = np.full((len(sizes), most), FAR, np.int64), np.full((len(sizes), most), -FAR, np.int64)
    at = np.arange(most)[None, :] < sizes[:, None]
    flat = col.flatten()
    lo[at], hi[at] = flat.field("lo").to_numpy(), flat.field("hi").to_numpy()
    return lo, hi


def visits(anchors: DataFrame, index: Index, same: bool, nearest: bool) -> DataFrame:
    """VISIT: ``anchors(row, label, v, windows, seen)`` once for each bucket to look at: with ``nearest`` the one with the
    leaf of the greatest scores inside a window, else all that may hold a row but ``seen``."""
    tree, shape = index.tree, index.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t: Tree = tree.value
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                lo, hi = _windows(b.column(3))
                low, high = t.limits(shape.ints(b.column(2)), shape)
                ok = _wanted(low, high, lo, hi, b.column(1).to_numpy(), t, same)
                seen = b.column(4).to_numpy(zero_copy_only=False)
                who, where = [], []
                if nearest:
                    inside = np.where(ok, np.minimum(high, hi.max(axis=1, initial=-FAR)[:, None]), -np.inf)
                    # Of leaves that reach the outer rim alike, the one that lies deeper inside comes first.
                    order = np.lexsort((-low, -inside), axis=1)[:, 0]
                    who = np.flatnonzero(ok.any(axis=1))
                    where = t.first[order[who]]
                else:
                    for k in range(b.num_rows):
                        at_leaves = np.flatnonzero(ok[k])
                        own = np.unique(np.concatenate([np.arange(t.first[x], t.first[x] + t.pieces[x]) for x in at_leaves])) if len(at_leaves) else np.zeros(0, np.int64)
                        own = own[own != seen[k]]
                        who.append(np.full(len(own), k))
                        where.append(own)
                    who, where = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (who, where))
                for cut in range(0, len(who), 4096):
                    part = b.take(pa.array(who[cut : cut + 4096], pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(where[cut : cut + 4096], pa.int64()), *(part.column(k) for k in range(4))], ["bucket", "row", "label", "v", "windows"])

    return anchors.select("row", "label", "v", "windows", F.coalesce("seen", F.lit(-1).cast("long")).alias("seen")).mapInArrow(run, VISIT)


class Best:
    """The k best rows of every window of some anchors, while leaves are visited."""

    def __init__(self, lo: np.ndarray, k: int) -> None:
        self.least, self.k = lo.copy(), k  # a row below the least of its window is of no use any more
        self.held = [tuple(np.zeros(0, np.int64) for _ in range(3)) for _ in range(lo.shape[1])]  # anchor, score, id

    def add(self, w: int, own: np.ndarray, scores: np.ndarray, ok: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` and ``ok`` (anchor, row) of the anchors ``own`` with a leaf's rows ``ids``."""
        k = self.k
        if scores.shape[1] > k:
            inside = np.where(ok, scores, -FAR - 1)
            kth = np.partition(inside, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
            ok = ok & (scores >= kth[:, None])
        a, r = np.nonzero(ok)
        if not len(a):
            return
        who, score, vec = (np.concatenate(x) for x in zip(self.held[w], (own[a], scores[a, r], ids[r]), strict=True))
        order = np.lexsort((vec, -score, who))
        who, score, vec = who[order], score[order], vec[order]
        starts = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
        rank = np.arange(len(who)) - np.repeat(starts, np.diff(np.r_[starts, len(who)]))
        last = rank == k - 1
        self.least[who[last], w] = np.maximum(self.least[who[last], w], score[last])
        keep = rank < k
        self.held[w] = who[keep], score[keep], vec[keep]


def _search(rows: pa.RecordBatch, anchors: pa.RecordBatch, tree: Tree, shape: Shape, same: bool, k: int) -> Best:
    """The best rows of one bucket for a slice of anchors, leaf after leaf, the nearest first."""
    leaf, row, ids, label = (rows.column(c).to_numpy() for c in range(4))
    own_row, own_label, q = anchors.column(1).to_numpy(), anchors.column(2).to_numpy(), shape.ints(anchors.column(3))
    lo, hi = _windows(anchors.column(4))
    best, x = Best(lo, k), shape.ints(rows.column(4))
    low, high = tree.limits(q, shape)
    leaves = np.unique(leaf)
    for at in leaves[np.argsort(-high[:, leaves].mean(axis=0), kind="stable")]:
        here = np.flatnonzero(leaf == at)
        ok = _wanted(low[:, [at]], high[:, [at]], best.least, hi, own_label, _only(tree, at), same)[:, 0]
        who = np.flatnonzero(ok)
        if not len(who):
            continue
        s = shape.scores(q[who], x[here])
        fits = (own_label[who][:, None] == label[here][None, :]) == same
        if same:
            fits &= own_row[who][:, None] != row[here][None, :]
        for w in range(lo.shape[1]):
            best.add(w, who, s, fits & (s >= best.least[who, w, None]) & (s <= hi[who, w, None]), ids[here])
    return best


def _only(tree: Tree, leaf: int) -> Tree:
    return Tree(0, tree.points[:0], tree.radii[:0], labels=tree.labels[[leaf]], single=tree.single[[leaf]], label=tree.label[[leaf]])


def searched(seen: DataFrame, index: Index, same: bool, k: int) -> DataFrame:
    """FOUND: for each anchor and bucket of ``seen`` (VISIT) the best ``k`` rows of each of its windows."""
    tree, shape = index.tree, index.shape
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    rows = index.rows.select("bucket", F.lit(0).alias("kind"), "leaf", "row", "vec_id", "label", "v", null("array<struct<lo:long,hi:long>>", "windows"))
    asked = seen.select("bucket", F.lit(1).alias("kind"), null("long", "leaf"), "row", null("long", "vec_id"), "label", "v", "windows")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        whole: pa.RecordBatch | None = None
        bucket = None
        for b in batches:
            key, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (kind[1:] != kind[:-1]), True])
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                part = b.slice(lo, hi - lo)
                if key[lo] != bucket:
                    bucket, held, whole = key[lo], [], None
                if kind[lo] == 0:
                    held.append(part.select([2, 3, 4, 5, 6]))
                    whole = None
                    continue
                if not held:
                    continue
                if whole is None:
                    whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held = [whole]
                part = part.select([0, 3, 5, 6, 7])
                for at in range(0, part.num_rows, SLICE):
                    some = part.slice(at, SLICE)
                    own = some.column(1).to_numpy()
                    best = _search(whole, some, tree.value, shape, same, k)
                    for w, (who, score, vec) in enumerate(best.held):
                        if len(who):
                            yield pa.RecordBatch.from_arrays([pa.array(own[who]), pa.array(np.full(len(who), w, np.int32)), pa.array(score), pa.array(vec)], ["row", "w", "score", "vec_id"])

    return rows.unionByName(asked).repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(run, FOUND)


def nearest(anchors: DataFrame, index: Index, same: bool, k: int, ws: Workspace, name: str) -> DataFrame:
    """(row, w, score, vec_id, rank): the ``k`` best rows of every window of ``anchors(row, label, v, windows)``."""
    seen = ws.keep(visits(anchors.withColumn("seen", F.lit(None).cast("long")), index, same, True), f"{name}-visits1")
    found = ws.keep(searched(seen, index, same, k), f"{name}-found1")
    full = found.groupBy("row", "w").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k)
    raised = full.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("w", "least"))).alias("least"))
    again = anchors.join(seen.select("row", F.col("bucket").alias("seen")), "row").join(raised, "row", "left")
    higher = F.transform("windows", lambda x, w: x.withField("lo", F.greatest(x["lo"], F.coalesce(F.element_at("least", w), x["lo"]))))
    rest = ws.keep(visits(again.withColumn("windows", F.when(F.col("least").isNull(), F.col("windows")).otherwise(higher)), index, same, False), f"{name}-visits2")
    more = ws.keep(searched(rest, index, same, k), f"{name}-found2")
    w = Window.partitionBy("row", "w").orderBy(F.desc("score"), "vec_id")
    return ws.keep(found.unionByName(more).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k), name)


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(rows: DataFrame, is_anchor: Column, ws: Workspace | None = None) -> DataFrame:
    """RESULT for ``rows(vec_id, label, embedding)``; ``is_anchor`` is a condition on vec_id and label."""
    spark = rows.sparkSession
    ws = ws or Workspace(spark, "hard-negatives")
    own = ws.keep(taking_part(rows), "rows")
    shape, n = _shape(own)
    if not n:
        return spark.createDataFrame([], RESULT)
    first = Window.partitionBy("label", "vec").orderBy("vec_id", "row")
    most = max(POSITIVES, NEGATIVES) + 1  # of equal rows; an anchor may be one of them
    candidates = own.withColumn("k", F.row_number().over(first)).where(F.col("k") <= most).drop("k")
    candidates = ws.keep(_pack(candidates, shape), "candidates")
    index = build(candidates, shape, candidates.count(), ws)
    index.rows = ws.keep(index.rows, "buckets")
    anchors = ws.keep(_pack(own.where(is_anchor), shape), "anchors")

    ends = F.struct(F.lit(-FAR).alias("lo"), F.lit(FAR).alias("hi"))
    positives = nearest(anchors.withColumn("windows", F.array(ends)), index, True, POSITIVES, ws, "positives")
    score = lambda x: x["score"].cast("decimal(38,0)")
    window = lambda x: F.struct(F.ceil(score(x) * LOW / 100).cast("long").alias("lo"), F.floor(score(x) * HIGH / 100).cast("long").alias("hi"))
    listed = positives.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("p"))
    windowed = anchors.join(listed, "row").withColumn("windows", F.transform("p", window)).drop("p")
    negatives = nearest(windowed, index, False, NEGATIVES, ws, "negatives")
    p = positives.select("row", (F.col("rank") - 1).alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return negatives.join(p, ["row", "w"]).join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 10
"""
