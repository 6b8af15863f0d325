"""Near-duplicate documents by min-max hashing (operator 4).

A document's set holds the hashes of its distinct shingles of ``width`` words. Each of ``permutations``
random permutations is evaluated once for every member, and both its minimum and its maximum are kept,
so that the signature has twice as many values as there are hash evaluations. Bands of ``rows`` values
give bucket keys: half of the bands hold minima, half maxima. Documents of one bucket are candidates;
a candidate pair becomes a link only if the full sets reach the similarity (intersection and union are
counted, not estimated).

How a bucket is worked off without listing its pairs: equal sets form one class first. Then, in two
rounds, each bucket's members are compared with one member of it, the pivot, and linked classes join
into components; what a bucket holds of a single component needs no further comparison. At last all
pairs of a bucket whose components still differ, and whose sizes allow a link, are compared. The
components are thus those of all links among candidates; no candidate is dropped.

The chance that a pair at the threshold of 0.8 shares no bucket is (1 - 0.8^6)^40, about 5 in a million.

Cases: a document with fewer words than ``width`` has its whole sequence as its only shingle; without
words or text its set is empty and it links with nothing. Repeated rows and texts fall into one class.
Texts of any length count whole. Extra columns are ignored. An empty table gives an empty result. Rows
without an id join the class of their set, whose id is the smallest there is; rows that share an id are
one node.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, connected_components, mix64, run_hashes

PERMUTATIONS = 120
ROWS = 6
SEED = 4
BLOCK = 2048  # set members hashed at a time


def _blank() -> np.ndarray:
    out = np.zeros(256, bool)
    out[[32, *range(9, 14)]] = True
    return out


BLANK = _blank()


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes. ``bytes.lower`` treats ASCII letters only, and words end at the
    six ASCII white space characters, as they are defined."""
    codes = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8) if text else np.zeros(0, np.uint8)
    w = run_hashes(codes, ~BLANK[codes])
    if not len(w):
        return w
    n = min(width, len(w))
    with np.errstate(over="ignore"):
        h = np.full(len(w) - n + 1, n, np.uint64)
        for k in range(n):
            h += w[k : len(w) - n + 1 + k] * np.uint64(0x9E3779B97F4A7C15 + (k << 20))
    return np.unique(mix64(h))


def _multipliers(permutations: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.RandomState(SEED)
    return (r.randint(0, 1 << 31, permutations).astype(np.uint32) * np.uint32(2) + np.uint32(1)), r.randint(0, 1 << 31, permutations).astype(np.uint32)


def signature(members: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minimum and maximum of each permutation over a set that isn't empty."""
    x = (members >> np.uint64(32)).astype(np.uint32)
    low, high = np.full(len(a), 0xFFFFFFFF, np.uint32), np.zeros(len(a), np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(x), BLOCK):
            v = a[:, None] * x[None, at : at + BLOCK] + b[:, None]
            v ^= v >> np.uint32(15)
            v *= np.uint32(0x2C1B3C6D)
            np.minimum(low, v.min(axis=1), out=low)
            np.maximum(high, v.max(axis=1), out=high)
    return low, high


def band_keys(low: np.ndarray, high: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band; the band's number enters its key."""
    v = np.concatenate([low, high]).astype(np.uint64).reshape(-1, rows)
    h = np.arange(1, len(v) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(rows):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + v[:, k])
    return h


def _digest(members: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(members.tobytes()) if len(members) else b""


def profiles(docs: DataFrame, width: int, permutations: int = PERMUTATIONS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, digest (of the set; null if empty) and bands (keys; null if empty)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _multipliers(permutations)
        n_bands = 2 * permutations // rows
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                counts, digests, keys = [], [], []
                for t in part.column(1):
                    s = shingle_set(t.as_py(), width)
                    counts.append(len(s))
                    digests.append(_digest(s) or None)
                    keys.append(band_keys(*signature(s, a, b), rows).view(np.int64) if len(s) else None)
                valid = [k is not None for k in keys]
                offsets = np.concatenate([[0], np.cumsum(np.array(valid, np.int32) * n_bands)]).astype(np.int32)
                flat = np.concatenate([k for k in keys if k is not None]) if any(valid) else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), lists], ["doc_id", "n_shingles", "digest", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands array<long>")


def sets_of(docs: DataFrame, width: int) -> DataFrame:
    """doc_id and members: the full sets, as sorted arrays."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                sets = [shingle_set(t.as_py(), width).view(np.int64) for t in part.column(1)]
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))], ["doc_id", "members"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, members array<long>")


def _alike(common: Column, n: Column, m: Column, percent: int) -> Column:
    return 100 * common >= percent * (n + m - common)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose full sets reach the similarity. A set is sent once for each of its
    pairs, one side at a time."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("members").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("members").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    both = pairs.join(left, "a").join(right, "b")
    return both.where(_alike(common, F.size("sa"), F.size("sb"), percent)).select("a", "b")


def _size_allows(n: str, m: str, percent: int) -> Column:
    return 100 * F.least(F.col(n), F.col(m)) >= percent * F.greatest(F.col(n), F.col(m))


def classes(docs: DataFrame, ws: Workspace, width: int, percent: int = 80, permutations: int = PERMUTATIONS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component (null for empty sets) for every document."""
    facts = ws.keep(profiles(docs, width, permutations, rows), "profiles")
    reps = (
        facts.where("digest is not null").groupBy("digest")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    )
    reps = ws.keep(reps, "reps")
    ws.release()
    members = reps.select("rep", "n", F.explode("bands").alias("bucket"))
    # Buckets of two and more, with two pivots each, written so that a hot bucket can be split; then every member of them.
    pivots = members.groupBy("bucket").agg(
        F.min("rep").alias("pivot"), F.max(F.struct(F.xxhash64("rep").alias("h"), F.col("rep").alias("rep"))).alias("far"), F.count("*").alias("size")
    ).where("size > 1")
    pivots = ws.keep(pivots.select("bucket", "pivot", F.col("far.rep").alias("other")), "pivots")
    shared = ws.keep(members.join(pivots, "bucket"), "shared")

    # The one time that texts are exchanged: the sets of all members of shared buckets.
    ids = shared.select(F.col("rep").alias("doc_id")).distinct()
    sets = ws.keep(sets_of(docs.select("doc_id", "text").join(ids, "doc_id", "left_semi"), width), "sets")
    ws.release()

    def links_to(pivot: str, rest: DataFrame) -> DataFrame:
        heads = reps.select(F.col("rep").alias(pivot), F.col("n").alias("m"))
        pairs = rest.where(F.col("rep") != F.col(pivot)).select(F.least("rep", pivot).alias("a"), F.greatest("rep", pivot).alias("b")).distinct()
        na, nb = heads.select(F.col(pivot).alias("a"), F.col("m").alias("na")), heads.select(F.col(pivot).alias("b"), F.col("m").alias("nb"))
        return pairs.join(na, "a").join(nb, "b").where(_size_allows("na", "nb", percent)).select("a", "b")

    links = tried = None
    for i, pivot in enumerate(("pivot", "other")):
        rest = shared if links is None else _unsettled(shared, component)
        pairs = links_to(pivot, rest)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = ws.keep(pairs, f"pairs{i}")
        found = ws.keep(confirm(pairs, sets, percent), f"links{i}")
        links = found if links is None else links.unionByName(found)
        tried = pairs if tried is None else tried.unionByName(pairs)
        component = connected_components(links, ws, f"cc{i}")
        ws.release()
    rest = ws.keep(_unsettled(shared, component).select("rep", "n", "component").distinct(), "rest")
    ws.release()
    pairs = ws.keep(prefix_pairs(rest, sets, ws, percent).join(tried, ["a", "b"], "left_anti"), "pairs2")
    more = ws.keep(confirm(pairs, sets, percent), "links2")
    component = _merged(component, more, ws)
    by_class = reps.select("digest", "rep").join(component.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    return facts.select("doc_id", "n_shingles", "digest").join(by_class, "digest", "left").select("doc_id", "n_shingles", "component")


def _merged(component: DataFrame, links: DataFrame, ws: Workspace) -> DataFrame:
    """(node, component) after ``links`` between nodes: only these are joined anew, between components."""
    at = lambda c: F.coalesce(F.col(f"c{c}"), F.col(c)).alias(c)
    known = lambda c: component.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    above = connected_components(links.join(known("a"), "a", "left").join(known("b"), "b", "left").select(at("a"), at("b")), ws, "cc2")
    above = above.select(F.col("node").alias("component"), F.col("component").alias("upper"))
    old = component.join(above, "component", "left").select("node", F.coalesce("upper", "component").alias("component"))
    new = above.join(component.select("node"), F.col("component") == F.col("node"), "left_anti").select(F.col("component").alias("node"), F.col("upper").alias("component"))
    return old.unionByName(new)


def prefix_pairs(rest: DataFrame, sets: DataFrame, ws: Workspace, percent: int) -> DataFrame:
    """The (a, b) of ``rest(rep, n, component)`` that may link, in different components.

    With all shingles in one order, rarest first, two sets of n and m members that share at least
    o = t (n + m) / (1 + t) of them share one among the first n - o + 1 of one and the first m - o + 1 of
    the other. A shingle of a single document finds no partner and only takes up a place; so a copy with
    too many changes of its own meets nobody, however large its group is. This is exact: it leaves out
    no pair that reaches the similarity.
    """
    t = percent / 100
    own = sets.join(rest.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    tokens = own.select(F.col("doc_id").alias("rep"), F.explode("members").alias("token"))
    common = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    held = tokens.join(common, "token").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("held"))
    single = F.col("n") - F.size("held")
    most = F.floor(F.col("n") * (1 - t) + 1e-9) + 1  # the longest such part, for a partner of the least size
    part = F.slice("held", 1, F.greatest(most - single, F.lit(0)).cast("int"))
    rows = rest.join(held, "rep").select("rep", "n", "component", single.alias("single"), F.posexplode(part).alias("k", "x"))
    rows = rows.select("rep", "n", "component", (F.col("single") + F.col("k") + 1).alias("at"), F.col("x.token").alias("token"))
    rows = ws.keep(rows, "prefixes")  # a self-join of a table can be split at a frequent token
    x = rows.select("token", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("component").alias("ca"), F.col("at").alias("pa"))
    y = rows.select("token", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"), F.col("at").alias("pb"))
    need = F.ceil(t * (F.col("na") + F.col("nb")) / (1 + t) - 1e-9)
    near = (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & _size_allows("na", "nb", percent)
    return x.join(y, "token").where(near & (F.col("pa") <= F.col("na") - need + 1) & (F.col("pb") <= F.col("nb") - need + 1)).select("a", "b").distinct()


def _unsettled(shared: DataFrame, component: DataFrame) -> DataFrame:
    """The members of buckets that still hold several components, with ``component``."""
    known = shared.drop("component").join(component.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = known.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
    return known.join(mixed, "bucket", "left_semi")


def near_duplicates(docs: DataFrame, width: int = 2, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs(doc_id, text)``."""
    ws = Workspace(docs.sparkSession, "minhash")
    out = classes(docs, ws, width, percent).withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept"))
