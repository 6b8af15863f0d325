"""Shared helpers: reading tables, intermediate tables in the shared folder, two-level ranks, components.

Intermediate results go to Parquet below the folder that ``spark.checkpoint.dir`` names, so that any
executor can read them again after another is lost. Only a local session may do without that setting.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import time
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.workspace import shared_folder

FEW_LINKS = 1_000_000  # that one task joins into components, in about 100 MB


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables, by any path Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Workspace:
    """Intermediate tables of one operator call: written once, read any number of times.

    Tables live until ``drop`` or the end of the driver, since the DataFrame an operator
    returns still reads some of them.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/folioscope/{label}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and return a reader over it; this cuts the lineage."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def release(self) -> None:
        """Lets Spark remove the shuffle files of tables that are written and no longer referenced: one
        collection frees their plans, a second one what those held."""
        for _ in range(2):
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.3)

    def close(self) -> None:
        with contextlib.suppress(Exception):  # the session may have ended already
            self.drop()


def prefix_sums(df: DataFrame, key: str, sub: str, order: list[Column], weight: Column | None = None) -> DataFrame:
    """Adds ``before``: the sum of ``weight`` (1 if None) over the rows of ``key`` that precede a row
    in the order (``sub``, ``order``).

    Two levels keep a large key out of a single task: a running sum inside each (key, sub), plus the
    sum of the earlier subs from a table with one row for each (key, sub). ``sub`` must not be null
    and should hold a bounded number of rows for each value.
    """
    w = weight if weight is not None else F.lit(1).cast("long")
    inner = Window.partitionBy(key, sub).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sizes = df.groupBy(key, sub).agg(F.sum(w).alias("_n"))
    outer = Window.partitionBy(key).orderBy(sub).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(key, sub, F.coalesce(F.sum("_n").over(outer), F.lit(0)).alias("_offset"))
    return (
        df.withColumn("_inner", F.coalesce(F.sum(w).over(inner), F.lit(0)))
        .join(offsets, [key, sub])
        .withColumn("before", (F.col("_inner") + F.col("_offset")).cast("long"))
        .drop("_inner", "_offset")
    )


def _least_nodes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, p): each node of a table of links and the least node it reaches."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not parts:
        return
    u, v = (np.concatenate(c) for c in zip(*parts, strict=True))
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    label = np.arange(len(nodes))
    while True:
        new, low = label.copy(), np.minimum(label[a], label[b])
        for end in (label[a], label[b]):  # the nodes pointed at follow, and so all that point at them
            np.minimum.at(new, end, low)
        while not np.array_equal(further := new[new], new):
            new = further
        if np.array_equal(new, label):
            break
        label = new
    for at in range(0, len(nodes), 100_000):
        cut = slice(at, at + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(nodes[cut]), pa.array(nodes[label[cut]])], ["u", "p"])


def connected_components(links: DataFrame, ws: Workspace, label: str = "cc", max_rounds: int = 60, few: int = FEW_LINKS) -> DataFrame:
    """(node, component) for every node of ``links(a, b)``; component is the smallest node reachable.

    Randomised contraction: in each round every node points at its neighbour, or itself, of least
    hashed priority, and the links are rewritten between the nodes pointed at. The number of nodes
    falls by a constant factor a round whatever the shape of the graph, chains and hubs included, so
    the rounds grow with the logarithm of the longest chain. Once no more than ``few`` links are left, one task
    finishes them. Neither links nor nodes are collected. Self-links only name a node; null ends are not
    allowed; repeated links change nothing.
    """
    tables: list[str] = []
    edges = ws.keep(links.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), f"{label}-e0")
    for i in range(max_rounds):
        if edges.count() <= few:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = F.struct(F.xxhash64(F.col("v"), F.lit(i)).alias("h"), F.col("v").alias("v"))
        best = both.groupBy("u").agg(F.min(near).alias("m"))
        itself = F.xxhash64(F.col("u"), F.lit(i)) < F.col("m.h")
        parent = ws.keep(best.select("u", F.when(itself, F.col("u")).otherwise(F.col("m.v")).alias("p")), f"{label}-p{i}")
        tables.append(f"{label}-p{i}")
        p1, p2 = parent.select("u", F.col("p").alias("pu")), parent.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        moved = edges.join(p1, "u").join(p2, "v").where("pu <> pv")
        edges = ws.keep(moved.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), f"{label}-e{i + 1}")
        ws.drop(f"{label}-e{i}")
    else:
        raise RuntimeError("components did not converge")
    last = ws.keep(edges.repartition(1).mapInArrow(_least_nodes, "u long, p long"), f"{label}-last")
    if not tables:
        return last.select(F.col("u").alias("node"), F.col("p").alias("component"))
    found = [*(ws.spark.read.parquet(ws.path(t)) for t in tables), last]
    out = found[0].select(F.col("u").alias("node"), F.col("p").alias("root"))
    for nxt in found[1:]:
        step = nxt.select(F.col("u").alias("root"), F.col("p").alias("further"))
        out = out.join(step, "root", "left").select("node", F.coalesce("further", "root").alias("root"))
    # Both sides are written before they are joined, so that one giant component can be split.
    out = ws.keep(out, f"{label}-roots")
    least = ws.keep(out.groupBy("root").agg(F.min("node").alias("component")), f"{label}-least")
    for t in tables:
        ws.drop(t)
    return out.join(least, "root").select("node", "component")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of uint64 values (xor-shift and multiply)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


@lru_cache(1)
def _code_hashes() -> np.ndarray:
    return mix64(np.arange(1, (1 << 16) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_places = mix64(np.arange(1, 257, dtype=np.uint64) << np.uint64(20))


def _place_hashes(n: int) -> np.ndarray:
    return _places if n <= len(_places) else mix64(np.arange(1, n + 1, dtype=np.uint64) << np.uint64(20))


def run_hashes(codes: np.ndarray, inside: np.ndarray, block: int = 1 << 14) -> np.ndarray:
    """A 64-bit hash of every run of ``codes`` (below 65536, or code points) that are ``inside``: the sum of its
    codes' hashes, each times the hash of its place in the run, mixed. Blocks end outside of runs."""
    found, at, n = [], 0, len(codes)
    while at < n:
        end = min(n, at + block)
        if end < n:
            outside = np.flatnonzero(~inside[at:end])
            if len(outside):
                end = at + int(outside[-1]) + 1
            else:  # a run longer than a block
                more = np.flatnonzero(~inside[end:])
                end = end + int(more[0]) if len(more) else n
        own = codes[at:end]
        places = np.flatnonzero(inside[at:end])
        at = end
        if not len(places):
            continue
        new = np.ones(len(places), bool)
        np.not_equal(places[1:] - places[:-1], 1, out=new[1:])
        first = new.nonzero()[0]
        sizes = np.empty(len(first), np.int64)
        sizes[:-1], sizes[-1] = first[1:] - first[:-1], len(places) - first[-1]
        own = own[places]
        wide = own.dtype.itemsize > 2
        h = _code_hashes()[np.minimum(own, 0xFFFF) if wide else own]
        if wide and (far := own > 0xFFFF).any():
            h[far] = mix64(own[far].astype(np.uint64))
        with np.errstate(over="ignore"):
            h *= _place_hashes(int(sizes.max()))[np.arange(len(places)) - np.repeat(first, sizes)]
            found.append(mix64(np.add.reduceat(h, first) + sizes.astype(np.uint64)))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)
