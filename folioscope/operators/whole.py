"""Whole rankings of stated questions (R1, R2, R4): every passage for every question, with its ranks.

Pairs of questions and passages are the result's own rows, so there are very many. They are neither stored nor exchanged
as rows: a piece holds some thousand pairs of one question, sorted, as whole numbers in as few bytes as they need. Pieces go
from one ranking to the next. A question's pairs are dealt to buckets by the order of the ranking, and one bucket is sorted
in a task; what lies in earlier buckets was counted before.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.workspace import Tables
from . import scan
from .scan import Asked
from .vectors import DIGITS

BUCKET = 1 << 19  # pairs of a question in one bucket, about
SLICE = 1 << 16  # passages that follow each other, about: pages are whole in it
CELLS = 1 << 22  # pairs that a scan holds before it packs them
SAMPLE, SHARE = 2000, 100  # passages that bounds of buckets are taken from: in all, and for each bucket, at least
FUSED_DIGITS = 12
PIECES = "qid long, bucket int, n int, data binary"  # bucket: of a ranking, or the slice
HEAD = struct.Struct("<qBI")


def pack(rising: np.ndarray, *columns: np.ndarray) -> bytes:
    """Columns of whole numbers: the first by its steps, the others less their smallest; byte by byte, compressed."""
    codec, out = pa.Codec("zstd", 1), []
    for k, x in enumerate((rising, *columns)):
        low = int(x[0] if k == 0 else x.min())
        rest = np.diff(x, prepend=x[0]) if k == 0 else x - low
        width = (int(rest.max()).bit_length() + 7) // 8
        body = codec.compress(rest.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes(), asbytes=True) if width else b""
        out += HEAD.pack(low, width, len(body)), body
    return b"".join(out)


def unpack(data: bytes, n: int) -> list[np.ndarray]:
    codec, out, at = pa.Codec("zstd"), [], 0
    while at < len(data):
        low, width, size = HEAD.unpack_from(data, at)
        at += HEAD.size
        x = np.zeros((n, 8), np.uint8)
        if width:
            x[:, :width] = np.frombuffer(codec.decompress(data[at : at + size], n * width, asbytes=True), np.uint8).reshape(width, n).T
        x = x.view("<i8").ravel()
        out.append((x if out else np.cumsum(x)) + low)
        at += size
    return out


def gathered(pieces: pa.Table) -> list[np.ndarray]:
    """The columns of all ``pieces``, one behind the other."""
    parts = [unpack(d, n) for d, n in zip(pieces["data"].to_pylist(), pieces["n"].to_pylist(), strict=True)]
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


Marks = tuple[list[int], list[int]]  # where buckets begin but the first: of two columns, in order


def cuts(first: np.ndarray, second: np.ndarray, marks: Marks) -> list[int]:
    """Where the buckets begin and end among rows that are sorted by both columns."""
    left, right = np.searchsorted(first, marks[0], "left"), np.searchsorted(first, marks[0], "right")
    return [0, *(int(a + np.searchsorted(second[a:b], s)) for a, b, s in zip(left, right, marks[1], strict=True)), len(first)]


class Dealt:
    """Pieces in the making."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, int, int, bytes]] = []

    def add(self, qid: int, bucket: int, *columns: np.ndarray) -> None:
        if len(columns[0]):
            self.rows.append((qid, bucket, len(columns[0]), pack(*columns)))

    def cut(self, qid: int, marks: Marks, first: np.ndarray, second: np.ndarray, *columns: np.ndarray) -> None:
        """Rows that are sorted by the first two columns, by bucket."""
        at = cuts(first, second, marks)
        for bucket, (a, b) in enumerate(zip(at, at[1:], strict=False)):
            self.add(qid, bucket, *(x[a:b] for x in (first, second, *columns)))

    def batch(self) -> pa.RecordBatch:
        q, b, n, d = zip(*self.rows, strict=True) if self.rows else ((), (), (), ())
        types = pa.int64(), pa.int32(), pa.int32(), pa.binary()
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((q, b, n, d), types, strict=True)], ["qid", "bucket", "n", "data"])

    def table(self) -> pa.Table:
        return pa.Table.from_batches([self.batch()])


def scored(batches: Iterable[pa.RecordBatch], asked: Asked) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ords, rising; cosines, falling as the numbers rise; keyword scores), whole numbers, of blocks of passages."""

    def block(held: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ords, cosine, keyword = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(ords)
        whole = lambda x: np.rint(x.T * 10**DIGITS).astype(np.int64)[:, order]
        return ords[order], -whole(cosine), whole(keyword)

    held, cells = [], 0
    for part in scan._scored(batches, asked, True):
        held.append(part)
        cells += part[1].size
        if cells >= CELLS:
            yield block(held)
            held, cells = [], 0
    if held:
        yield block(held)


def fused_key(dense: np.ndarray, keyword: np.ndarray | None, k: int) -> np.ndarray:
    """The sum of shares, rounded half up as SQL does, as a whole number that falls as it rises."""
    return -np.floor((1.0 / (k + dense) + (0.0 if keyword is None else 1.0 / (k + keyword))) * 10.0**FUSED_DIGITS + 0.5).astype(np.int64)


def bounds(passages: DataFrame, asked: Asked, n: int, k: int) -> dict[int, dict[str, Marks]]:
    """Marks of each ranking for each question, from a sample of passages. Buckets are about even, whatever scores are
    tied, since ties are cut too; which bucket a pair is in does not change its rank."""
    size = BUCKET
    buckets = -(-n // size)
    if buckets < 2:
        return {q: {by: ([], []) for by in ("cosine", "keyword", "fused")} for q in asked.qids}
    step = max(1, n // max(SAMPLE, SHARE * buckets))
    some = passages.where(F.pmod(F.xxhash64("ord"), F.lit(step)) == 0)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ords, cosine, keyword in scored(batches, asked):
            out = Dealt()
            for q, c, w in zip(asked.qids, cosine, keyword, strict=True):
                out.add(q, 0, ords, c, w)
            yield out.batch()

    def places(first: np.ndarray, second: np.ndarray, pieces: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(1, pieces) * len(first) // pieces
        return first[at], second[at]

    def marks(key: tuple, pieces: pa.Table) -> pa.Table:
        ords, c, w = gathered(pieces)
        share = n / len(ords)
        dense, rank = np.zeros(len(ords)), np.zeros(len(ords))
        order = np.lexsort((ords, c))
        dense[order] = (np.arange(len(ords)) + 0.5) * share
        hit = np.flatnonzero(w > 0)
        hit = hit[np.lexsort((ords[hit], -w[hit]))]
        rank[hit] = (np.arange(len(hit)) + 0.5) * share
        dense = np.maximum(dense, 1).astype(np.int64)
        key_f = np.where(w > 0, fused_key(dense, np.maximum(rank, 1), k), fused_key(dense, None, k))
        last = np.lexsort((dense, key_f))
        found = {
            "cosine": places(c[order], ords[order], buckets), "keyword": places(-w[hit], ords[hit], max(1, round(len(hit) * share / size))),
            "fused": places(key_f[last], dense[last], buckets),
        }
        rows = [(key[0].as_py(), by, a.tolist(), b.tolist()) for by, (a, b) in found.items()]
        types = pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], ["qid", "by", "first", "second"])

    pieces = scan.spread(some).select(*scan.COLUMNS).mapInArrow(run, PIECES)
    out: dict[int, dict[str, Marks]] = {q: {by: ([], []) for by in ("cosine", "keyword", "fused")} for q in asked.qids}
    for r in pieces.groupBy("qid").applyInArrow(marks, "qid long, by string, first array<long>, second array<long>").collect():  # a row for each question and ranking
        out[r.qid][r.by] = r.first, r.second
    return out


Bases = dict[tuple[str, int], np.ndarray]  # by ranking and question: how many pairs lie in earlier buckets


def counted(passages: DataFrame, asked: Asked, marks: dict[int, dict[str, Marks]]) -> Bases:
    """How many pairs lie in earlier buckets of the rankings by cosine and by keyword: tasks give counts only."""
    sizes = {(by, q): np.zeros(len(own[by][0]) + 1, np.int64) for q, own in marks.items() for by in ("cosine", "keyword")}
    if any(len(x) > 1 for x in sizes.values()):  # otherwise none lie in earlier ones

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = {key: np.zeros_like(x) for key, x in sizes.items()}
            for ords, cosine, keyword in scored(batches, asked):
                for q, c, w in zip(asked.qids, cosine, keyword, strict=True):
                    order = np.argsort(c, kind="stable")  # ords rise
                    found["cosine", q] += np.diff(cuts(c[order], ords[order], marks[q]["cosine"]))
                    hit = np.flatnonzero(w)
                    hit = hit[np.argsort(-w[hit], kind="stable")]
                    found["keyword", q] += np.diff(cuts(-w[hit], ords[hit], marks[q]["keyword"]))
            rows = [(by, q, b, int(x)) for (by, q), own in found.items() for b, x in enumerate(own)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["by", "qid", "bucket", "n"])

        parts = scan.spread(passages).select(*scan.COLUMNS).mapInArrow(run, "by string, qid long, bucket long, n long")
        for r in parts.groupBy("by", "qid", "bucket").agg(F.sum("n").alias("n")).collect():  # a row for each bucket
            sizes[r.by, r.qid][r.bucket] = r.n
    return {key: np.cumsum(x) - x for key, x in sizes.items()}


def fused_pieces(passages: DataFrame, asked: Asked, marks: dict[int, dict[str, Marks]], bases: Bases, k: int, deal: Callable) -> DataFrame:
    """PIECES of all pairs of the block by ``deal(out, qid, key, dense rank, ord)``: by cosine, from there by keyword score;
    pairs without one keep together as they are."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ords, cosine, keyword in scored(batches, asked):
            out = Dealt()
            for q, c, w in zip(asked.qids, cosine, keyword, strict=True):
                order = np.argsort(c, kind="stable")  # ords rise
                out.cut(q, marks[q]["cosine"], c[order], ords[order], w[order])
            yield out.batch()

    def by_cosine(key: tuple, pieces: pa.Table) -> pa.Table:
        q, bucket = (x.as_py() for x in key)
        c, ords, w = gathered(pieces)
        order = np.lexsort((ords, c))
        dense, ords, w = bases["cosine", q][bucket] + 1 + np.arange(len(order)), ords[order], w[order]
        out, rest, hit = Dealt(), w <= 0, np.flatnonzero(w > 0)
        out.add(q, -1 - bucket, dense[rest], ords[rest])
        hit = hit[np.lexsort((ords[hit], -w[hit]))]
        out.cut(q, marks[q]["keyword"], -w[hit], ords[hit], dense[hit])
        return out.table()

    def by_keyword(key: tuple, pieces: pa.Table) -> pa.Table:
        q, bucket = (x.as_py() for x in key)
        if bucket < 0:
            (dense, ords), rank = gathered(pieces), None
        else:
            w, ords, dense = gathered(pieces)
            order = np.lexsort((ords, w))
            ords, dense, rank = ords[order], dense[order], bases["keyword", q][bucket] + 1 + np.arange(len(order))
        out = Dealt()
        deal(out, q, fused_key(dense, rank, k), dense, ords)
        return out.table()

    pairs = passages.select(*scan.COLUMNS).mapInArrow(run, PIECES)
    return pairs.groupBy("qid", "bucket").applyInArrow(by_cosine, PIECES).groupBy("qid", "bucket").applyInArrow(by_keyword, PIECES)


def to_fused(marks: dict[int, dict[str, Marks]], out: Dealt, q: int, key: np.ndarray, dense: np.ndarray, ords: np.ndarray) -> None:
    """Pairs of a question by fused score."""
    order = np.lexsort((dense, key))
    out.cut(q, marks[q]["fused"], key[order], dense[order], ords[order])


def to_slices(starts: Marks, out: Dealt, q: int, key: np.ndarray, dense: np.ndarray, ords: np.ndarray) -> None:
    """Pairs of a question by slice."""
    order = np.argsort(ords)
    out.cut(q, starts, ords[order], np.zeros(len(ords), np.int64), key[order], dense[order])


def placed(tables: Tables, name: str, give: Callable, schema: str) -> DataFrame:
    """``give(qid, key, dense rank, ord, rank)`` of the pieces in table ``name``, sorted by fused score, ties in dense order."""
    pieces = tables.spark.read.schema(PIECES).parquet(tables.path(name))
    sizes = pieces.groupBy("qid", "bucket").agg(F.sum("n").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("qid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = tables.keep(sizes.select("qid", "bucket", before.alias("base")), f"{name}-shifts")

    def run(key: tuple, own: pa.Table) -> pa.Table:
        f, dense, ords = gathered(own)
        order = np.lexsort((dense, f))
        return give(key[0].as_py(), f[order], dense[order], ords[order], own["base"][0].as_py() + 1 + np.arange(len(order)))

    return pieces.join(shifts, ["qid", "bucket"]).groupBy("qid", "bucket").applyInArrow(run, schema)


def ranking(tables: Tables, name: str) -> DataFrame:
    """(qid, ord, dense_rank, fused, rank) from the pieces in table ``name``."""

    def give(q: int, f: np.ndarray, dense: np.ndarray, ords: np.ndarray, rank: np.ndarray) -> pa.Table:
        return pa.table([np.full(len(f), q, np.int64), ords, dense, -f / 10.0**FUSED_DIGITS, rank], ["qid", "ord", "dense_rank", "fused", "rank"])

    return placed(tables, name, give, "qid long, ord long, dense_rank long, fused double, rank long")


class Slices:
    """The pages of ``chunks(ord, source, page)``, whose ords follow each other, in slices of about SLICE passages."""

    def __init__(self, chunks: DataFrame, tables: Tables) -> None:
        self.types = {name: kind for name, kind in chunks.dtypes if name in ("source", "page")}
        self.pages = tables.keep(chunks.groupBy("source", "page").agg(F.min("ord").alias("ord")).withColumn("_s", F.floor(F.col("ord") / SLICE)), "pages")
        starts = sorted(r.ord for r in self.pages.groupBy("_s").agg(F.min("ord").alias("ord")).collect())  # one for each slice
        self.starts: Marks = starts[1:], [0] * len(starts[1:])
        first = np.array(starts)

        def names(own: pa.Table) -> pa.Table:
            own = own.select(["ord", "source", "page"]).sort_by("ord").combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
                to.write_table(own)
            at = int(np.searchsorted(first, own["ord"][0].as_py(), "right")) - 1
            return pa.table([pa.array([at], pa.int32()), pa.array([-1], pa.int32()), pa.array([sink.getvalue().to_pybytes()])], ["bucket", "n", "data"])

        self.names = tables.keep(self.pages.groupBy("_s").applyInArrow(names, "bucket int, n int, data binary"), "names")

    def beside(self, pieces: DataFrame, qids: DataFrame) -> DataFrame:
        """``pieces`` by slice, with the pages of each slice for each question."""
        return pieces.unionByName(self.names.crossJoin(qids))


def slice_of(pieces: pa.Table) -> tuple[list[np.ndarray], pa.Table]:
    """The columns of a slice's pieces in the order of the first, and its pages; for each row the page's place comes last."""
    n = pieces["n"].to_numpy()
    pages = pa.ipc.open_stream(pieces["data"][int(np.flatnonzero(n < 0)[0])].as_py()).read_all()
    columns = gathered(pieces.filter(pa.array(n > 0)))
    if not columns:
        return [], pages
    order = np.argsort(columns[0])
    columns = [x[order] for x in columns]
    return [*columns, np.searchsorted(pages["ord"].to_numpy(), columns[0], "right") - 1], pages


def first_of_pages(pieces: DataFrame, marks: dict[int, dict[str, Marks]]) -> DataFrame:
    """PIECES by fused score of each page's first, from pieces by slice."""

    def run(key: tuple, own: pa.Table) -> pa.Table:
        columns, _ = slice_of(own)
        out, q = Dealt(), key[0].as_py()
        if columns:
            ords, _, f, dense, page = columns
            order = np.lexsort((dense, f, page))
            first = order[np.flatnonzero(np.diff(page[order], prepend=-1))]
            to_fused(marks, out, q, f[first], dense[first], ords[first])
        return out.table()

    return pieces.groupBy("qid", "bucket").applyInArrow(run, PIECES)


def paged(tables: Tables, name: str, slices: Slices) -> DataFrame:
    """(qid, rank, ord, source, page) from the pieces in table ``name``: ranks go back to the pages by slice."""
    starts = slices.starts

    def give(q: int, f: np.ndarray, dense: np.ndarray, ords: np.ndarray, rank: np.ndarray) -> pa.Table:
        order, out = np.argsort(ords), Dealt()
        out.cut(q, starts, ords[order], np.zeros(len(ords), np.int64), rank[order])
        return out.table()

    def run(key: tuple, own: pa.Table) -> pa.Table:
        columns, pages = slice_of(own)
        ords, _, rank, page = columns or [np.zeros(0, np.int64)] * 4
        at = pages.select(["source", "page"]).take(pa.array(page))
        return pa.table([np.full(len(ords), key[0].as_py(), np.int64), rank, ords, at["source"], at["page"]], ["qid", "rank", "ord", "source", "page"])

    qids = tables.spark.read.schema(PIECES).parquet(tables.path(name)).select("qid").distinct()
    pieces = slices.beside(placed(tables, name, give, PIECES), qids)
    schema = f"qid long, rank long, ord long, source {slices.types['source']}, page {slices.types['page']}"
    return pieces.groupBy("qid", "bucket").applyInArrow(run, schema)
