"""Exact repeated passages by a depth-limited radix sort of suffixes (operator 6).

Every suffix is ordered by its first ``length`` bytes only, and equal groups are exactly the repeated
windows. The order of the digits is free as long as it is the same for all, so the most significant
digit is the one that splits best: the fingerprint of the window's minimizer (its ``GRAM``-byte piece of
least hash, leftmost among equals), which neighbouring windows share. The digits after it are the window's bytes.

Pass 1, first digit: runs of neighbouring windows with one minimizer travel as one item, about one for
35 bytes. Items are dealt by minimizer. An item that equals an earlier one is a repeat as a whole; a
minimizer with one distinct item is done, as its windows occur nowhere else.
Pass 2, remaining digits: items whose minimizer has several distinct items are dealt by it once more, now
with their bytes, and split into windows there, which are ordered by eight bytes at a time, the outermost first
(``byte_groups``). A group of one is done, and so is one whose digits are all equal but for the bytes still to
be compared. All but the first of an equal group are repeats.

Scale: each task drops the repeats it sees itself before anything is dealt out, so a passage in a third
of all rows sends one item from a task. A minimizer with many distinct items in a task leaves a mark;
what belongs to marked minimizers is split into windows at once and dealt by window, so no minimizer
gathers more than ``HOT`` items from a task. Windows are equal if their bytes are; only whole items, and windows of
marked minimizers, which travel without bytes, are told apart by 128 bits of hashes, so with a chance of error
that is below 2**-60 for 2**34 of them.

Cases: a null text is empty; texts shorter than ``length`` have no window and are kept. Repeated texts
lose every byte but in the document of smallest id. Matches never cross documents; overlaps within one
document count. Ids of any sign are ordered as numbers. Texts of any length are treated whole. Extra columns are ignored. An empty table gives
an empty result. Rows with a null id are kept whole and take no part. Rows that share an id count as one
place: none is a repeat of another at the same start, and spans found in either are cut from both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, mix64

GRAM = 32
HOT = 16
BUFFER = 1 << 17  # bytes hashed at a time, so that arrays stay in a core's cache
FLUSH = 1_500_000  # items a task sorts at a time
ITEM = "kind byte, anchor long, digest long, doc_id long, start long, n int"
ITEM_KIND, REPEAT, SPLIT, MARK, HOT_SPLIT = range(5)


def _digits(seed: int) -> np.ndarray:
    return mix64(np.arange(256, dtype=np.uint64) + np.uint64(seed))


def _join(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = x * np.uint64(0x9E3779B97F4A7C15)
        z += y
        z ^= z >> np.uint64(29)
    return z


def power_hashes(data: np.ndarray, length: int, seed: int = 1) -> dict[int, np.ndarray]:
    """Hashes of all pieces of 1, 2, 4, ... bytes, up to what ``hash_at`` needs for ``length``."""
    have = {1: _digits(seed)[data]}
    size = 1
    while 2 * size <= max(length, GRAM):
        h = have[size]
        have[2 * size] = _join(h[:-size], h[size:]) if len(h) > size else h[:0]
        size *= 2
    return have


def hash_at(have: dict[int, np.ndarray], at: np.ndarray | slice, length: int) -> np.ndarray:
    """Hashes of the pieces of ``length`` bytes at the places ``at``."""
    parts = [s for s in sorted(have, reverse=True) if length & s]
    move = (lambda k: slice(at.start + k, at.stop + k)) if isinstance(at, slice) else (lambda k: at + k)
    h, done = have[parts[0]][move(0)], parts[0]
    for p in parts[1:]:
        h = _join(h, have[p][move(done)])
        done += p
    return mix64(h)


def window_hashes(data: np.ndarray, length: int, seed: int = 1) -> np.ndarray:
    return hash_at(power_hashes(data, length, seed), slice(0, max(0, len(data) - length + 1)), length)


def minimizers(h: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` entries, the position of its least (leftmost among equals)."""
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    size, m = 1, key
    while 2 * size <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    total = len(h) - width + 1
    m = np.minimum(m[:total], m[width - size : width - size + total])
    return (m & np.uint64(0xFFFFFFFF)).astype(np.int64)


def buffers(ids: list[int], texts: Iterable[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, whether a window starts, its document, start within the document) of texts laid end to end;
    long texts are cut so that each of their windows comes once."""
    held, size = [], 0
    for i, t in zip(ids, texts, strict=True):
        for at in range(0, max(0, len(t) - length + 1), BUFFER):
            piece = np.frombuffer(t, np.uint8, min(len(t) - at, BUFFER + length - 1), at)
            n = len(piece)
            held.append((piece, np.arange(n) <= n - length, np.full(n, i, np.int64), np.arange(at, at + n)))
            size += n
            if size >= BUFFER:
                yield tuple(np.concatenate(c) for c in zip(*held, strict=True))
                held, size = [], 0
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


def items_of(data: np.ndarray, valid: np.ndarray, owner: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(anchor, digest, doc_id, start, n) of the runs of neighbouring windows with one minimizer."""
    have = power_hashes(data, length)
    grams = have[GRAM] * np.uint64(0xD6E8FEB86659FD93)
    grams ^= grams >> np.uint64(32)
    total = len(data) - length + 1
    at = np.flatnonzero(valid[:total])
    anchor = minimizers(grams, length - GRAM + 1)[at]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (np.diff(anchor) != 0) | (np.diff(owner[at]) != 0)
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(at)))
    lo, a = at[first], anchor[first]
    with np.errstate(over="ignore"):
        where = (a - lo).astype(np.uint64) * np.uint64(1 << 20) + n.astype(np.uint64)
        digest = mix64(_join(_join(hash_at(have, lo, length), hash_at(have, lo + n - 1, length)), where))
    return mix64(have[GRAM][a]).view(np.int64), digest.view(np.int64), owner[lo], start[lo], n


def _batch(kind: np.ndarray | int, *cols: np.ndarray) -> Iterator[pa.RecordBatch]:
    names = ["kind", "anchor", "digest", "doc_id", "start", "n"]
    kind = np.full(len(cols[0]), kind, np.int8) if isinstance(kind, int) else kind.astype(np.int8)
    cols = (kind, *cols[:4], cols[4].astype(np.int32))
    for at in range(0, len(kind), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c[at : at + 50_000])) for c in cols], names)


def _runs(doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with those that touch or overlap in one document joined."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], (start + n)[order]
    if not len(doc):
        return doc, start, end
    gap = np.ones(len(doc), bool)
    block = np.cumsum(np.concatenate([[True], np.diff(doc) != 0]))
    reach = np.maximum.accumulate(end + (block << np.int64(40))) - (block << np.int64(40))
    gap[1:] = (np.diff(doc) != 0) | (start[1:] > reach[:-1])
    first = np.flatnonzero(gap)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], start[first], reach[last] - start[first]


def _later(first: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which rows of sorted groups come at a later place than their group's first row."""
    head = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
    return ~first & ((doc != doc[head]) | (start != start[head]))


def _spread(doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Keys that deal rows evenly."""
    return mix64((doc * 1_000_003 + start).view(np.uint64)).view(np.int64)


def local_pass(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """What a task sends on of its own items: repeats, first items, and those of hot minimizers."""
    anchor, digest, doc, start, n = (np.concatenate(c) for c in zip(*held, strict=True))
    # A sort by half of either digest, after one by place: groups may come apart where halves collide,
    # which only sends more on, as pass 1 settles all items again.
    halves = (anchor.view(np.uint64) & np.uint64(0xFFFFFFFF00000000)) | (digest.view(np.uint64) >> np.uint64(32))
    order = np.lexsort((start, doc))
    order = order[np.argsort(halves[order], kind="stable")]
    anchor, digest, doc, start, n = (c[order] for c in (anchor, digest, doc, start, n))
    other = np.ones(len(anchor), bool)
    other[1:] = np.diff(anchor) != 0
    first = other.copy()
    first[1:] |= np.diff(digest) != 0
    late = _later(first, doc, start)
    again = _runs(doc[late], start[late], n[late])
    yield from _batch(REPEAT, _spread(again[0], again[1]), again[0], *again)
    group = np.cumsum(other) - 1
    hot = np.bincount(group, weights=first)[group] >= HOT
    send, split = first & ~hot, first & hot
    yield from _batch(ITEM_KIND, anchor[send], digest[send], doc[send], start[send], n[send])
    parts = _runs(doc[split], start[split], n[split])
    yield from _batch(HOT_SPLIT, _spread(parts[0], parts[1]), parts[0], *parts)
    marks = anchor[other & hot]
    yield from _batch(MARK, marks, marks * 0, marks * 0, marks * 0, marks * 0)


def first_pass(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0
        for b in batches:
            texts = (t.as_buffer().to_pybytes() for t in b.column(1))
            for buf in buffers(b.column(0).to_pylist(), texts, length):
                held.append(items_of(*buf, length))
                rows += len(held[-1][0])
                if rows >= FLUSH:
                    yield from local_pass(held)
                    held, rows = [], 0
        if held:
            yield from local_pass(held)

    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select("doc_id", body.alias("body")).where(F.octet_length("body") >= length).mapInArrow(run, ITEM)


def _groups(batches: Iterable[pa.RecordBatch], key: str, least: int = 200_000) -> Iterator[list[np.ndarray]]:
    """Columns of a partition sorted by ``key``, in parts that never cut a group of equal keys."""
    held: list[list[np.ndarray]] = []
    rows = 0
    for b in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
        rows += b.num_rows
        if rows >= least:
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            k = cols[b.schema.names.index(key)]
            cut = int(np.searchsorted(k, k[-1]))
            if cut:
                yield [c[:cut] for c in cols]
            held, rows = [[c[cut:] for c in cols]], len(k) - cut
    if rows:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


SETTLED = "kind byte, anchor long, doc_id long, start long, n int"


def settle_items(items: DataFrame) -> DataFrame:
    """What the first digit leaves, from the items of all tasks: REPEAT and HOT_SPLIT runs, SPLIT items."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, anchor, digest, doc, start, n in _groups(batches, "anchor"):
            ready = (kind == REPEAT) | (kind == HOT_SPLIT)
            yield from out(kind[ready], *(c[ready] for c in (anchor, doc, start, n)))
            kind, anchor, digest, doc, start, n = (c[~ready] for c in (kind, anchor, digest, doc, start, n))
            if not len(kind):
                continue
            order = np.lexsort((start, doc, digest, kind, anchor))
            kind, anchor, digest, doc, start, n = (c[order] for c in (kind, anchor, digest, doc, start, n))
            other = np.ones(len(anchor), bool)
            other[1:] = np.diff(anchor) != 0
            first = other.copy()
            first[1:] |= (np.diff(digest) != 0) | (np.diff(kind) != 0)
            group = np.cumsum(other) - 1
            marked = np.bincount(group, weights=kind == MARK)[group] > 0
            several = np.bincount(group, weights=first)[group] > 1
            item = kind == ITEM_KIND
            for what, rows in ((REPEAT, item & _later(first, doc, start)), (HOT_SPLIT, item & first & marked)):
                got = _runs(doc[rows], start[rows], n[rows])
                yield from out(what, got[0], *got)
            rows = item & first & several & ~marked
            yield from out(SPLIT, anchor[rows], doc[rows], start[rows], n[rows])

    def out(kind, anchor, doc, start, n) -> Iterator[pa.RecordBatch]:
        yield from (b.select(["kind", "anchor", "doc_id", "start", "n"]) for b in _batch(kind, anchor, anchor, doc, start, n))

    return items.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, SETTLED)


PIECE = "kind byte, key long, w2 long, doc_id long, start long, n int, body binary"


def _pieces(kind: int, key: np.ndarray, w2: np.ndarray, doc: np.ndarray, start: np.ndarray, n: np.ndarray, body: list[bytes] | None = None) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(key), 20_000):
        cut = slice(at, at + 20_000)
        m = len(key[cut])
        cols = [np.full(m, kind, np.int8), key[cut], w2[cut], doc[cut], start[cut], n[cut].astype(np.int32)]
        blob = pa.array(body[cut], pa.binary()) if body is not None else pa.nulls(m, pa.binary())
        yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(c)) for c in cols), blob], ["kind", "key", "w2", "doc_id", "start", "n", "body"])


def _hot_windows(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """Windows of marked minimizers: the repeats a task sees itself, and the first of each kind."""
    w1, w2, doc, start = (np.concatenate(c) for c in zip(*held, strict=True))
    order = np.lexsort((start, doc, w2, w1))
    w1, w2, doc, start = (c[order] for c in (w1, w2, doc, start))
    first = np.ones(len(w1), bool)
    first[1:] = (np.diff(w1) != 0) | (np.diff(w2) != 0)
    late = _later(first, doc, start)
    again = _runs(doc[late], start[late], np.ones(late.sum(), np.int64))
    yield from _pieces(REPEAT, _spread(again[0], again[1]), again[0] * 0, *again)
    yield from _pieces(HOT_SPLIT, w1[first], w2[first], doc[first], start[first], np.ones(first.sum(), np.int64))


def cut_items(docs: DataFrame, settled: DataFrame, length: int) -> DataFrame:
    """PIECE rows: the bytes of SPLIT items, by minimizer, and the windows of HOT_SPLIT runs, by window."""
    by_doc = settled.where(F.col("kind") != REPEAT).groupBy("doc_id").agg(F.collect_list(F.struct("kind", "anchor", "start", "n")).alias("runs"))
    body = docs.select("doc_id", F.col("text").cast("binary").alias("body"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                keys, docs_, starts, counts, blobs = [], [], [], [], []
                for i, t, runs in zip(part.column(0).to_pylist(), part.column(1), part.column(2), strict=True):
                    t = t.as_buffer().to_pybytes()
                    kind, anchor, s, n = (runs.values.field(k).to_numpy() for k in range(4))
                    plain = kind == SPLIT
                    keys.append(anchor[plain])
                    starts.append(s[plain])
                    counts.append(n[plain])
                    docs_.append(np.full(plain.sum(), i))
                    blobs += [t[a : a + m + length - 1] for a, m in zip(s[plain].tolist(), n[plain].tolist(), strict=True)]
                    _, s, n = _runs(np.zeros((~plain).sum(), np.int64), s[~plain], n[~plain].astype(np.int64))
                    for at, count in zip(s.tolist(), n.tolist(), strict=True):
                        for k in range(at, at + count, BUFFER):
                            m = min(BUFFER, at + count - k)
                            piece = np.frombuffer(t, np.uint8, m + length - 1, k)
                            held.append((window_hashes(piece, length, 2).view(np.int64), window_hashes(piece, length, 3).view(np.int64), np.full(m, i), np.arange(k, k + m)))
                            rows += m
                key, doc, start, n = (np.concatenate(c) for c in (keys, docs_, starts, counts))
                yield from _pieces(SPLIT, key, key * 0, doc, start, n, blobs)
                if rows >= FLUSH:
                    yield from _hot_windows(held)
                    held, rows = [], 0
        if held:
            yield from _hot_windows(held)

    return body.join(by_doc, "doc_id").select("doc_id", "body", "runs").mapInArrow(run, PIECE)


def byte_groups(data: np.ndarray, place: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Orders the windows of ``length`` bytes at ``place`` by ``group`` and then by their bytes, eight at a time, most
    significant digits first: (numbers of the windows that equal another, whether one starts an equal
    group). Windows that are equal keep their order."""
    digits = np.ndarray((len(data) - 7,), ">u8", data, 0, (1,))
    offsets = [0, length - 8, *range(8, length - 8, 8)]

    def digit(rows: np.ndarray, offset: int) -> np.ndarray:
        return digits[place[rows] + offset].astype(np.uint64)

    def several(new: np.ndarray) -> np.ndarray:
        """Which rows are in groups of two and more."""
        return ~(new & np.append(new[1:], True))

    rows = np.argsort(group.astype(np.uint16 if group.max(initial=0) < 1 << 16 else np.int64), kind="stable")
    new = np.ones(len(rows), bool)
    new[1:] = group[rows[1:]] != group[rows[:-1]]
    for offset in offsets:
        keep = several(new)
        rows, new = rows[keep], new[keep]
        if not len(rows):
            break
        x = digit(rows, offset)
        differ = np.zeros(len(rows), bool)
        differ[1:] = (x[1:] != x[:-1]) & ~new[1:]
        if not differ.any():
            continue
        number = np.cumsum(new) - 1
        mixed = np.zeros(number[-1] + 1, bool)
        mixed[number[differ]] = True
        some = np.flatnonzero(mixed[number])
        order = some[np.lexsort((x[some], number[some]))]
        rows[some], x[some] = rows[order], x[order]
        new[1:] |= x[1:] != x[:-1]
    keep = several(new)
    return rows[keep], new[keep]


def _repeats_in(key: np.ndarray, doc: np.ndarray, start: np.ndarray, n: np.ndarray, body: pa.Array, length: int) -> tuple[np.ndarray, ...]:
    """Runs of repeated windows among items; ``key`` names their minimizers, all of whose items are here."""
    order = np.lexsort((start, doc))
    data = np.frombuffer(b"".join(body.take(pa.array(order)).to_pylist()), np.uint8)
    doc, start, n = doc[order], start[order], n[order].astype(np.int64)
    sizes = n + length - 1
    first = np.cumsum(sizes) - sizes
    item = np.repeat(np.arange(len(order)), n)
    within = np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
    group = np.unique(key[order], return_inverse=True)[1]
    # Windows come in order of place, so the first of equals is the earliest.
    rows, new = byte_groups(data, first[item] + within, group[item], length)
    owner, at = doc[item[rows]], (start[item] + within)[rows]
    again = _later(new, owner, at)
    return _runs(owner[again], at[again], np.ones(int(again.sum()), np.int64))


def settle_pieces(pieces: DataFrame, length: int) -> DataFrame:
    """(doc_id, start, n): runs of repeated windows, from the pieces of all tasks."""

    def groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= 10_000:
                whole = pa.Table.from_batches(held).combine_chunks()
                k = whole.column("key").to_numpy()
                cut = int(np.searchsorted(k, k[-1]))
                if cut:
                    yield whole.slice(0, cut)
                held, rows = whole.slice(cut).to_batches(), len(k) - cut
        if rows:
            yield pa.Table.from_batches(held)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches):
            kind, key, w2, doc, start, n = (t.column(k).to_numpy() for k in range(6))
            rows = np.flatnonzero(kind == HOT_SPLIT)
            rows = rows[np.lexsort((start[rows], doc[rows], w2[rows], key[rows]))]
            first = np.ones(len(rows), bool)
            first[1:] = (np.diff(key[rows]) != 0) | (np.diff(w2[rows]) != 0)
            take = np.concatenate([rows[_later(first, doc[rows], start[rows])], np.flatnonzero(kind == REPEAT)])
            parts = [(doc[take], start[take], n[take].astype(np.int64))]
            rows = np.flatnonzero(kind == SPLIT)
            if len(rows):
                body = t.column(6).combine_chunks().take(pa.array(rows))
                body = body.combine_chunks() if isinstance(body, pa.ChunkedArray) else body
                parts.append(_repeats_in(key[rows], doc[rows], start[rows], n[rows], body, length))
            got = _runs(*(np.concatenate(c) for c in zip(*parts, strict=True)))
            yield from (b.select(["doc_id", "start", "n"]) for b in _batch(REPEAT, got[0], got[0], *got))

    return pieces.repartition("key").sortWithinPartitions("key").mapInArrow(run, "doc_id long, start long, n int")


def repeated_spans(docs: DataFrame, ws: Workspace, length: int = 100) -> DataFrame:
    """(doc_id, start, n): runs of n window starts whose windows also start earlier."""
    settled = ws.keep(settle_items(first_pass(docs, length)), "settled")
    ws.release()
    again = settled.where(F.col("kind") == REPEAT).select("doc_id", "start", "n")
    more = ws.keep(settle_pieces(cut_items(docs, settled, length), length), "windows")
    ws.release()
    return again.unionByName(more)


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """``docs(doc_id, text)`` to doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes that stay)."""
    ws = Workspace(docs.sparkSession, "suffixes")
    spans = repeated_spans(docs.where("doc_id is not null"), ws, length).groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    body = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                rows = []
                for t, runs in zip(part.column(1), part.column(2), strict=True):
                    t = t.as_buffer().to_pybytes()
                    if not runs.is_valid:
                        rows.append((len(t), 0, 0, hashlib.sha256(t).hexdigest(), t))
                        continue
                    s, n = (runs.values.field(k).to_numpy().astype(np.int64) for k in (0, 1))
                    _, s, n = _runs(np.zeros(len(s), np.int64), s, n + length - 1)
                    kept, at = [], 0
                    for a, m in zip(s.tolist(), n.tolist(), strict=True):
                        kept.append(t[at:a])
                        at = a + m
                    kept.append(t[at:])
                    left = b"".join(kept)
                    rows.append((len(t), int(n.sum()), len(s), hashlib.sha256(left).hexdigest(), left))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return body.join(spans, "doc_id", "left").select("doc_id", "body", "runs").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
