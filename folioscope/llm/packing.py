"""Best-fit packing of token sequences (operator 9), by hierarchical residual packing.

Each document becomes its token ids and an end id; only one longer than a sequence is cut, so that
every piece but the first is full. Partitions pack their pieces best-fit, largest first. Bins that are
nearly full go out at once; the others enter the next round as single items whose size is what they
hold, with fewer and fewer partitions, until one partition of bounded size remains or a round no
longer merges bins. Every piece is placed exactly once.

Cases: a null or empty text is the end id alone. Equal documents are packed separately. Texts of any
length are tokenized whole. Extra columns are ignored. An empty table gives an empty result. A null id
stays null, and rows that share an id are packed each.
"""

from __future__ import annotations

import contextlib
import json
import os
import zlib
from bisect import insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import Workspace

MAX_TOKENS = 2048
END_ID = 0
NEARLY_FULL = 2040
ITEMS_PER_TASK = 40_000
FAN_IN = 8
PIECE = np.dtype([("doc_id", "<i8"), ("unnamed", "?"), ("piece", "<i4"), ("start", "<i8"), ("length", "<i4"), ("crc", "<u4")])


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones stand for themselves,
    the others, in order, for the code points from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Ids of a text, as ``tokenizers`` gives them for the vocabulary file at ``path``.

    If the file is a plain byte-level vocabulary whose ids rise in the order of its merges, the ids as
    merge ranks give the same result, and ``tiktoken`` applies them several times faster. Texts with a
    special token's string, those its regular expressions give up on (several 100,000 white-space characters
    in a row), and any other kind of file, go through ``tokenizers`` itself.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.fast = self._ranks(path)

    def _ranks(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        before = file.get("pre_tokenizer") or {}
        if file.get("normalizer") or file["model"]["type"] != "BPE" or any(before.get(k) != v for k, v in plain.items()):
            return None
        vocabulary, merges = file["model"]["vocab"], file["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        ids = [vocabulary[a + b] for a, b in pairs]
        if ids != sorted(ids):
            return None
        letters = byte_letters()
        made = {a + b for a, b in pairs}
        ranks = {bytes(letters[c] for c in w): i for w, i in vocabulary.items() if (len(w) == 1 or w in made) and w not in self.special}
        if sorted(ranks.values()) != list(range(len(ranks))):
            return None
        return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.fast is not None and not any(s in text for s in self.special):  # their strings cut words differently
            with contextlib.suppress(ValueError):
                return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), "<u4")
        return np.asarray(self.model.encode(text, add_special_tokens=False).ids, "<u4")


def cut(ids: np.ndarray, most: int = MAX_TOKENS) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids: the first piece takes what doesn't fill one."""
    n, at, k = len(ids), 0, 0
    first = n % most or most
    while at < n:
        end = at + (first if k == 0 else most)
        yield k, at, end - at, zlib.crc32(ids[at:end].tobytes())
        at, k = end, k + 1


def best_fit(sizes: np.ndarray, most: int = MAX_TOKENS) -> list[list[int]]:
    """Bins of item numbers: items in falling size, each into the fullest bin that still takes it."""
    open_bins: list[list[list[int]]] = [[] for _ in range(most + 1)]  # by space left
    spaces: list[int] = []  # those with an open bin, rising
    bins: list[list[int]] = []
    for i in np.argsort(-sizes, kind="stable"):
        need = int(sizes[i])
        lo, hi = 0, len(spaces)
        while lo < hi:
            mid = (lo + hi) // 2
            if spaces[mid] < need:
                lo = mid + 1
            else:
                hi = mid
        if lo < len(spaces):
            space = spaces[lo]
            b = open_bins[space].pop()
            if not open_bins[space]:
                spaces.pop(lo)
            b.append(int(i))
        else:
            space, b = most, [int(i)]
            bins.append(b)
        left = space - need
        if left:
            if not open_bins[left]:
                insort(spaces, left)
            open_bins[left].append(b)
    return bins


ITEM = "sequence long, size int, full boolean, members binary"


def _items(rows: list[tuple[int, int, bool, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["sequence", "size", "full", "members"])


def _packed(sizes: list[int], members: list[bytes], level: int, first: int) -> Iterator[pa.RecordBatch]:
    """One round over the items of a task; sequence numbers hold level, partition and a counter."""
    base = (level << 56) | (TaskContext.get().partitionId() << 32) | first
    arr, out = np.asarray(sizes, np.int64), []
    for k, b in enumerate(best_fit(arr)):
        size = int(arr[b].sum())
        out.append((base + k, size, size >= NEARLY_FULL, b"".join(members[i] for i in b)))
        if len(out) == 5000:
            yield _items(out)
            out = []
    if out:
        yield _items(out)


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs(doc_id, text)`` to doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    The tokenizer file is read by the workers from ``path``. A task holds at most ``ITEMS_PER_TASK``
    items at a time in the first round, and about as many in later ones.
    """
    spark, path = docs.sparkSession, path or tokenizer_path()
    ws = Workspace(spark, "packing")

    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, held, ready, seen = Encoder(path), [], [], 0
        end = np.array([END_ID], "<u4")
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for k, at, n, crc in cut(np.concatenate([encoder.encode(text.as_py() or ""), end])):
                    row = np.array([(i or 0, i is None, k, at, n, crc)], PIECE).tobytes()
                    (ready if n == MAX_TOKENS else held).append((n, row))
            if len(held) + len(ready) >= ITEMS_PER_TASK:
                yield from _packed([n for n, _ in held + ready], [r for _, r in held + ready], 0, seen)
                seen += len(held) + len(ready)
                held, ready = [], []
        if held or ready:
            yield from _packed([n for n, _ in held + ready], [r for _, r in held + ready], 0, seen)

    done, level = [], 0
    items = ws.keep(docs.select("doc_id", "text").mapInArrow(first, ITEM), "round0")
    tasks = docs.rdd.getNumPartitions()
    while True:
        done.append(items.where("full"))
        rest = items.where("not full")
        n = rest.count()
        last = n < 2 or level > 0 and tasks == 1  # a single task of the first round may have packed several chunks
        before, tasks = tasks, max(1, -(-tasks // FAN_IN), -(-n // ITEMS_PER_TASK))
        if last:
            done.append(rest)
            break
        level += 1

        def merge(batches: Iterable[pa.RecordBatch], level: int = level) -> Iterator[pa.RecordBatch]:
            sizes, members, seen = [], [], 0
            for b in batches:
                sizes += b.column(0).to_pylist()
                members += b.column(1).to_pylist()
                if len(sizes) >= 4 * ITEMS_PER_TASK:
                    yield from _packed(sizes, members, level, seen)
                    seen += len(sizes)
                    sizes, members = [], []
            if sizes:
                yield from _packed(sizes, members, level, seen)

        merged = ws.keep(rest.select("size", "members").repartition(tasks).mapInArrow(merge, ITEM), f"round{level}")
        left = merged.count()
        stuck = left == n or left > 0.999 * n and tasks == before
        items = merged
        if stuck:  # what is left doesn't fit together any better, and would not meet in fewer tasks
            done += [items.where("full"), items.where("not full")]
            break
    bins = done[0]
    for d in done[1:]:
        bins = bins.unionByName(d)

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs = b.column(1).to_pylist()
            if not blobs:
                continue
            each = [np.frombuffer(x, PIECE) for x in blobs]
            counts = [len(x) for x in each]
            rows = np.concatenate(each)
            offset = np.concatenate([np.cumsum(x["length"], dtype=np.int64) - x["length"] for x in each])
            ids = pa.array(np.ascontiguousarray(rows["doc_id"]), mask=rows["unnamed"])
            cols = [rows["piece"], rows["start"], rows["length"].astype(np.int64), rows["crc"].astype(np.int64), np.repeat(b.column(0).to_numpy(), counts), offset]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(np.ascontiguousarray(c)) for c in cols)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return bins.select("sequence", "members").mapInArrow(
        spread, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
