"""Benchmark decontamination (operator 5): rare n-gram seeds, then Smith-Waterman alignment.

Seeds are the runs of three words of each test item, of two words for items of four or five, since one
change can break every longer run there. One scan of the corpus writes down which seeds each document
holds. Of each item the rarest seeds, by the number of different texts that hold them, are joined with
these: a copy at the similarity keeps at least ``distinct_kept`` of an item's seeds, so that it meets a fixed number
of the rare ones (``rare_seeds``). The documents of these pairs are read again, and every part with enough of
an item's seeds is aligned with it word by word (match 2, mismatch -1, gap -1). An alignment's similarity is
its matched words divided by the words of the item and those put in between them in the passage; that of a pair
is the highest among the best-scoring alignments that end at each word.

Scale: the benchmark is never collected. The scan's tasks hold a bitmap of its seeds of at most 2**26 bits;
what a fuller bitmap lets through falls out in the join. Equal texts are worked off once, by digest, so a copy
in a third of all rows is one pair. Only seeds and digests of documents are exchanged, and the texts of the pairs,
which a bitmap of their digests, of the same bound, picks out where they are read. An
alignment takes memory in proportion to the passage, not to the passage times the item.

Cases: words are runs of letters, digits and underscores, in lower case. Null and empty texts have none.
Items of fewer than three words, and items without an id, match nothing. Repeated items and rows are
matched each; rows or items that share an id give one row for each pair of ids. Documents and items of any
length are searched whole. A document without a copy gives no row; one without an id gives rows with a null id.
Extra columns are ignored. Empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, mix64, run_hashes

SIMILARITY = 0.8
MOST_FILTER_BITS = 26
MATCH, MISMATCH, GAP = 2, -1, -1
FOUND = "doc_id long, item_id long, similarity double, score int, first_word int, end_word int"

words_of = re.compile(r"\w+").findall


def seed_words(n_words: int) -> int:
    """The length of the seeds of an item of ``n_words`` words."""
    return 2 if n_words in (4, 5) else 3


def seeds_kept(n_words: int, similarity: float = SIMILARITY) -> int:
    """Seeds that a copy of an item of ``n_words`` words keeps at least: up to (1 / similarity - 1) of the
    words may be changed, left out or put in, and each such place breaks at most as many seeds as one has
    words. (At eight words two places are only possible for words put in, which leave a run of three.)"""
    width, breaks = seed_words(n_words), int(n_words * (1 / similarity - 1) + 1e-9)
    return max(1, n_words - width + 1 - width * breaks)


def distinct_kept(seeds: list[int], n_words: int, similarity: float = SIMILARITY) -> int:
    """Distinct seeds that such a copy keeps at least. A seed is lost only with all its occurrences, so
    most are lost where the breaks meet the least repeated ones."""
    times = sorted(Counter(seeds).values())
    broken, lost = len(seeds) - seeds_kept(n_words, similarity), 0
    for n in times:
        broken -= n
        if broken < 0:
            break
        lost += 1
    return max(1, len(times) - lost)


@lru_cache(1)
def _word_codes() -> np.ndarray:
    """Which code points of the first plane belong to words."""
    return np.array([chr(c).isalnum() or c == 95 for c in range(1 << 16)])


def word_hashes(lowered: str) -> np.ndarray:
    """Hashes of the words of a text in lower case, the same words that ``words_of`` finds."""
    codes = np.frombuffer(lowered.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = _word_codes()[np.minimum(codes, 0xFFFF)]
    for c in np.unique(codes[codes > 0xFFFF]).tolist():
        inside[codes == c] = chr(c).isalnum()
    return run_hashes(codes, inside)


def seed_hashes(w: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words, from the words' own."""
    if len(w) < width:
        return np.zeros(0, np.int64)
    h = np.full(len(w) - width + 1, width, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            h += w[k : k + len(h)] * np.uint64(0x9E3779B97F4A7C15 + (k << 20))
    return mix64(h).view(np.int64)


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64)))


def items_of(benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """item_id, item (a digest of its words), words, width, seeds (distinct), need and wanted: how many of all
    its distinct seeds, and of its rare ones, a copy keeps. Items that can be matched only."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, seeds = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = words_of((t or "").lower())
                if len(words) < 3:
                    continue
                width = seed_words(len(words))
                s = seed_hashes(word_hashes(" ".join(words)), width)
                need = distinct_kept(s.tolist(), len(words), similarity)
                seeds.append(np.unique(s))
                rows.append((i, xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass")), words, width, need, max(1, need // 2)))
            if rows:
                kinds = [pa.int64(), pa.binary(), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.int32()]
                cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*cols[:4], _lists(seeds), *cols[4:]], ["item_id", "item", "words", "width", "seeds", "need", "wanted"])

    known = benchmark.where("item_id is not null").select("item_id", "text")
    return known.mapInArrow(run, "item_id long, item binary, words array<string>, width int, seeds array<long>, need int, wanted int")


def bitmap(keys: DataFrame) -> tuple[DataFrame, int]:
    """(at, word): the 64-bit words that aren't 0 of a bitmap of the low bits of ``keys(key)``; and how many low bits
    those are, for 64 to 128 bits a key as far as the bound allows."""
    bits = min(MOST_FILTER_BITS, max(16, keys.count().bit_length() + 6))
    low = F.col("key").bitwiseAND((1 << bits) - 1)
    each = keys.select(F.shiftright(low, 6).alias("at"), F.expr("shiftleft(1L, cast(key & 63 as int))").alias("bit"))
    return each.groupBy("at").agg(F.bit_or("bit").alias("word")), bits


def seed_filter(seeds: DataFrame) -> np.ndarray:
    """A bitmap with two bits set for each of ``seeds(seed)``. The driver gets its words, at most 2**26 / 64."""
    words, bits = bitmap(seeds.select(F.explode(F.array("seed", F.shiftright("seed", 32))).alias("key")))
    found = words.toArrow()
    out = np.zeros((1 << bits) // 64, np.int64)
    out[found.column("at").to_numpy()] = found.column("word").to_numpy()
    return np.unpackbits(out.view(np.uint8), bitorder="little")


def likely(texts: DataFrame, digests: DataFrame, ws: Workspace) -> DataFrame:
    """The rows of ``texts(digest, ...)`` whose digest is one of ``digests(digest)``, and a few others, without
    an exchange: a bitmap of the digests, bounded as it is, is broadcast."""
    words, bits = bitmap(digests.select(F.xxhash64("digest").alias("key")))
    words = ws.keep(words.select(F.col("at").alias("_at"), F.col("word").alias("_word")), "sieve")
    low = F.xxhash64("digest").bitwiseAND((1 << bits) - 1)
    met = texts.withColumn("_at", F.shiftright(low, 6)).join(F.broadcast(words), "_at")
    return met.where(F.expr("(shiftright(_word, cast(xxhash64(digest) & 63 as int)) & 1) = 1")).drop("_at", "_word")


def let_through(h: np.ndarray, present: np.ndarray) -> np.ndarray:
    mask = len(present) - 1
    h = h[present[h & mask] > 0]
    return h[present[h >> 32 & mask] > 0]


def held_seeds(docs: DataFrame, present: np.ndarray, widths: list[int]) -> DataFrame:
    """(doc_id, digest, seeds) of every document that holds seeds the filter lets through; ``docs(doc_id,
    digest, text)``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                rows, seeds = [], []
                for k, t in enumerate(part.column(2)):
                    w = word_hashes((t.as_py() or "").lower())
                    held = [let_through(seed_hashes(w, width), present) for width in widths]
                    if any(map(len, held)):
                        rows.append(k)
                        seeds.append(np.unique(np.concatenate(held)))
                if rows:
                    own = part.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), _lists(seeds)], ["doc_id", "digest", "seeds"])

    return docs.select("doc_id", "digest", "text").mapInArrow(run, "doc_id long, digest binary, seeds array<long>")


def rare_seeds(item_seeds: DataFrame, n_texts: DataFrame) -> DataFrame:
    """(item, seed, wanted): of each item's D distinct seeds the D - need + wanted rarest. A copy keeps ``need``
    of the D, so at least ``wanted`` of these. ``item_seeds(item, seed, need, wanted)``, ``n_texts(seed, n)``."""
    order = Window.partitionBy("item").orderBy(F.coalesce("n", F.lit(0)), "seed")
    known = item_seeds.join(n_texts, "seed", "left")
    ranked = known.withColumns({"at": F.row_number().over(order), "d": F.count("*").over(Window.partitionBy("item"))})
    return ranked.where("at <= d - need + wanted").select("item", "seed", "wanted")


def clusters(places: np.ndarray, seeds: np.ndarray, n: int, need: int) -> Iterator[tuple[int, int]]:
    """(first word, end) of each part of a document that may hold a copy of an item of ``n`` words, from the
    places of its seeds in the document."""
    reach = int(n / SIMILARITY) + 3  # the longest passage at the similarity
    at, last = 0, len(places)
    gaps = np.flatnonzero(np.diff(places) > reach) + 1
    for stop in [*gaps.tolist(), last]:
        while at < stop:
            end = min(stop, int(np.searchsorted(places, places[at] + 6 * reach, "right")))
            if len(np.unique(seeds[at:end])) >= need:
                yield max(0, int(places[at]) - reach), int(places[end - 1]) + reach + 3
            if end == stop:
                break
            # A part that was cut for its length overlaps the next by two reaches.
            at = int(np.searchsorted(places, places[end] - 2 * reach))
        at = stop


def align(item: list[str], words: list[str]) -> tuple[float, int, int, int]:
    """(similarity, score, first, end) of the local alignment of highest similarity, then score, among the
    best-scoring ones ending at each pair of words. A row of the table is kept, with the start, matched and added
    words of each cell's path; a path comes by the diagonal if that is as good, else from above, else from the left."""
    number: dict[str, int] = {}
    a = np.array([number.setdefault(w, len(number)) for w in item])
    b = np.array([number.setdefault(w, len(number)) for w in words])
    n, m = len(a), len(b)
    place = np.arange(m + 1)
    score, start, matched, added = np.zeros(m + 1, np.int64), place.copy(), np.zeros(m + 1, np.int64), np.zeros(m + 1, np.int64)
    best = (0.0, 0, 0, 0)
    for i in range(n):
        same = b == a[i]
        new = score + GAP
        diagonal = score[:-1] + np.where(same, MATCH, MISMATCH)
        new[0], come = 0, np.flatnonzero(diagonal >= new[1:])
        from_, got, more = start.copy(), matched.copy(), added.copy()
        new[come + 1], from_[come + 1], got[come + 1], more[come + 1] = diagonal[come], start[come], matched[come] + same[come], added[come]
        none = np.flatnonzero(new <= 0)
        new[none], from_[none], got[none], more[none] = 0, none, 0, 0
        # From the left: the nearest cell whose score, lowered by the way from it, is above a cell's own.
        key = new - GAP * place
        top = np.maximum.accumulate(key)
        left = np.flatnonzero(top > key)
        if len(left):
            origin = np.maximum.accumulate(np.where(key == top, place, 0))[left]
            new[left], from_[left], got[left], more[left] = (top + GAP * place)[left], from_[origin], got[origin], more[origin] + left - origin
        score, start, matched, added = new, from_, got, more
        if matched.max() >= best[0] * n:  # else no path is long enough
            sim = matched / (n + added)
            top_sim = sim.max()
            if top_sim >= best[0] and top_sim > 0:
                at = np.flatnonzero(sim == top_sim)
                j = int(at[score[at].argmax()])
                best = max(best, (float(top_sim), int(score[j]), int(start[j]), j), key=lambda x: x[:2])
    return best


def _aligned(pairs: DataFrame, similarity: float) -> DataFrame:
    """(digest, item, similarity, score, first_word, end_word) from ``pairs(digest, text, items)``, where items
    are structs of item, words, width, seeds and need."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 50):
                rows = []
                part = b.slice(lo, 50)
                for digest, text, items in zip(part.column(0), part.column(1), part.column(2), strict=True):
                    lowered = (text.as_py() or "").lower()
                    words, w, by_width = words_of(lowered), word_hashes(lowered), {}
                    for x in items.as_py():
                        width = x["width"]
                        if width not in by_width:
                            h = seed_hashes(w, width)
                            order = np.argsort(h, kind="stable")
                            by_width[width] = h, order, h[order]
                        h, order, rising = by_width[width]
                        own = np.asarray(x["seeds"], np.int64)
                        lows, highs = np.searchsorted(rising, own, "left"), np.searchsorted(rising, own, "right")
                        at = np.sort(np.concatenate([order[p:q] for p, q in zip(lows, highs, strict=True)]))
                        best = (0.0, 0, 0, 0)
                        for first, end in clusters(at, h[at], len(x["words"]), x["need"]):
                            sim, score, f, e = align(x["words"], words[first:end])
                            if (sim, score) > best[:2]:
                                best = (sim, score, first + f, first + e)
                        if best[0] >= similarity:
                            rows.append((digest.as_py(), x["item"], *best))
                if rows:
                    kinds = [pa.binary(), pa.binary(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]
                    names = ["digest", "item", "similarity", "score", "first_word", "end_word"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return pairs.select("digest", "text", "items").mapInArrow(run, "digest binary, item binary, similarity double, score int, first_word int, end_word int")


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, similarity, score, first_word, end_word: the best copy of an item in a document,
    for all pairs with a copy of at least ``similarity`` (not below the 0.8 that seeds are laid out for)."""
    if similarity < SIMILARITY:
        raise ValueError(f"seeds are laid out for a similarity of {SIMILARITY} or more")
    spark = docs.sparkSession
    ws = Workspace(spark, "decontaminate")
    items = ws.keep(items_of(benchmark), "items")
    widths = sorted(r.width for r in items.select("width").distinct().collect())  # 2 and 3 at most
    if not widths:
        return spark.createDataFrame([], FOUND)
    # Different items only; ids come back at the end.
    kinds = items.dropDuplicates(["item"]).select("item", "words", "width", "seeds", "need", "wanted")
    item_seeds = ws.keep(kinds.select("item", "need", "wanted", F.explode("seeds").alias("seed")), "item_seeds")
    texts = docs.select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), "text").where("text is not null")
    held = ws.keep(held_seeds(texts, seed_filter(item_seeds.select("seed").distinct()), widths), "held")
    hits = held.dropDuplicates(["digest"]).select("digest", F.explode("seeds").alias("seed"))
    hits = ws.keep(hits.join(item_seeds.select("seed").distinct(), "seed", "left_semi"), "hits")
    rare = ws.keep(rare_seeds(item_seeds, hits.groupBy("seed").agg(F.count("*").alias("n"))), "rare")
    pairs = hits.join(rare, "seed").groupBy("digest", "item").agg(F.count("*").alias("n"), F.first("wanted").alias("wanted")).where("n >= wanted")
    pairs = pairs.select("digest", "item").join(kinds, "item")
    wanted = ws.keep(pairs.groupBy("digest").agg(F.collect_list(F.struct("item", "words", "width", "seeds", "need")).alias("items")), "pairs")
    # Only texts that are likely wanted are exchanged, of equal ones in a task the first.
    texts = likely(texts.select("digest", "text"), wanted.select("digest"), ws).groupBy("digest").agg(F.first("text").alias("text"))
    found = ws.keep(_aligned(wanted.join(texts, "digest"), similarity), "found")
    best = F.max(F.struct("similarity", "score", (-F.col("first_word")).alias("minus"), "end_word")).alias("best")
    named = found.join(items.select("item", "item_id").distinct(), "item").join(held.select("digest", "doc_id"), "digest")
    return named.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "best.similarity", "best.score", (-F.col("best.minus")).alias("first_word"), "best.end_word"
    )
