"""Keyword search with BM25 over a postings table (K1-K7)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import textcols as T
from ..sources.workspace import Tables

K1, B = 1.5, 0.75


def build_postings(chunks: DataFrame) -> DataFrame:
    """K1, K2: ``chunks(ord, text)`` to (word, ord, tf, len). Words are counted in the passage's own array:
    no row meets another."""
    return postings_of(passage_terms(chunks))


def postings_of(terms: DataFrame) -> DataFrame:
    """(word, ord, tf, len) from ``terms(ord, len, words, tfs)``."""
    each = terms.select("ord", "len", F.explode(F.arrays_zip("words", "tfs")).alias("x"))
    return each.select("x.words", "ord", "x.tfs", "len").toDF("word", "ord", "tf", "len")


def passage_lengths(chunks: DataFrame) -> DataFrame:
    """K2: (ord, len) for every passage, those without a word included."""
    return chunks.select("ord", F.size(T.tokenize("text")).cast("long").alias("len"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """K3: one row (n, avg_len); 0.0 for an empty corpus."""
    return lengths.agg(F.count("*").alias("n"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("avg_len"))


def idf(df: Column, n: Column) -> Column:
    """K4: never negative."""
    return F.ln(1 + (n - df + 0.5) / (df + 0.5))


def idf_table(postings: DataFrame, n: int) -> DataFrame:
    """(word, df, idf)."""
    by_word = postings.groupBy("word").agg(F.count("*").alias("df"))
    return by_word.withColumn("idf", idf(F.col("df"), F.lit(n)))


def keyword_scores(questions: DataFrame, postings: DataFrame, words: DataFrame, avg_len: float) -> DataFrame:
    """K5: (qid, ord, keyword) of the passages with any of a question's distinct words; scores are
    rounded to 9 digits, so that ranks do not hang on the order of a sum."""
    asked = questions.select("qid", F.explode(F.array_distinct(T.tokenize("question"))).alias("word"))
    weighed = asked.join(words.select("word", "idf"), "word")
    norm = K1 * (1 - B + B * F.col("len") / max(avg_len, 1e-9))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)
    return weighed.join(postings, "word").groupBy("qid", "ord").agg(F.round(F.sum(part), 9).alias("keyword"))


def keyword_ranking(scores: DataFrame, depth: int | None = None) -> DataFrame:
    """K7: (qid, ord, keyword, rank), best first, ties in passage order, positive scores only. With a
    depth, each task drops what cannot be among the first before rows are exchanged."""
    w = Window.partitionBy("qid").orderBy(F.desc("keyword"), "ord")
    ranked = scores.where("keyword > 0").withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= depth) if depth else ranked


BLOCK = 64  # passages that follow each other
FIRST = 4  # blocks of each question that are read before any bound is known
ROUNDING = 1e-8


def block_table(postings: DataFrame, avg_len: float, size: int = BLOCK) -> DataFrame:
    """Postings in blocks: (word, block, most, items), one row for each word and block of ``size`` passages that has it.
    ``most`` is the greatest part, before idf, that the word gives to any of them; ``items`` are their (ord, part)."""
    norm = K1 * (1 - B + B * F.col("len") / max(avg_len, 1e-9))
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + norm)
    rows = postings.select("word", F.floor(F.col("ord") / size).alias("block"), "ord", part.alias("part"))
    return rows.groupBy("word", "block").agg(F.max("part").alias("most"), F.collect_list(F.struct("ord", "part")).alias("items"))


def passage_blocks(passages: DataFrame, avg_len: float, size: int = BLOCK) -> DataFrame:
    """``block_table`` of ``passages(ord, len, words, tfs)``, made where these are: no row is exchanged. A block whose
    passages come in several batches has a row for each of them; bounds and scores are sums over rows, so a bound is only wider."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ords, tf = b.column(0).to_numpy(), b.column(3).flatten().to_numpy()
            if not len(tf):
                continue
            owner = np.repeat(np.arange(b.num_rows), b.column(2).value_lengths().to_numpy())
            norm = K1 * (1 - B + B * b.column(1).to_numpy() / max(avg_len, 1e-9))
            part = tf * (K1 + 1) / (tf + norm[owner])
            names = b.column(2).flatten().dictionary_encode()
            distinct, place = np.unique(ords // size, return_inverse=True)
            key = place[owner] * len(names.dictionary) + names.indices.to_numpy()
            order = np.argsort(key, kind="stable")
            starts = np.flatnonzero(np.diff(key[order], prepend=-1))
            first = key[order[starts]]
            items = pa.StructArray.from_arrays([pa.array(ords[owner][order]), pa.array(part[order])], ["ord", "part"])
            yield pa.RecordBatch.from_arrays(
                [
                    names.dictionary.take(pa.array(first % len(names.dictionary))), pa.array(distinct[first // len(names.dictionary)]),
                    pa.array(np.maximum.reduceat(part[order], starts)), pa.ListArray.from_arrays(pa.array([*starts, len(order)], pa.int32()), items),
                ],
                ["word", "block", "most", "items"],
            )

    return passages.select("ord", "len", "words", "tfs").mapInArrow(run, "word string, block long, most double, items array<struct<ord:long,part:double>>")


def pruned_topk(questions: DataFrame, blocks: DataFrame, words: DataFrame, depth: int, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """K5, K7 without scoring every passage: ``keyword_ranking``'s first ``depth`` rows, exactly, and (qid, blocks,
    read): of how many blocks with any of a question's words the passages were scored.

    The sum of idf and ``most`` over a question's words bounds the score of every passage of a block. The ``FIRST``
    blocks of the greatest bounds are scored; then the depth-th best score found tells which of the others can hold a
    better passage, and these are scored. Bounds are read without the passages (``items``), which are unfolded only
    for the blocks chosen."""
    asked = questions.select("qid", F.explode(F.array_distinct(T.tokenize("question"))).alias("word"))
    weighed = tables.keep(asked.join(words.select("word", "idf"), "word"), "weighed")
    bounds = weighed.join(blocks.select("word", "block", "most"), "word").groupBy("qid", "block").agg((F.sum(F.col("idf") * F.col("most")) + ROUNDING).alias("bound"))
    bounds = tables.keep(bounds, "bounds")
    w = Window.partitionBy("qid").orderBy(F.desc("bound"), "block")

    def scored(chosen: DataFrame, name: str) -> DataFrame:
        """(qid, ord, keyword) of the passages of ``chosen(qid, block)``. What is looked up is written, so that Spark knows
        its size and does not exchange all blocks for a few rows; other words' blocks are left where they are in any case."""
        known = blocks.select("word", "block", "items").join(weighed.select("word").distinct(), "word", "left_semi")
        own = tables.keep(chosen.join(weighed, "qid"), name).join(known, ["word", "block"])
        each = own.select("qid", "idf", F.explode("items").alias("x"))
        return each.groupBy("qid", F.col("x.ord").alias("ord")).agg(F.round(F.sum(F.col("idf") * F.col("x.part")), 9).alias("keyword"))

    first = tables.keep(bounds.withColumn("k", F.row_number().over(w)).where(F.col("k") <= FIRST).select("qid", "block"), "first")
    found = tables.keep(scored(first, "first-words"), "found")
    known = keyword_ranking(found, depth).groupBy("qid").agg(F.count("*").alias("n"), F.min("keyword").alias("least")).where(F.col("n") == depth).select("qid", "least")
    rest = bounds.join(first, ["qid", "block"], "left_anti").join(known, "qid", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least")))
    rest = tables.keep(rest.select("qid", "block"), "rest")
    read = bounds.groupBy("qid").agg(F.count("*").alias("blocks")).join(first.unionByName(rest).groupBy("qid").agg(F.count("*").alias("read")), "qid")
    return keyword_ranking(found.unionByName(scored(rest, "rest-words")), depth), read


def counted(rows: DataFrame, items: str, distinct: str, counts: str) -> DataFrame:
    """``rows`` with the distinct values of the array column ``items``, sorted, and how often each occurs, in one
    pass over the sorted array: a value's count is the distance from its first place to the next value's."""
    at = F.filter(F.sequence(F.lit(0), F.size("_s") - 1), lambda i: (i == 0) | (F.get("_s", i) != F.get("_s", i - 1)))
    rows = rows.withColumn("_s", F.sort_array(items)).withColumn("_at", F.when(F.size("_s") > 0, at).otherwise(F.array().cast("array<int>")))
    ends = F.transform("_at", lambda p, k: (F.coalesce(F.get("_at", k + 1), F.size("_s")) - p).cast("long"))
    return rows.withColumns({distinct: F.transform("_at", lambda p: F.get("_s", p)), counts: ends}).drop("_s", "_at")


TERMS = "ord long, len long, words array<string>, tfs array<long>"


def term_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """TERMS of batches of (ord, text): the words of ``T.tokenize``, found and counted over the letters of a whole batch: a
    pattern and a counter for each text took several times as long, and array functions longer still."""
    letters = np.zeros(256, bool)
    letters[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
    stop = pa.array(T.STOPWORDS, pa.string())
    for b in batches:
        # Other letters than ASCII's become one sign each and part words, as any sign does.
        texts = [(t or "").lower().encode("ascii", "replace") for t in b.column(1).to_pylist()]
        whole = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
        inside = letters[whole]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        starts, ends = edges[::2], edges[1::2]
        begins = np.cumsum([1, *(len(t) + 1 for t in texts)])
        owner = np.searchsorted(begins, starts, side="right") - 1
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        found = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(whole[inside])).dictionary_encode()
        order = pc.array_sort_indices(found.dictionary)
        names = found.dictionary.take(order)
        place = np.argsort(order.to_numpy())[found.indices.to_numpy()]  # of each word among the sorted names
        kept = ~pc.is_in(names, value_set=stop).to_numpy(zero_copy_only=False)[place]
        owner, place, size = owner[kept], place[kept], max(len(names), 1)
        cells, tfs = np.unique(owner * size + place, return_counts=True)
        at = pa.array(np.searchsorted(cells // size, np.arange(b.num_rows + 1)), pa.int32())
        words = pa.ListArray.from_arrays(at, names.take(pa.array(cells % size)))
        lens = np.bincount(owner, minlength=b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lens, pa.int64()), words, pa.ListArray.from_arrays(at, pa.array(tfs, pa.int64()))], ["ord", "len", "words", "tfs"])


def passage_terms(chunks: DataFrame) -> DataFrame:
    """TERMS: the words of each passage side by side, sorted, for scans in passage order."""
    return chunks.select("ord", "text").mapInArrow(term_batches, TERMS)
