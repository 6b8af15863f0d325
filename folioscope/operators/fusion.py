"""Rank fusion, one passage per page, top k and guard."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..settings import Settings
from ..sources.workspace import Tables
from . import scan, vectors, whole

MODES = ("dense", "hybrid")


@dataclass
class Index:
    """The stored tables of a corpus; ``n``, ``avg_len`` and ``page_chunks`` (most chunks on a page) are known."""

    chunks: DataFrame  # ord, chunk_id, doc_id, source, page, text
    vectors: DataFrame  # ord, slots, vals
    passages: DataFrame  # ord, slots, vals, len, words, tfs
    postings: DataFrame  # word, ord, tf, len
    words: DataFrame  # word, df, idf
    n: int
    avg_len: float
    page_chunks: int
    dim: int = vectors.DIM


def rrf(rankings: list[DataFrame], k: int = 60) -> DataFrame:
    """Any number of (qid, ord, rank) to (qid, ord, fused); a passage gets 1/(k + rank) from each."""
    shares = [r.select("qid", "ord", (1.0 / (F.lit(k) + F.col("rank"))).alias("share")) for r in rankings]
    return reduce(DataFrame.unionByName, shares).groupBy("qid", "ord").agg(F.round(F.sum("share"), 12).alias("fused"))


def fused_order(fused: DataFrame, dense: DataFrame) -> DataFrame:
    """R2: (qid, ord, fused, rank); ties keep the dense order."""
    w = Window.partitionBy("qid").orderBy(F.desc("fused"), "dense_rank")
    both = fused.join(dense.select("qid", "ord", F.col("rank").alias("dense_rank")), ["qid", "ord"])
    return both.withColumn("rank", F.row_number().over(w)).drop("dense_rank")


def one_per_page(ranked: DataFrame) -> DataFrame:
    """Of ``ranked(qid, source, page, rank, ...)`` each page's first, ranked anew."""
    own = Window.partitionBy("qid", "source", "page").orderBy("rank")
    again = Window.partitionBy("qid").orderBy("rank")
    first = ranked.withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n")
    return first.withColumn("rank", F.row_number().over(again))


def depth_for(top_k: int, distinct_pages: bool, page_chunks: int, k: int = 60) -> int:
    """How deep both rankings must be known for an exact fused top k.

    A passage beyond this depth in both has less than 2 / (k + depth + 1). With one passage a page, the
    top_k-th page is met after at most (top_k - 1) * page_chunks + 1 dense ranks, so its share alone is
    no less than that; likewise top_k ranks without."""
    last = (top_k - 1) * max(page_chunks, 1) + 1 if distinct_pages else top_k
    return max(last, 2 * (k + last) - k - 1)


def rankings(questions: DataFrame, index: Index, depth: int, hybrid: bool, embedder: vectors.Embedder) -> tuple[DataFrame, DataFrame | None]:
    """(dense, keyword) rankings of the candidates, (qid, ord, cosine, rank) and (qid, ord, rank).

    Candidates are the first ``depth`` passages of either ranking; their ranks in both are exact among
    all passages. Questions are worked off in blocks; each block's candidates are added to tables in the shared
    folder.
    """
    spark = questions.sparkSession
    tables = Tables(spark, "rankings")
    embedded = embedder.embed(questions.select(F.col("qid").alias("id"), F.col("question").alias("text")))
    found: list[tuple[DataFrame, DataFrame | None]] = []
    for n, (qids, matrix) in enumerate(vectors.question_blocks(embedded, index.dim)):
        asked = scan.ask(questions.where(F.lit(hybrid)), index.words, qids, matrix, index.avg_len)
        dense, keyword = scan.rankings(index.passages, asked, depth, hybrid, tables, f"block{n}")
        if n:  # a second block and more: plans must not grow with their number
            for df, name in ((dense, "dense"), (keyword, "keyword")):
                if df is not None:
                    tables.keep(df, name, "append")
        else:
            found.append((dense, keyword))
    if not found:
        return spark.createDataFrame([], scan.DENSE), spark.createDataFrame([], scan.KEYWORD) if hybrid else None
    dense, keyword = found[0]
    if tables.has("dense"):
        dense = dense.unionByName(spark.read.schema(scan.DENSE).parquet(tables.path("dense")))
    if hybrid and tables.has("keyword"):
        keyword = keyword.unionByName(spark.read.schema(scan.KEYWORD).parquet(tables.path("keyword")))
    return dense, keyword


def whole_ranking(questions: DataFrame, index: Index, tables: Tables, k: int = 60, embedder: vectors.Embedder | None = None) -> DataFrame:
    """R1, R2 over all passages: (qid, ord, dense_rank, fused, rank), every passage for every question.

    For a stated list of questions: the result has a row for each pair. Questions are scored in blocks, and their pairs go
    packed through the three rankings (``whole``), so neither a question nor a ranking is in one task."""
    _write_pieces(questions, index, tables, k, embedder, None)
    return whole.ranking(tables, "by-fused")


def whole_page_ranking(questions: DataFrame, index: Index, tables: Tables, k: int = 60, embedder: vectors.Embedder | None = None) -> DataFrame:
    """R4 over all passages: (qid, rank, ord, source, page), each page's first of ``whole_ranking``, ranked anew."""
    slices = whole.Slices(index.chunks.select("ord", "source", "page"), tables)
    _write_pieces(questions, index, tables, k, embedder, slices)
    return whole.paged(tables, "by-fused", slices)


def _write_pieces(questions: DataFrame, index: Index, tables: Tables, k: int, embedder: vectors.Embedder | None, slices: whole.Slices | None) -> None:
    """The table by-fused: all pairs of the questions, or with ``slices`` each page's first, by fused score."""
    spark = questions.sparkSession
    embedder = embedder or vectors.HashedWords(dim=index.dim)
    embedded = embedder.embed(questions.select(F.col("qid").alias("id"), F.col("question").alias("text")))
    tables.keep(spark.createDataFrame([], whole.PIECES), "by-fused")
    for qids, matrix in vectors.question_blocks(embedded, index.dim):
        asked = scan.ask(questions, index.words, qids, matrix, index.avg_len)
        marks = whole.bounds(index.passages, asked, index.n, k)
        bases = whole.counted(index.passages, asked, marks)
        if slices is None:
            pieces = whole.fused_pieces(index.passages, asked, marks, bases, k, partial(whole.to_fused, marks))
        else:
            found = whole.fused_pieces(index.passages, asked, marks, bases, k, partial(whole.to_slices, slices.starts))
            pieces = whole.first_of_pages(slices.beside(found, spark.createDataFrame([(q,) for q in qids], "qid long")), marks)
        tables.keep(pieces, "by-fused", "append")


def whole_pages(ranked: DataFrame, tables: Tables) -> DataFrame:
    """R4 over ``ranked(qid, source, page, rank, ...)``, whole rankings: each page's first, ranked anew."""
    first = ranked.groupBy("qid", "source", "page").agg(F.min("rank").alias("rank"))
    left = ranked.join(first, ["qid", "source", "page", "rank"]).withColumnRenamed("rank", "_rank")
    return scan.placed(left, [F.col("_rank")], tables, "by-page").drop("_rank")


Rankings = tuple[DataFrame, DataFrame | None]


NEAR = 128  # how deep rankings are made first, where a proof may ask for more
MARGIN = 1e-11  # fused shares are rounded to 12 digits


def unsettled(questions: DataFrame, ranked: Rankings, index: Index, settings: Settings, depth: int, tables: Tables) -> DataFrame:
    """(qid): the questions of which rankings of this ``depth`` may miss some of the first top k pages.

    A passage beyond it in both rankings has at most 2 / (k + depth + 1). So the first pages are settled once top_k of them
    have more, and in the dense order once top_k of them are met within ``depth``."""
    dense, keyword = ranked
    order = dense.select("qid", "ord", F.col("rank").alias("dense_rank"))
    if keyword is None:
        order, beyond = order.withColumn("fused", F.lit(1.0)), 0.0
    else:
        order, beyond = rrf([dense, keyword], settings.rrf_k).join(order, ["qid", "ord"]), 2.0 / (settings.rrf_k + depth + 1) + MARGIN
    paged = tables.keep(order, "order").join(index.chunks.select("ord", "source", "page"), "ord")
    pages = paged.groupBy("qid", "source", "page").agg(F.max("fused").alias("fused"), F.min("dense_rank").alias("dense_rank"))
    by_question = pages.groupBy("qid").agg(F.count_if(F.col("fused") > beyond).alias("sure"), F.count_if(F.col("dense_rank") <= depth).alias("met"))
    return questions.select("qid").join(by_question.where(F.least("sure", "met") >= settings.top_k), "qid", "left_anti")


def ranked_for(questions: DataFrame, index: Index, settings: Settings, mode: str, distinct_pages: bool, embedder: vectors.Embedder) -> Rankings:
    """``rankings`` as deep as a top k in this mode needs them.

    One passage a page asks for a depth that grows with the most chunks on any page, which few questions need: rankings
    are made ``NEAR`` deep first, and as deep as that only for the questions that these leave ``unsettled``."""
    depth = depth_for(settings.top_k, distinct_pages, index.page_chunks, settings.rrf_k)
    near = max(NEAR, depth_for(settings.top_k, False, 1, settings.rrf_k))
    if depth <= near or index.n <= near:
        return rankings(questions, index, depth, mode == "hybrid", embedder)
    first = rankings(questions, index, near, mode == "hybrid", embedder)
    tables = Tables(questions.sparkSession, "unsettled")
    left = tables.keep(unsettled(questions, first, index, settings, near, tables), "left")
    if left.isEmpty():
        return first
    rest = rankings(questions.join(left, "qid", "left_semi"), index, depth, mode == "hybrid", embedder)
    return tuple(a if a is None else a.join(left, "qid", "left_anti").unionByName(b) for a, b in zip(first, rest, strict=True))


def hits(ranked: Rankings, index: Index, settings: Settings, mode: str, distinct_pages: bool) -> DataFrame:
    """(qid, n, ord, chunk_id, doc_id, source, page, text, score, fused), the top k of each
    question; score is the passage's own cosine in every mode. Texts join last."""
    dense, keyword = ranked
    if mode == "dense":
        order = dense.select("qid", "ord", "cosine", "rank", F.lit(None).cast("double").alias("fused"))
    else:
        fused = rrf([dense, keyword], settings.rrf_k)
        order = fused_order(fused, dense).join(dense.select("qid", "ord", "cosine"), ["qid", "ord"])
    # The side of the ranking is at most questions times 2 * depth rows. It is written before it meets the chunks, and the top
    # before it meets their texts: of tables Spark knows the size, and does not exchange all chunks for a few rows.
    tables = Tables(index.chunks.sparkSession, "hits")
    if distinct_pages:
        order = one_per_page(tables.keep(order, "order").join(index.chunks.select("ord", "source", "page"), "ord"))
    top = order.where(F.col("rank") <= settings.top_k).select("qid", F.col("rank").alias("n"), "ord", F.col("cosine").alias("score"), "fused")
    return tables.keep(top, "top").join(index.chunks.select("ord", "chunk_id", "doc_id", "source", "page", "text"), "ord")


def guard(questions: DataFrame, top_scores: DataFrame, threshold: float) -> DataFrame:
    """``questions(qid, question)`` with top_score, abstain, threshold. No passage counts as 0;
    a blank question always abstains."""
    blank = F.regexp_replace("question", r"(?U)\s", "") == ""
    top = F.when(blank, 0.0).otherwise(F.coalesce("top_score", F.lit(0.0)))
    joined = questions.join(top_scores, "qid", "left")
    return joined.withColumn("top_score", top).withColumn("abstain", blank | (F.col("top_score") < threshold)).withColumn("threshold", F.lit(float(threshold)))


def top_scores(ranked: Rankings) -> DataFrame:
    """V6: (qid, top_score): the best cosine of each question."""
    return ranked[0].where("rank = 1").select("qid", F.col("cosine").alias("top_score"))


def asked_rows(questions: DataFrame) -> DataFrame:
    """The questions that are not blank."""
    return questions.where(F.regexp_replace("question", r"(?U)\s", "") != "")


def retrieve(
    questions: DataFrame, index: Index, settings: Settings | None = None, *,
    mode: str | None = None, distinct_pages: bool | None = None, embedder: vectors.Embedder | None = None, ranked: Rankings | None = None,
) -> DataFrame:
    """One row a question: qid, question, hits, top_score, abstain, threshold. ``hits`` is an array
    of (n, chunk_id, source, page, text, score), kept even when the guard abstains (R10). ``ranked``: what
    ``ranked_for`` gave for the same questions and a mode at least as demanding, to share it."""
    s = settings or Settings()
    mode = mode or s.retrieval_mode
    distinct = s.distinct_pages if distinct_pages is None else distinct_pages
    if mode not in MODES:
        raise ValueError(f"unknown retrieval mode: {mode}")
    if ranked is None:
        ranked = ranked_for(asked_rows(questions), index, s, mode, distinct, embedder or vectors.HashedWords(dim=index.dim))
    item = F.struct("n", "chunk_id", "source", "page", "text", "score")
    by_question = hits(ranked, index, s, mode, distinct).groupBy("qid").agg(F.array_sort(F.collect_list(item)).alias("hits"))
    out = guard(questions, top_scores(ranked), s.sim_threshold).join(by_question, "qid", "left")
    none = F.array().cast("array<struct<n:int,chunk_id:string,source:string,page:int,text:string,score:double>>")
    return out.select("qid", "question", F.coalesce("hits", none).alias("hits"), "top_score", "abstain", "threshold")
