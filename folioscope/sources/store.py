"""The stored index: Parquet tables that are joined by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking, lexical, vectors
from ..operators.fusion import Index
from ..settings import Settings

#: What ``build`` writes; ``word_blocks`` adds another on demand.
TABLES = ("chunks", "starts", "vectors", "passages", "words", "stats")


class NotBuilt(RuntimeError):
    """There is no index at the place given."""


class OutOfSync(RuntimeError):
    """The tables of an index do not belong together."""


class NothingChunked(ValueError):
    """No document gave a chunk."""


def ordered(df: DataFrame, path: str, *keys: str, ranged: bool = False) -> DataFrame:
    """``df`` with ord, its place from 0 in the order of ``keys``, without a single-task sort.

    Rows are written, then range-partitioned (the sample for which reads them once more), sorted and written
    again; a row's ord is its place in its partition plus the rows of earlier partitions, of which there is one
    count each. Rows that come in ranges of the first key already (``ranged``) are sorted where they are and written once.
    The counts go beside the rows, which are not written again for their ord.
    """
    spark = df.sparkSession
    if not ranged:
        df.write.mode("overwrite").parquet(f"{path}-given")
        df = spark.read.parquet(f"{path}-given").repartitionByRange(*[F.col(k) for k in keys])
    df.sortWithinPartitions(*keys).withColumn("_m", F.monotonically_increasing_id()).write.mode("overwrite").parquet(path)
    rows = spark.read.parquet(path).select(F.shiftright("_m", 33).alias("_p"))
    sizes = {r["_p"]: r["count"] for r in rows.groupBy("_p").count().collect()}  # a row for each partition
    before, starts = 0, []
    for p in sorted(sizes):
        starts.append((p, before))
        before += sizes[p]
    offsets = spark.createDataFrame(starts, "_p long, _o long").coalesce(1)
    beside = f"{path.rsplit('/', 1)[0]}/starts"
    offsets.write.mode("overwrite").parquet(beside)
    return numbered(spark.read.parquet(path), spark.read.parquet(beside))


def numbered(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """``rows`` as ``ordered`` wrote them, with ord."""
    placed = rows.withColumn("_p", F.shiftright("_m", 33)).join(F.broadcast(starts), "_p")
    return placed.withColumn("ord", F.col("_m") - F.shiftleft("_p", 33) + F.col("_o")).drop("_p", "_m", "_o")


def build(chunks: DataFrame, path: str, embedder: vectors.Embedder | None = None, documents: DataFrame | None = None, ranged: bool = False) -> dict:
    """Write the tables of ``chunks(chunk_id, doc_id, source, page, i, text)`` below ``path``
    and return the build's statistics. The index is always built anew. ``ranged``: chunks come in ranges of source."""
    ordered(chunks, f"{path}/chunks", "source", "page", "i", ranged=ranged)
    return fill(chunks.sparkSession, path, embedder, documents)


def chunk_rows(spark: SparkSession, path: str) -> DataFrame:
    """The chunks below ``path``, also of an index whose other tables are not written yet."""
    return numbered(spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/starts")).drop("i")


def fill(spark: SparkSession, path: str, embedder: vectors.Embedder | None = None, documents: DataFrame | None = None) -> dict:
    """``build`` behind the chunks."""
    embedder = embedder or vectors.HashedWords()
    at = lambda t: f"{path}/{t}"
    old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at("blocks"))
    old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)  # they belong to an earlier index
    stored = chunk_rows(spark, path)
    if stored.isEmpty():
        raise NothingChunked("no document gave a chunk")
    # What a scan needs of a passage, side by side; the other tables are cut from it.
    if isinstance(embedder, vectors.HashedWords):
        passages = embedder.passages(stored)
    else:
        passages = lexical.passage_terms(stored).join(embedder.embed(stored.select(F.col("ord").alias("id"), "text")).withColumnRenamed("id", "ord"), "ord")
    passages.select("ord", "slots", "vals", "len", "words", "tfs").write.mode("overwrite").parquet(at("passages"))
    passages = spark.read.parquet(at("passages"))
    passages.select("ord", "slots", "vals").write.mode("overwrite").parquet(at("vectors"))
    n_row = lexical.corpus_stats(passages).first()
    lexical.idf_table(lexical.postings_of(passages), n_row.n).write.mode("overwrite").parquet(at("words"))
    most = stored.groupBy("source", "page").count().agg(F.max("count")).first()[0]
    dim = getattr(embedder, "dim", None) or spark.read.parquet(at("vectors")).agg(F.max(F.array_max("slots")) + 1).first()[0]
    uneven = passages.where(~vectors.is_unit("vals")).count()
    stats_row = (n_row.n, float(n_row.avg_len), int(most), int(dim), uneven)
    spark.createDataFrame([stats_row], "n long, avg_len double, page_chunks int, dim int, uneven long").coalesce(1).write.mode("overwrite").parquet(at("stats"))
    listed = documents if documents is not None else stored
    missing = chunking.skipped(listed, stored).orderBy("source")
    return {
        "pdfs": listed.select("source").distinct().count(), "chunks": n_row.n, "dim": int(dim),
        "skipped": [r.source for r in missing.collect()] if documents is not None else [],
    }


def load(spark: SparkSession, path: str) -> Index:
    """The index below ``path``, after checking that it is whole and its vectors of length 1."""
    got: dict[str, DataFrame] = {}
    for t in TABLES:
        try:
            got[t] = spark.read.parquet(f"{path}/{t}")
        except Exception as e:  # Spark names a missing path in its own exception types
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                raise NotBuilt(f"no index at {path}") from e
            raise
    got["chunks"] = numbered(got["chunks"], got["starts"]).drop("i")
    s = got["stats"].first()
    if not unmatched(got["chunks"], got["vectors"]).isEmpty():
        raise OutOfSync(f"chunks and vectors at {path} differ: build the index again")
    if s.uneven:
        raise OutOfSync(f"{s.uneven} vectors at {path} are not of length 1: build the index again")
    # Postings are a view of the passages.
    return Index(got["chunks"], got["vectors"], got["passages"], lexical.postings_of(got["passages"]), got["words"], s.n, s.avg_len, s.page_chunks, s.dim)


def word_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The index's postings in blocks (``lexical.passage_blocks``), written when they are first asked for."""
    ix = load(spark, path)
    kept = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/blocks/_SUCCESS")
    if not kept.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(kept):
        lexical.passage_blocks(ix.passages, ix.avg_len).write.mode("overwrite").parquet(f"{path}/blocks")
    return spark.read.parquet(f"{path}/blocks")


def health(spark: SparkSession, path: str, settings: Settings | None = None) -> DataFrame:
    """Status, chunks, gen_mode, threshold: one row, also where there is no index."""
    s = settings or Settings()
    try:
        status, chunks = "ok", load(spark, path).n
    except NotBuilt:
        status, chunks = "index_missing", 0
    return spark.createDataFrame([(status, chunks, s.gen_mode, s.sim_threshold)], "status string, chunks long, gen_mode string, threshold double")


def unmatched(chunks: DataFrame, vectors_: DataFrame) -> DataFrame:
    """(ord, side) of rows of one table that the other lacks."""
    a = chunks.select("ord").join(vectors_.select("ord"), "ord", "left_anti").withColumn("side", F.lit("chunks"))
    return a.unionByName(vectors_.select("ord").join(chunks.select("ord"), "ord", "left_anti").withColumn("side", F.lit("vectors")))


def stats(documents: DataFrame, chunks: DataFrame, dim: int) -> DataFrame:
    """S10 as a DataFrame: pdfs, chunks, dim, skipped."""
    return (
        documents.select("source").distinct().agg(F.count("*").alias("pdfs"))
        .crossJoin(chunks.agg(F.count("*").alias("chunks")))
        .crossJoin(chunking.skipped(documents, chunks).agg(F.count("*").alias("skipped")))
        .withColumn("dim", F.lit(dim))
    )


def export_jsonl(chunks: DataFrame, path: str) -> None:
    """Chunks as JSON lines; letters outside ASCII stay as they are."""
    chunks.orderBy("ord").select("chunk_id", "doc_id", "source", "page", "text").write.mode("overwrite").json(path)


