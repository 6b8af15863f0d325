"""A corpus pipeline of five stages over ``documents``: language, near duplicates, benchmark copies,
secrets, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet into
the shared folder and reads again for the next one. All stages but the last return the columns of
``documents``; rows that a stage removes are gone for those after it. Null and empty texts pass the
language stage only if it can name a language, so they end there. Rows without an id cannot be told apart
and are kept by the second and third stage. Rows that share an id stand or fall together, but of those whose
texts are equal too one stays, the least by its other columns. Ties between near duplicates go to the smallest
id, ties between languages to the one that sorts first. Texts of any length are read whole. Columns other than
those of ``documents`` are dropped whatever their names. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import decontaminate, langid, minhash, packing, secrets
from folioscope.llm.common import Workspace, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language can be told; ``und`` goes. The prototypes learn from all rows with
    a language but the held-out fifth."""
    model = langid.train(docs.where(~langid.held_out()))
    return langid.predict(docs.select(*COLUMNS), model).where("lang_pred <> 'und'").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group of near duplicates (five words, similarity 0.8), and
    one of the rows that share its id and text."""
    ws = Workspace(spark, "repeats")
    kept = minhash.near_duplicates(docs, width=5, percent=80).where("kept").groupBy("doc_id").agg(F.count("*").alias("_copies"))
    named = docs.select(*COLUMNS).join(ws.keep(kept, "kept"), "doc_id")
    rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
    repeated = named.where("_copies > 1").groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("_first"))
    once = repeated.select("doc_id", "text", *[F.col(f"_first.{c}").alias(c) for c in rest]).select(*COLUMNS)
    alone = named.where("_copies = 1").select(*COLUMNS)
    return alone.unionByName(once).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a copy of a benchmark item."""
    copies = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents and writes ``[SECRET]`` over every secret; n_chars follows the text."""
    return secrets.redact(docs.select(*COLUMNS))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document, with its place in a sequence."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language),
    ("minhash_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Similarity joins, trained models and tokens cannot be expressed in SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``."""
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = ws.keep(stage(spark, docs, sf_dir), name)
        ws.release()
    return docs
