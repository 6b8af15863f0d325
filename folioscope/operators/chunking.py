"""Greedy packing of blocks into page-bounded chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import textcols as T
from ..settings import Settings

PAGE = ("source", "page")


def runs(blocks: DataFrame, settings: Settings | None = None) -> DataFrame:
    """``blocks(source, page, pos, text)`` with run. Neighbouring blocks that fit a chunk form one
    run; a larger block is a run by itself. No overlap crosses runs."""
    big = F.length("text") > (settings or Settings()).chunk_chars
    w = Window.partitionBy(*PAGE).orderBy("pos")
    starts = (big | F.coalesce(F.lag(big).over(w), F.lit(False))).cast("int")
    return blocks.withColumn("big", big).withColumn("_starts", starts).withColumn("run", F.sum("_starts").over(w)).drop("_starts")


def overlap(chunk: Column, next_len: Column, settings: Settings) -> Column:
    """The end of a chunk that the next one repeats."""
    n = F.least(F.lit(settings.chunk_overlap), F.lit(settings.chunk_chars) - next_len - 1)
    return F.when(n > 0, F.right(chunk, n)).otherwise(F.lit(""))


def pack(pieces: Column, settings: Settings | None = None) -> Column:
    """An array of texts folded into chunks. A chunk closes when the next piece would make it
    longer than the limit; a single longer piece stays whole."""
    s = settings or Settings()
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("buf"))

    def step(acc: Column, piece: Column) -> Column:
        buf, out = acc["buf"], acc["out"]
        full = F.length(buf) + 1 + F.length(piece) > s.chunk_chars
        tail = overlap(buf, F.length(piece), s)
        return (
            F.when(buf.isNull(), F.struct(out.alias("out"), piece.alias("buf")))
            .when(full, F.struct(F.array_append(out, buf).alias("out"), F.when(tail != "", F.concat(tail, F.lit(" "), piece)).otherwise(piece).alias("buf")))
            .otherwise(F.struct(out.alias("out"), F.concat(buf, F.lit(" "), piece).alias("buf")))
        )

    return F.aggregate(pieces, empty, step, lambda acc: F.when(acc["buf"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], acc["buf"])))


def pack_pages(blocks: DataFrame, settings: Settings | None = None) -> DataFrame:
    """``blocks(source, page, pos, text)`` to source, page, i, text: every chunk with its number.

    A page is the unit of grouping (C7), so groups are as small as pages are."""
    s = settings or Settings()
    # Blocks come back in order from the array of a run, and runs from the array of a page.
    by_run = runs(blocks, s).groupBy(*PAGE, "run", "big").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("b"))
    texts = F.transform("b", lambda x: x["text"])
    pieces = F.when(F.col("big"), T.sentences(F.col("b")[0]["text"])).otherwise(texts)
    packed = by_run.select(*PAGE, "run", pack(pieces, s).alias("chunks"))
    pages = packed.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("run", "chunks"))).alias("r"))
    flat = F.flatten(F.transform("r", lambda x: x["chunks"]))
    return pages.select(*PAGE, F.posexplode(flat).alias("i", "text"))


def chunk_table(blocks: DataFrame, settings: Settings | None = None) -> DataFrame:
    """chunk_id, doc_id, source, page, i, text. Numbers are given before short chunks go, so
    they may have gaps. doc_id is the source without its ending."""
    s = settings or Settings()
    doc = F.regexp_replace("source", r"\.[^.]*$", "")
    kept = pack_pages(blocks, s).where(F.length("text") >= s.min_chunk_chars)
    ident = F.concat(doc, F.lit("::p"), F.col("page").cast("string"), F.lit("::c"), F.col("i").cast("string"))
    return kept.select(ident.alias("chunk_id"), doc.alias("doc_id"), "source", "page", "i", "text")


def skipped(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Sources of ``documents(source)`` without a chunk."""
    return documents.select("source").distinct().join(chunks.select("source"), "source", "left_anti")
