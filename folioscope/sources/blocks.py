"""Sources of layout blocks (S1-S3) and of evaluation questions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCKS = "source string, page int, ord int, x0 double, y0 double, x1 double, y1 double, mid double, text string, block_type int"
QUESTIONS = (
    "question string, answerable boolean, expected_pages array<struct<source:string,page:int>>, "
    "answer string, evidence string, absent array<string>"
)


class NoInput(ValueError):
    """Nothing to read where input is required."""


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """(source, path, content) of the PDF files in a folder, not below it; none is an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "false").load(folder)
    found = files.select(F.element_at(F.split("path", "/"), -1).alias("source"), "path", "content")
    if found.isEmpty():
        raise NoInput(f"no PDF files in {folder}")
    return found


def pymupdf_pages(content: bytes) -> Iterator[tuple[float, list[tuple]]]:
    """The middle and the blocks of each page, with PyMuPDF if it is installed in the workers."""
    import fitz

    with fitz.open(stream=content, filetype="pdf") as doc:
        for page in doc:
            yield (page.rect.x0 + page.rect.x1) / 2, page.get_text("blocks")


def parse_pages(files: DataFrame, parser: Callable[[bytes], Iterable[tuple[float, list[tuple]]]] = pymupdf_pages) -> DataFrame:
    """BLOCKS of every page of ``files(source, content)``. Pages count from 1, blank ones too.
    Blocks of fewer than 7 fields are left out; ord is the order in which the parser gives them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for source, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = []
                for page, (mid, blocks) in enumerate(parser(content.as_py()), start=1):
                    rows += [(source, page, k, *map(float, x[:4]), float(mid), x[4], int(x[6])) for k, x in enumerate(blocks) if len(x) > 6]
                if rows:
                    cols = zip(*rows, strict=True)
                    kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.float64()] * 5, pa.string(), pa.int32()]
                    names = [c.split()[0] for c in BLOCKS.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return files.select("source", "content").mapInArrow(run, BLOCKS)


def questions(spark: SparkSession, path: str) -> DataFrame:
    """QUESTIONS from JSON lines, with optional keys; blank lines are skipped, a row without
    question or answerable is an error."""
    rows = spark.read.schema(QUESTIONS + ", _corrupt_record string").json(path)
    ok = F.col("question").isNotNull() & F.col("answerable").isNotNull() & F.col("_corrupt_record").isNull()
    checked = F.when(ok, F.col("question")).otherwise(F.raise_error(F.concat(F.lit("bad question row: "), F.to_json(F.struct("question", "answerable")))))
    return rows.withColumn("question", checked).drop("_corrupt_record")
