"""Sources: files, descriptors, and extractors behind one interface.

PDF parsing needs a library that isn't part of Spark; an Extractor is any function from (path, bytes) to page texts.
The text extractor here reads form-feed separated text files; failures become rows, never lost documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Extractor = Callable[[str, bytes], list[str]]


def binary_files(spark: SparkSession, root: str, pattern: str = "*.pdf") -> DataFrame:
    """path, modificationTime, length, content of all files below root that match; ordered reading is the consumer's."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)


def discovered(spark: SparkSession, root: str, pattern: str = "*.pdf") -> DataFrame:
    """path, length of the files below a folder, or of one file, ordered by path; a missing root is an error. Contents are not read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        raise FileNotFoundError(root)
    return binary_files(spark, root, pattern).select("path", "length").orderBy("path")


def probe(spark: SparkSession) -> bool:
    """Whether the engine answers."""
    return spark.sql("SELECT 1").first()[0] == 1


def with_identity(files: DataFrame) -> DataFrame:
    """Adds the content hash and the title that the file name gives."""
    return files.withColumns({"content_hash": F.sha2("content", 256), "title": F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)})


def text_extractor(path: str, content: bytes) -> list[str]:
    return content.decode("utf-8").split("\f")


def extract_pages(files: DataFrame, extractor: Extractor = text_extractor) -> DataFrame:
    """path, page_number, text, error: one row per page, or one row with the error of a file that can't be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    pages = extractor(path, content or b"")
                    rows = [(path, i, t, None) for i, t in enumerate(pages, 1)]
                except Exception as e:  # a broken file is a row, the job goes on
                    rows = [(path, None, None, f"{type(e).__name__}: {e}"[:500])]
                if rows:
                    a, b, c, d = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.int32()), pa.array(c, pa.string()), pa.array(d, pa.string())], names=["path", "page_number", "text", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, page_number int, text string, error string")


def descriptors(parts: list[DataFrame], limit: int | None = None) -> DataFrame:
    """Inputs named in several ways (ids, paths, prefixes) as one list, one behind the other; missing columns are null, an input named twice stands twice."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return both.orderBy(*both.columns).limit(limit) if limit is not None else both


def matching(documents: DataFrame, prefix: str | None = None, category: str | None = None) -> DataFrame:
    """Documents by path prefix and category, the newest first; predicates are pushed to the scan."""
    if prefix is not None:
        documents = documents.where(F.col("blobPath").startswith(prefix))
    if category is not None:
        documents = documents.where(F.col("category_id") == category)
    return documents.orderBy(F.desc("updatedAt"), "id")
