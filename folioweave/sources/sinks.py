"""Sinks: partitioned tables that are replaced by document, reports as JSON, CSV and Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS, FILE_ROWS = 64, 1_000_000


def write_chunks(chunks: DataFrame, path: str, document: str = "documentId", buckets: int = BUCKETS, tasks: int | None = None) -> None:
    """Writes the buckets of documents that occur in the rows anew; other buckets stay (dynamic partition overwrite).

    The rows must hold the whole content of each bucket they touch, as replace_chunks gives it.
    """
    rows = chunks.withColumn("bucket", F.pmod(F.xxhash64(document), F.lit(buckets)).cast("int"))
    # several tasks, and so several files, share a bucket: a bucket's size is no task's size
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(*[c for c in chunks.columns if c in (document, "id", "chunkNo")]), F.lit(1 << 20)))
    rows = rows.repartition(tasks or max(buckets, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "bucket", "_part").drop("_part")
    rows.write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("bucket").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def write_json(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def write_csv(report: DataFrame, path: str) -> None:
    """Arrays and structs are written as JSON."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in report.dtypes]
    report.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def write_markdown(report: DataFrame, path: str) -> None:
    """One Markdown table row per line, the head in its own file part."""
    cols = report.columns
    spark = report.sparkSession
    head = spark.createDataFrame([("| " + " | ".join(cols) + " |",), ("|" + "---|" * len(cols),)], "value string").coalesce(1)
    body = report.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\|", r"\\|") for c in cols]), F.lit(" |")).alias("value"))
    head.unionAll(body).write.mode("overwrite").text(path)


def write_failures(audit: DataFrame, path: str) -> None:
    """The files of an audit that could not be read, with their errors."""
    write_csv(audit.where("error IS NOT NULL"), path)


def write_discarded(tables: DataFrame, path: str) -> None:
    """The tables an audit discarded as prose, with their figures."""
    write_csv(tables.where("verdict = 'prose'"), path)


def write_debug(parts: dict[str, DataFrame], path: str, wanted: list[str] | None = None) -> list[str]:
    """Sections of a document's layout (blocks, nodes, chunks, checks ...) as JSON, one folder each; all where none are named. Gives the names written."""
    names = [n for n in parts if wanted is None or n in wanted]
    for n in names:
        write_json(parts[n], f"{path}/{n}")
    return names
