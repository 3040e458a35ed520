"""Indexing as a stream: arriving page files are cut into chunks and written idempotently, runs are logged.

Documents arrive whole, so no state is kept over batches; what is replaced is decided by the batch's documents.  The run
log is append-only: a batch writes 'processing' before and 'completed' or 'failed' after, and the newest row of an id
holds.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators import chunks, index, lines

PAGES = "doc_id string, page_number int, text string"
RUN = "id string, startedAt timestamp, endedAt timestamp, status string, chunksTotal bigint, error string"


def page_stream(spark: SparkSession, path: str, files: int = 2) -> DataFrame:
    """Pages of parquet files as they arrive, so many files a batch."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files).parquet(path)


REQUEST = "runId string, categoryId string, blobPath string, documentTitle string, enableLlmGenericHeadingRefine boolean"


def request_stream(spark: SparkSession, path: str, files: int = 20) -> DataFrame:
    """Requests for indexing from JSON files as they arrive, so many files a batch, with status accepted or rejected and the error."""
    rows = spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", files).json(path)
    checked = index.valid_requests(rows, ["runId", "categoryId"], ["blobPath", "documentTitle"])
    return checked.withColumn("status", F.when(F.col("error").isNull(), "accepted").otherwise("rejected"))


def log_run(spark: SparkSession, path: str, id_: str, started: datetime, status: str, chunks_total: int | None = None, error: str | None = None) -> None:
    ended = None if status == "processing" else datetime.now(timezone.utc).replace(tzinfo=None)
    spark.createDataFrame([(id_, started, ended, status, chunks_total, error)], RUN).coalesce(1).write.mode("append").parquet(path)


def updated_runs(runs: DataFrame, changes: DataFrame, now) -> DataFrame:
    """Runs after changes by id: given fields win, and any change sets endedAt, also one to processing."""
    fields = [c for c in changes.columns if c != "id" and c in runs.columns]
    new = changes.select("id", *[F.col(c).alias(f"_n_{c}") for c in fields], F.lit(True).alias("_hit"))
    got = runs.join(new, "id", "left")
    value = {c: F.coalesce(F.col(f"_n_{c}"), F.col(c)) if c in fields else F.col(c) for c in runs.columns}
    value["endedAt"] = F.when(F.col("_hit"), F.lit(now)).otherwise(F.col("endedAt"))
    return got.select(*[v.alias(c) for c, v in value.items()])


class Progress(StreamingQueryListener):
    """Tells a callback the rows processed so far each time a batch has at least `step` more; the callback writes them where progress is read."""

    def __init__(self, callback, step: int = 100):
        self.callback, self.step, self.rows, self.told = callback, step, 0, 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.rows += event.progress.numInputRows
        if self.rows - self.told >= self.step:
            self.told = self.rows
            self.callback(self.rows)

    def onQueryTerminated(self, event) -> None:
        if self.rows != self.told:
            self.callback(self.rows)


def run_states(runs: DataFrame) -> DataFrame:
    """The newest state of each run: ended rows before open ones."""
    return index.newest(runs, "id", ["endedAt", "startedAt"])


def swept(runs: DataFrame, now: datetime, hours: int = 1) -> DataFrame:
    """Failure rows for runs that are still open after the given hours."""
    stuck = index.stuck_runs(run_states(runs), F.lit(now), hours)
    return stuck.withColumns({"status": F.lit("failed"), "endedAt": F.lit(now), "error": F.lit("timeout")})


def index_batch(out: str, log: str):
    """The function for foreachBatch: a batch written twice gives the same files."""

    def run(batch: DataFrame, number: int) -> None:
        spark, started, id_ = batch.sparkSession, datetime.now(timezone.utc).replace(tzinfo=None), f"batch-{number}"
        log_run(spark, log, id_, started, "processing")
        try:
            typed = lines.typed_lines(lines.split_fused(lines.explode_lines(lines.distinct_pages(batch))))
            made = chunks.bounded_chunks(lines.segments(typed)).withColumn("batch", F.lit(number))
            made.write.partitionBy("batch").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(out)
            log_run(spark, log, id_, started, "completed", spark.read.parquet(out).where(F.col("batch") == number).count())
        except Exception as e:
            log_run(spark, log, id_, started, "failed", error=str(e)[:500])
            raise

    return run


def current_chunks(stored: DataFrame) -> DataFrame:
    """Of a document indexed in several batches the chunks of the last one."""
    last = stored.groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return stored.join(last, ["doc_id", "batch"], "left_semi")


def start(spark: SparkSession, source: str, out: str, log: str, checkpoint: str, files: int = 2) -> StreamingQuery:
    """Indexes all files present and ends; run it again, or on a schedule, for new ones."""
    stream = page_stream(spark, source, files)
    return stream.writeStream.foreachBatch(index_batch(out, log)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_rates(runs: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Runs started per window and status; on a stream, rows later than the watermark are dropped by it."""
    timed = runs.withColumn("startedAt", F.col("startedAt").cast("timestamp"))
    timed = timed.withWatermark("startedAt", late) if timed.isStreaming else timed
    return timed.groupBy(F.window("startedAt", window).alias("w"), F.lower(F.trim("status")).alias("status")).agg(F.count("*").alias("runs")).select(F.col("w.start").alias("start"), "status", "runs")
