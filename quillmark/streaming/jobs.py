"""Job queue, job states and duplicate suppression as Structured Streaming; each also runs to the end of its input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.runtime import file_system

JOB = "job_id string, kind string, payload string, queued_at timestamp"
EVENT = "job_id string, status string, stage string, done int, total int, at timestamp"


def read_jobs(spark: SparkSession, path: str, schema: str = JOB, one_at_a_time: bool = True) -> DataFrame:
    """Jobs as files dropped in a folder, oldest first."""
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", 1) if one_at_a_time else r).json(path)


def run_queue(jobs: DataFrame, handlers: dict[str, Callable[[DataFrame], DataFrame]], out: str, checkpoint: str) -> None:
    """Every job once, in arrival order: the handler of its kind turns jobs into results, which are written with the
    batch number; an unknown kind or a failing handler gives error rows and the queue goes on. Handlers run once: their
    results are written as they come, one folder a kind. A restart takes up where the checkpoint stands; a batch that
    was written before the stop is overwritten, not repeated."""

    def step(batch: DataFrame, n: int) -> None:
        unknown = batch.where(~F.coalesce(F.col("kind").isin(*handlers), F.lit(False)))
        fault = unknown.select("job_id", "kind", F.lit("error").alias("status"), F.concat(F.lit("no handler for "), F.coalesce("kind", F.lit("null"))).alias("result"))
        fault.write.mode("overwrite").parquet(f"{out}/batch={n}/part=0")
        # as many writes as there are handlers, whatever the jobs say
        for k, kind in enumerate(sorted(handlers), 1):
            own, to = batch.where(F.col("kind") == kind), f"{out}/batch={n}/part={k}"
            try:
                handlers[kind](own).select("job_id", F.lit(kind).alias("kind"), F.lit("done").alias("status"), F.col("result").cast("string").alias("result")).write.mode("overwrite").parquet(to)
            except Exception as e:
                own.select("job_id", F.lit(kind).alias("kind"), F.lit("error").alias("status"), F.lit(str(e).split("\n")[0][:200]).alias("result")).write.mode("overwrite").parquet(to)

    q = jobs.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def latest_status(events: DataFrame) -> DataFrame:
    """The last state of every job by time; the same expression over a table and over a stream (update mode)."""
    order = F.struct("at", F.coalesce("done", F.lit(-1)))
    return events.groupBy("job_id").agg(F.max_by(F.struct("status", "stage", "done", "total"), order).alias("s"), F.max("at").alias("at")).select("job_id", "s.status", "s.stage", "s.done", "s.total", "at")


def keep_status(events: DataFrame, out: str, checkpoint: str, compact: int = 100) -> None:
    """Maintain job states from a stream of events: each batch writes its own last states only, and every ``compact``
    batches what there is becomes one table of states. A batch that is repeated overwrites itself."""
    spark = events.sparkSession

    def step(batch: DataFrame, n: int) -> None:
        latest_status(batch).write.mode("overwrite").parquet(f"{out}/batch={n}")
        if (n + 1) % compact == 0:
            status_table(spark, out).write.mode("overwrite").parquet(f"{out}-states/upto={n}")

    events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def status_table(spark: SparkSession, out: str) -> DataFrame:
    """The states keep_status maintains: the newest table of states under the batches after it."""
    cols = ["job_id", "status", "stage", "done", "total", "at"]
    upto, states = -1, None
    fs, p = file_system(spark, f"{out}-states")
    if fs.exists(p):
        # a table of states counts once its write has been committed
        whole = [int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(p) if fs.exists(file_system(spark, f"{f.getPath()}/_SUCCESS")[1])]
        if whole:
            upto = max(whole)
            states = spark.read.parquet(f"{out}-states/upto={upto}").select(*cols)
    new = spark.read.parquet(out).where(F.col("batch") > upto).select(*cols)
    return latest_status(new if states is None else states.unionByName(new))


def without_repeats(uploads: DataFrame, late: str = "1 hour") -> DataFrame:
    """Uploads without those whose content came before within the lateness bound, so that state stays bounded."""
    return uploads.withWatermark("at", late).dropDuplicatesWithinWatermark(["sha"])


def refused_deletions(asked: DataFrame, status: DataFrame) -> DataFrame:
    """Deletions that must wait: the job is queued or running."""
    return asked.join(status.where("status in ('queued', 'running')").select("job_id"), "job_id", "left_semi")
