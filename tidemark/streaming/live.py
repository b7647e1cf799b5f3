"""Structured Streaming over quote events: live period tables, last-wins corrections, file-driven refreshes.

Micro-batches write with their batch id as partition and overwrite it when repeated, so a restarted query neither
loses nor doubles anything.  Files may arrive in any order of event time: readers add up what the batches left.
"""

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import store


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh folder next to the checkpoints, shared by all executors."""
    store.with_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid4().hex}"


def file_stream(spark: SparkSession, path: str, schema, glob: str = "*.parquet", files_per_batch: int = 100, nested: bool = False) -> DataFrame:
    """New files of a landing folder; half-written and temporary files do not match the pattern."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        path, glob = where.getParent().toString(), where.getName()
    rows = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", nested).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    plain = [f.name for f in rows.schema if f.dataType.typeName() == "timestamp_ntz"]
    return rows.withColumns({c: F.col(c).cast("timestamp") for c in plain})  # event time needs an instant; sessions run in UTC


def trigger(interval: str | None) -> dict:
    """Once over everything available, or every interval; the micro-batch is the debounce."""
    return {"availableNow": True} if interval is None else {"processingTime": interval}


def write_batches(stream: DataFrame, out: str, reduce=None, interval: str | None = None):
    """Each micro-batch, reduced by ``reduce``, to its own partition of ``out``.  Nothing is ever too late: there is no watermark and no
    state, a late row is part of the batch it arrives in, and a repeated batch replaces its own partition."""
    def put(batch: DataFrame, batch_id: int):
        (reduce(batch) if reduce else batch).write.mode("overwrite").parquet(f"{out}/data/batch={batch_id}")
    return stream.writeStream.outputMode("append").option("checkpointLocation", f"{out}/checkpoint").foreachBatch(put).trigger(**trigger(interval)).start()


def period_parts(batch: DataFrame, key: str, width: str = "1 day", scale: int = 10) -> DataFrame:
    """Count, exact sum and range of one batch per key and period: parts that ``live_periods`` adds up."""
    start = F.window("ts", width)["start"]
    return (batch.where(F.col("ts").isNotNull()).groupBy(F.col(key).alias("series_id"), start.alias("period"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast(f"decimal(38,{scale})")).alias("total"), F.min("value").alias("low"), F.max("value").alias("high")))


def live_periods(spark: SparkSession, out: str) -> DataFrame:
    """The period table so far: the parts of all batches added up."""
    parts = spark.read.parquet(f"{out}/data")
    total = parts.groupBy("series_id", "period").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))
    return total.select("series_id", F.to_date("period").alias("ts"), "n", F.col("total").cast("double").alias("total"), "low", "high")


def without_repeats(spark: SparkSession, out: str, keys: list) -> DataFrame:
    """Rows of all batches; of rows delivered more than once the first delivery counts, however far apart they arrived."""
    table = spark.read.parquet(f"{out}/data")
    rest = [c for c in table.columns if c not in keys + ["batch"]]
    return table.groupBy(*keys).agg(F.min_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")


def run_to_end(query) -> None:
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def touched(series: DataFrame, changed: DataFrame) -> DataFrame:
    """History of only those series that a batch changed: late rows of any age are recomputed with the rest."""
    return series.join(changed.select("series_id").distinct(), "series_id", "left_semi")


def retrain_needed(spark: SparkSession, series: DataFrame, state: str, force: bool = False) -> bool:
    """Whether there is a newer observation than at the last training."""
    newest = series.agg(F.max("ts")).first()[0]
    return force or newest != store.trained_through(spark, state)
