"""Tiers on disk: landed cells, cleaned observations, results, logs and state.  Every write goes to a shared folder."""

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = "source string, sheet string, r bigint, c int, v string"
FORECAST_LOG = "refresh_id string, series_id string, as_of date, horizon int, target_ts date, point double, model string"


def with_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; only a local session without one gets its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    sc.setCheckpointDir(folder)


def landed(df: DataFrame) -> DataFrame:
    """Materialise once as Parquet in the shared folder, so parsers that read a table several times do not recompute it, filters
    and column pruning still reach the scan, and a lost executor costs a re-read.  The files go when the application ends."""
    spark = df.sparkSession
    with_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/landed-{uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_cells(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Landed cells.  A sheet delivered again replaces the earlier delivery whole, also where it has become smaller.

    A delivery is a file of the landing folder, or a folder in it with all its files.  The newest delivery of a (source, sheet)
    counts, of equally new ones the last by path.
    """
    reader = spark.read.schema(CELLS).option("pathGlobFilter", f"*.{fmt}").option("recursiveFileLookup", True)
    cells = reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath().rstrip("/")
    inside = F.regexp_replace(F.expr("parse_url(concat('file:', regexp_replace(_metadata.file_path, '^[a-z]+:/*', '/')), 'PATH')"), "^" + root, "")
    parts = F.split(F.regexp_replace(inside, "^/+", ""), "/")
    rows = cells.select("*", parts[0].alias("_delivery"), F.col("_metadata.file_modification_time").alias("_at"))
    # the time of a delivery is that of its newest file; one small row per delivery and sheet
    seen = rows.groupBy("source", "sheet", "_delivery").agg(F.max("_at").alias("_at"))
    newest = seen.groupBy("source", "sheet").agg(F.max(F.struct("_at", "_delivery"))["_delivery"].alias("_newest"))
    return rows.join(newest, ["source", "sheet"]).where("_delivery = _newest").select("source", "sheet", "r", "c", "v")


def table_exists(spark: SparkSession, path: str) -> bool:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def finished(spark: SparkSession, path: str) -> list[str]:
    """Refresh ids under ``path`` whose write was completed, oldest first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [(f.getModificationTime(), f.getPath().getName()) for f in fs.listStatus(folder) if f.isDirectory() and f.getPath().getName().startswith("refresh_id=")]
    done = [(t, n) for t, n in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return [n.removeprefix("refresh_id=") for _, n in sorted(done)]


def read_tier(spark: SparkSession, path: str) -> DataFrame:
    """The tier of the newest completed refresh, or an error that says what is missing."""
    done = finished(spark, path)
    if not done:
        raise FileNotFoundError(f"no data at {path}; has a refresh run yet?")
    return spark.read.parquet(f"{path}/refresh_id={done[-1]}")


def read_clean(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    """One sheet of the clean tier (a partition), or an error that says what is missing."""
    out = read_tier(spark, path).where(F.col("sheet") == sheet)
    if out.isEmpty():
        raise FileNotFoundError(f"no clean data for sheet {sheet!r}")
    return out


def write_tier(df: DataFrame, path: str, refresh_id: str, partition: str | None = "sheet", keep: int = 2) -> None:
    """A new version of a tier beside the ones before; readers turn to it once it is complete, so they never meet half of one.

    Rows of one sheet go to its partition.  Writing a refresh again replaces it.  The last ``keep`` complete versions stay.
    """
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(f"{path}/refresh_id={refresh_id}")
    spark = df.sparkSession
    for old in finished(spark, path)[:-keep]:
        gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/refresh_id={old}")
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)


def append_result(df: DataFrame, path: str, refresh_id: str) -> None:
    """Add a result under its refresh; earlier refreshes stay readable, and the same refresh written again replaces itself."""
    df.write.mode("overwrite").parquet(f"{path}/refresh_id={refresh_id}")


def latest_refresh(spark: SparkSession, path: str):
    """Newest refresh id of a result table as a one-row frame."""
    return spark.read.parquet(path).agg(F.max("refresh_id").alias("refresh_id"))


def read_result(spark: SparkSession, path: str) -> DataFrame:
    """The result of the newest refresh."""
    table = spark.read.option("recursiveFileLookup", False).parquet(path)
    return table.join(latest_refresh(spark, path), "refresh_id", "left_semi")


def append_json(df: DataFrame, path: str, refresh_id: str | None = None) -> None:
    """Add lines; under a refresh id they replace what that refresh wrote before."""
    if refresh_id is None:
        df.write.mode("append").json(path)
    else:
        df.write.mode("overwrite").json(f"{path}/refresh_id={refresh_id}")


def read_forecast_log(spark: SparkSession, path: str) -> DataFrame:
    if not table_exists(spark, path):
        return spark.createDataFrame([], FORECAST_LOG)
    return spark.read.schema(FORECAST_LOG).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def trained_through(spark: SparkSession, path: str):
    """Date of the newest training, None when there was none.  One value."""
    if not table_exists(spark, path):
        return None
    return spark.read.schema("trained_through date, refresh_id string").json(path).agg(F.max("trained_through")).first()[0]


def save_trained_through(spark: SparkSession, path: str, day, refresh_id: str) -> None:
    spark.createDataFrame([(day, refresh_id)], "trained_through date, refresh_id string").write.mode("append").json(path)


def as_json(df: DataFrame, *keys: str) -> DataFrame:
    """Result rows as one JSON text per row beside their keys."""
    rest = [c for c in df.columns if c not in keys]
    return df.select(*keys, F.to_json(F.struct(*rest)).alias("result"))
