"""Sinks and run bookkeeping.

Intermediate tables are written as parquet under the shared folder named by
``spark.checkpoint.dir``: this cuts lineage (a lost executor re-reads the
table instead of replaying the joins) and gives downstream scans column
pruning and statistics for AQE.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlens.session import ensure_checkpoint_dir


_written: list[tuple[str, str]] = []  # (application, path) of intermediate tables and files, for release_all


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, Path) of a file or folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def scratch(spark: SparkSession, folder: str, name: str = "") -> str:
    """A new path in a folder of the shared checkpoint folder; ``release_all`` deletes what was written there."""
    path = os.path.join(ensure_checkpoint_dir(spark), folder, f"{name}-{uuid.uuid4().hex}" if name else uuid.uuid4().hex)
    _written.append((spark.sparkContext.applicationId, path))
    return path


def read_if_present(spark: SparkSession, path: str) -> DataFrame | None:
    """The parquet table at ``path``, or None when nothing has been written there."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return None
        raise


def path_exists(spark: SparkSession, path: str) -> bool:
    return read_if_present(spark, path) is not None


def materialize(df: DataFrame, name: str, path: str | None = None,
                partition_by: Sequence[str] = ()) -> DataFrame:
    """S3: write ``df`` as parquet (overwrite) and return a DataFrame reading it.

    Without ``path`` a fresh folder under the checkpoint dir is used.
    """
    spark = df.sparkSession
    if path is None:
        path = scratch(spark, "tables", name)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return spark.read.parquet(path)


def release(table: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` wrote to the checkpoint folder.

    The caller owns the table and releases it after its last use; tables
    elsewhere are refused."""
    spark = table.sparkSession
    fs, base = file_system(spark, os.path.join(ensure_checkpoint_dir(spark), "tables"))
    root = fs.makeQualified(base).toString() + "/"
    folders = {os.path.dirname(f) for f in table.inputFiles()}
    for folder in folders:
        path = fs.makeQualified(spark._jvm.org.apache.hadoop.fs.Path(folder))
        if not path.toString().startswith(root):
            raise ValueError(f"{path.toString()} is no intermediate table")
        fs.delete(path, True)


def release_all(spark: SparkSession) -> int:
    """Delete every intermediate table and file that this application has written to the checkpoint folder so far; how
    many there were.

    For callers that have finished with all results of earlier queries, such as a job that runs one query
    after the other: DataFrames that read those tables are void afterwards."""
    own = spark.sparkContext.applicationId
    mine = [path for app, path in _written if app == own]
    _written[:] = [x for x in _written if x[0] != own]
    return sum(bool(fs.delete(p, True)) for fs, p in (file_system(spark, path) for path in mine))


def load_or_build(spark: SparkSession, path: str, builder: Callable[[], DataFrame]) -> DataFrame:
    """Read the parquet table at ``path`` if present, else build, write, read."""
    found = read_if_present(spark, path)
    if found is not None:
        return found
    return materialize(builder(), os.path.basename(path), path)


def write_sequences(table: DataFrame, names: DataFrame, path: str) -> None:
    """Model table (subject, step, feature) and its feature catalogue."""
    table.write.mode("overwrite").parquet(os.path.join(path, "sequences"))
    names.write.mode("overwrite").parquet(os.path.join(path, "feature_names"))


def write_matrix(matrix: DataFrame, names: DataFrame, path: str) -> None:
    """The sparse matrices of ``features.sequence_matrix`` and their feature catalogue."""
    matrix.write.mode("overwrite").parquet(os.path.join(path, "matrix"))
    names.write.mode("overwrite").parquet(os.path.join(path, "feature_names"))


def write_clustered(table: DataFrame, path: str, key: str = "subject_id", order: Sequence[str] = ("step",),
                    files: int | None = None, split_keys: bool = False) -> DataFrame:
    """Rows in files of disjoint key ranges, sorted by (key, order) inside; returns the list of files.

    The list (file, low, high, n_rows), kept beside the data, lets ``read_clustered`` open only the files that may
    hold a key.  With ``split_keys`` the ranges run over (key, order), so that a key with a large share of all rows
    fills several neighbouring files and only their border keys are shared."""
    spark = table.sparkSession
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(key).asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in order)]
    dealt = table.repartitionByRange(n, *(by if split_keys else by[:1]))
    dealt.sortWithinPartitions(*by).write.mode("overwrite").parquet(os.path.join(path, "rows"))
    rows = spark.read.parquet(os.path.join(path, "rows"))
    ranges = rows.groupBy(F.col("_metadata.file_name").alias("file")).agg(
        F.min(key).alias("low"), F.max(key).alias("high"), F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(key).isNull()).alias("n_null"))
    ranges.coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "files"))
    return spark.read.parquet(os.path.join(path, "files"))


def read_clustered(spark: SparkSession, path: str, low, high, key: str = "subject_id") -> DataFrame:
    """The rows with ``low <= key <= high`` of a table written by ``write_clustered``; other files are not opened."""
    files = spark.read.parquet(os.path.join(path, "files")).filter((F.col("high") >= low) & (F.col("low") <= high))
    named = [os.path.join(path, "rows", r["file"]) for r in files.select("file").collect()]  # file names only
    schema = spark.read.parquet(os.path.join(path, "rows")).schema
    rows = spark.read.schema(schema).parquet(*named) if named else spark.createDataFrame([], schema)
    return rows.filter(F.col(key).between(low, high))


def write_membership(membership: DataFrame, path: str) -> None:
    """Cluster membership keyed by subject_id."""
    membership.write.mode("overwrite").parquet(path)


RUN_COLUMNS = ["run_id", "params", "model", "scope", "metric", "value"]


def append_results(results: DataFrame, path: str) -> None:
    """Append (run_id, params, model, scope, metric, value) rows to the run log."""
    results.write.mode("append").parquet(path)


def run_key(run_id: Column, params: Column, model: Column) -> Column:
    """Digest of a run's identity: the folder of its rows in the log."""
    return F.sha2(F.to_json(F.struct(run_id.alias("r"), params.alias("p"), model.alias("m"))), 256)


def log_results(results: DataFrame, path: str) -> None:
    """Write each run's rows to the run log once.

    Rows go to a folder named by the digest of their run, which the write replaces as a whole (dynamic partition
    overwrite).  A run that is written again, be it a retry after a lost driver or a second job of the same
    configuration, leaves one set of rows; runs of other configurations, also those written at the same time, are
    left alone.  A log is written by this function or by ``append_results``, not by both."""
    keyed = results.withColumn("run_key", run_key(F.col("run_id"), F.col("params"), F.col("model")))
    keyed.write.partitionBy("run_key").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame | None:
    """The run log's rows, or None when nothing has been written there."""
    found = read_if_present(spark, path)
    return None if found is None else found.select(*RUN_COLUMNS)


def pending_runs(configs: DataFrame, log: DataFrame, params: Sequence[str]) -> DataFrame:
    """Configurations not yet present in the run log (anti join on the parameters)."""
    done = log.select(*params).distinct()
    return configs.join(done, list(params), "left_anti")


def params_json(params: dict):
    """Run parameters as a JSON object string (insertion order kept), so the
    run log stays plain text in any engine."""
    return F.to_json(F.create_map(*[x for k, v in params.items() for x in (F.lit(k), F.lit(str(v)))]))


def results_frame(spark: SparkSession, run_id: str, params: dict, model: str, scores: DataFrame,
                  scope_col: str = "scope", metric_cols: Sequence[str] = ("auc",)) -> DataFrame:
    """Shape metric rows as run-log rows: params as JSON text, one row per metric."""
    stacked = scores.select(F.col(scope_col).cast("string").alias("scope"),
                            F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                                                for m in metric_cols])).alias("m"))
    return stacked.select(F.lit(run_id).alias("run_id"), params_json(params).alias("params"),
                          F.lit(model).alias("model"), "scope", "m.metric", "m.value")
