"""Session settings and the shared folder used for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", **conf: str) -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    builder = SparkSession.builder.master(master).appName("wattloom")
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings every operator relies on. Safe to call repeatedly."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a session on one machine without that setting (a test) gets a temporary
    folder, and the choice is kept in the session. On a cluster the setting is needed:
    executors do not see the driver's own folders.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="wattloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(hadoop_path)


def materialize(df: DataFrame, path: str | None = None, by: str | None = None) -> DataFrame:
    """Write ``df`` once and read it back, or reuse a finished earlier write.

    The written table cuts the lineage and survives the loss of executors.
    A table counts as finished only once its ``_SUCCESS`` marker is there.
    With ``by`` there is one folder per value of that column; rows are rebalanced
    first, which joins small pieces and splits the large ones.
    """
    spark = df.sparkSession
    if path is None:
        path = fresh_path(spark, "stage")
    if not path_exists(spark, f"{path}/_SUCCESS"):
        if by is None:
            df.write.mode("overwrite").parquet(path)
        else:
            df.hint("rebalance", by).write.mode("overwrite").partitionBy(by).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(df.columns)


_STAGES: dict[tuple[str, str, str], str] = {}


def stage(spark: SparkSession, source: str, name: str, build) -> DataFrame:
    """The table of a named stage over ``source``: written by its first user in the
    session, read by the later ones."""
    key = (spark.sparkContext.applicationId, source, name)
    if key not in _STAGES or not path_exists(spark, f"{_STAGES[key]}/_SUCCESS"):
        path = fresh_path(spark, name)
        materialize(build(), path)
        _STAGES[key] = path
    return spark.read.parquet(_STAGES[key])


def forget_stages() -> None:
    """Make the next users compute their stages again."""
    _STAGES.clear()
