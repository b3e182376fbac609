"""Sessions, and the one way this library cuts lineage: staged tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "plumbline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine expects; those given in ``conf`` win."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def stage_dir(spark: SparkSession) -> str:
    """The shared folder for staged tables: ``spark.checkpoint.dir`` of the session.

    Only where neither that setting nor a checkpoint folder is set (local tests) is a temporary one made.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="plumbline-"))
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return current.get()


_staged: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what was staged inside it; for work whose results are written elsewhere by then."""
    mark = len(_staged)
    try:
        yield
    finally:
        jvm = spark._jvm
        for folder in _staged[mark:]:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        del _staged[mark:]


def stage(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The plan starts anew at the files, so what was computed survives the loss of executors and is
    computed once however often it is read.  Unlike an RDD checkpoint the files are compressed columns.
    """
    spark = df.sparkSession
    path = f"{stage_dir(spark).rstrip('/')}/plumbline/{name}-{uuid.uuid4().hex}"
    _staged.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a few numbers up to which a table is sent to every task: some megabytes.
BROADCAST_ROWS = 100_000


#: Rows up to which a table that is expected to be tiny goes through the driver instead of a file.
DRIVER_ROWS = 2_000


def counted(df: DataFrame, name: str = "t", most: int = BROADCAST_ROWS, tiny: bool = False) -> DataFrame:
    """``df`` staged, and marked for broadcast if it was counted to have at most ``most`` rows.

    ``tiny`` tries the driver first: a table of at most :data:`DRIVER_ROWS` rows becomes part of the plan, without files.
    """
    if tiny:
        rows = df.limit(DRIVER_ROWS + 1).collect()
        if len(rows) <= DRIVER_ROWS:
            return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
    small = stage(df, name)
    return F.broadcast(small) if small.limit(most + 1).count() <= most else small


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if its files give fewer tasks than there are cores, else as it is.

    For work in Python on a small table in one row group; a large table has more splits than cores and
    is never shuffled by this.  Plans that shuffle already are left alone.
    """
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "Exchange" in plan or "AdaptiveSparkPlan" in plan:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
