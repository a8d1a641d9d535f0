"""Session settings and lineage cutting."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", app: str = "canonframe",
                  shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
    )
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own: on a
    cluster a machine-local folder would be lost with its executor.
    """
    global _local_folder
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running iterative jobs")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="canonframe-")
        atexit.register(shutil.rmtree, _local_folder, ignore_errors=True)
    return _local_folder


_local_folder: str | None = None


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    It survives lost executors, is computed once (``checkpoint()`` computes its
    input twice unless it is cached too) and gives the planner real sizes.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/canonframe-{spark.sparkContext.applicationId}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_bucketed(df: DataFrame, *keys: str, dealt: bool = False) -> DataFrame:
    """Like ``cut_lineage``, stored by the keys in as many buckets as the session shuffles into.

    Joins and groupings on the keys read the buckets as they are: what is stored
    so is never exchanged again.  ``dealt``: the rows lie by the keys in that many
    partitions already.  The catalogue entry that bucketing needs is
    dropped at once; the files stay, and the returned table reads them.
    """
    spark = df.sparkSession
    ident, n = uuid.uuid4().hex, int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_folder(spark)}/canonframe-{spark.sparkContext.applicationId}/b-{ident}"
    name = f"canonframe_{ident}"
    (df if dealt else df.repartition(n, *keys)).write.bucketBy(n, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    stored = spark.table(name).select("*")
    spark.sql(f"DROP TABLE {name}")
    return stored


def spread(df: DataFrame) -> DataFrame:
    """Share a scan with fewer splits than cores (a file of one row group) among all cores.

    For work that is bound by the processor, such as tokenising.  A scan that
    already has enough splits is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
