"""Session settings and the shared folder for cut lineage.

A cluster names its shared folder in ``spark.checkpoint.dir``; that setting is read from the session.
Only where it is unset and the master is local (single-machine tests) a folder under the system's temporary
folder is used; on a cluster a missing setting is an error, as other machines could not read such a folder.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders of the tables written by ``stored``.
_STORED: list[str] = []


def make_session(app: str = "quillstone", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; ``conf`` overrides them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the session's own setting, or a local one where it is unset on a single machine."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if not named and not (sc.master or "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    path = named
    if not path:
        folder = tempfile.mkdtemp(prefix="quillstone-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = f"file://{folder}"
    sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage of ``df`` by a reliable checkpoint, which outlives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage is cut and the planner knows its size.

    The table stands under the session's own checkpoint folder and goes with it, by ``drop_stored`` at the latest.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STORED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession) -> int:
    """Delete the tables that ``stored`` has written in this process; data frames read from them cannot be used again."""
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    dropped = 0
    while _STORED:
        path = jvm.org.apache.hadoop.fs.Path(_STORED.pop())
        dropped += bool(path.getFileSystem(hadoop).delete(path, True))
    return dropped


def in_parallel(scan: DataFrame, key: str) -> DataFrame:
    """A scan with fewer partitions than there are cores, spread over all of them by ``key``; any other stays as it is.

    A file of a few megabytes is one partition, and a plan without a shuffle would use one core for it. Large
    inputs have more partitions than cores: nothing is shuffled there. ``scan`` should be a plain read.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan._jdf.queryExecution().toRdd().getNumPartitions() >= cores else scan.repartition(cores, key)


#: Fuzzy comparisons in one task: some milliseconds each.
PAIRS_A_TASK = 2000


def balanced(pairs: DataFrame, n: int, *keys: str) -> DataFrame:
    """``n`` pairs that are compared in Python, spread by ``keys``: the planner sizes tasks by bytes, and would give a few
    megabytes of pairs, each worth milliseconds, to one core."""
    cores = pairs.sparkSession.sparkContext.defaultParallelism
    return pairs.repartition(max(cores, -(-n // PAIRS_A_TASK)), *keys)
