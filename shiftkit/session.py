"""Session construction, table loading and the checkpoint location."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every job in this library relies on. AQE re-plans joins from runtime sizes (so a join
# side that turns out small is broadcast only after its size is measured) and splits skewed
# shuffle partitions; the UTC zone keeps timestamps comparable with the SQL oracle.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # checkpoint files of tables no longer referenced are removed by the context cleaner
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Arrow batches to Python workers are cut by bytes too, so block-pair rows stay bounded.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20),
}


def build_session(master: str | None = None, app: str = "shiftkit", conf: dict | None = None) -> SparkSession:
    """Get or create a session with the library's base settings.

    ``master`` is only set when given (tests and the bench pass ``local[N]``); on a cluster the
    launcher decides.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**BASE_CONF, **(conf or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder must be configured (a shared file system); a machine-local folder would
    be lost with its executor. Only a local-mode session without the setting (tests, the bench) gets
    a fresh scratch folder.
    """
    sc = spark.sparkContext
    configured = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder")
    path = tempfile.mkdtemp(prefix="shiftkit-ckpt-")
    sc.setCheckpointDir(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage by a reliable checkpoint in the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage by a Parquet table in the shared checkpoint folder; for the small state of a loop.

    A checkpoint keeps the size estimate of the plan it replaces, and a join multiplies its sides'
    estimates, so in a loop of joins the estimates grow beyond all bounds; a table's size is that of its files.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of an Arrow batch of texts. A task's JVM and Python worker hold several copies of a batch at a time, and Spark's
#: own limits (10,000 rows, 64 MB) let a batch of documents take 30 MB and more a copy.
TEXT_BATCH = 4 << 20


def _size(value: str) -> int:
    """Bytes of a size as Spark writes it: ``67108864b``, ``32m``."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([kmgtp]?)b?\s*", value.lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def cut_batches(spark: SparkSession, most: int | None = None) -> str:
    """From now on the session's Arrow batches end at ``most`` bytes (TEXT_BATCH), if its limit is not lower already; returns the limit before."""
    before, most = spark.conf.get(BATCH_CONF), most or TEXT_BATCH
    if _size(before) > most:
        spark.conf.set(BATCH_CONF, str(most))
    return before


@contextmanager
def small_batches(spark: SparkSession, most: int | None = None) -> Iterator[None]:
    """:func:`cut_batches` for the jobs that run inside; the limit before holds again afterwards."""
    before = cut_batches(spark, most)
    try:
        yield
    finally:
        spark.conf.set(BATCH_CONF, before)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the driver's parquet tables (``<sf_dir>/<name>.parquet``)."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def ship_package(spark: SparkSession) -> None:
    """Let task functions of this library travel inside the plan.

    Operators that run pandas code in tasks reference library functions; they are pickled by value, so no
    file has to reach the workers and no installed copy is needed there.
    """
    import shiftkit
    from pyspark.cloudpickle import register_pickle_by_value

    register_pickle_by_value(shiftkit)
