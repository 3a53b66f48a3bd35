"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the plans rely on; everything else stays with the cluster's defaults.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # HotSpot never compiles methods above 8,000 bytes of bytecode. Wide row-local stages
    # exceed that as one method, and then run interpreted; below the limit Spark splits them.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Rows with whole images go to Python in batches of this size, not of 10,000 rows.
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
    # A detection takes some 400 bytes in memory and 20 in Parquet. Tasks of this size sort theirs,
    # to send only the best of an image, without spilling.
    "spark.sql.files.maxPartitionBytes": "16m",
    # Photos are many small files; at the default of 4 MB a file a task would open four of them.
    "spark.sql.files.openCostInBytes": "65536",
}
_TUNED = (
    "spark.sql.execution.arrow.maxBytesPerBatch",
    "spark.sql.files.maxPartitionBytes",
    "spark.sql.files.openCostInBytes",
)


def build_session(app: str = "burstlens", master: str | None = None, **conf) -> SparkSession:
    """Session with the library's settings; ``conf`` keys use ``_`` for ``.``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), str(value))
    return builder.getOrCreate()


def tune(spark: SparkSession) -> None:
    """Runtime settings that the row-local stages need, for sessions made elsewhere."""
    key = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(key) == "65535":  # Spark's default, so nobody chose it
        spark.conf.set(key, SETTINGS[key])
    chosen = spark._jsparkSession.sessionState().conf().getAllConfs()
    for key in _TUNED:
        if not chosen.contains(key):
            spark.conf.set(key, SETTINGS[key])


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Without it only a local master gets a private folder, as in tests; on a cluster executors
    could not read what others wrote there, so the setting is asked for.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    # A running session refuses to change spark.checkpoint.dir, so the context keeps the folder.
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="burstlens-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/burstlens/{name}-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point reliable checkpoints at the shared folder unless that is done already."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
