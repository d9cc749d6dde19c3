"""Session defaults and size checks shared by the operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A side is broadcast only when a probe proves it within this many rows and bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def build_session(app: str = "scriptorium", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution on; settings given by the cluster win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether the table holds at most so many rows and bytes; the probe takes no more than ``max_rows + 1`` rows."""
    width = F.lit(0).cast("long")
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            width = width + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.NumericType):
            width = width + 8 * F.greatest(F.size(c), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            width = width + F.octet_length(F.to_json(F.struct(c)))
        else:
            width = width + 8
    n, size = df.select(width.alias("w")).limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum("w")).first()
    return n <= max_rows and (size or 0) <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only if ``fits`` proves the table small; else the planner joins by shuffle."""
    return F.broadcast(df) if fits(df, max_rows) else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; a cluster without it is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Compute the table now and cut its lineage, as loops need.

    The result goes to the shared folder, so a lost executor costs a read and not a recomputation.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def reuse(df: DataFrame) -> DataFrame:
    """Cut the lineage of a costly result that feeds several branches."""
    return cut(df)


def compute_partitions(spark: SparkSession) -> int:
    """Partitions for work whose cost is computation, not bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Hash or round-robin the rows over all cores.

    The count is given explicitly, because adaptive execution would otherwise merge partitions
    that are small in bytes yet expensive to score.
    """
    return df.repartition(compute_partitions(df.sparkSession), *cols)


def spread_if_few(df: DataFrame) -> DataFrame:
    """Spread a table whose files yield fewer splits than there are cores; a large one stays as read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
