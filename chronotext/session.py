"""Session settings and the few helpers every operator shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DataType

BROADCAST_BYTES = 64 * 1024 * 1024


def build_session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution on; the cluster's own settings win elsewhere."""
    builder = (
        SparkSession.builder.appName("chronotext")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of this application, below the one in ``spark.checkpoint.dir``.

    A temporary folder is used only in local mode, where driver and executors share one machine.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="chronotext-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it from there.

    The written rows do not change when an executor is lost, later steps read only the columns
    they need, and the size of the table is known to the planner.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether all rows of ``df`` together are small enough to copy to every executor.

    Runs one aggregate over ``df``, so give it a materialised frame.
    """
    size = sum((F.coalesce(_bytes(F.col(f"`{field.name}`"), field.dataType), F.lit(0)) for field in df.schema.fields), F.lit(32))
    total = df.agg(F.sum(size.cast("long")).alias("bytes")).first()["bytes"]
    return (total or 0) <= limit


def _bytes(value: Column, kind: DataType) -> Column:
    """What a value takes: the bytes of texts and binaries, and those of everything inside maps, structs and arrays."""
    name = kind.typeName()
    if name in ("string", "binary"):
        return F.octet_length(value)
    if name == "array":
        return _total(value, kind.elementType)
    if name == "map":
        return _total(F.map_keys(value), kind.keyType) + _total(F.map_values(value), kind.valueType)
    if name == "struct":
        return sum((F.coalesce(_bytes(value[field.name], field.dataType), F.lit(0)) for field in kind.fields), F.lit(8))
    return F.lit(16 if name == "decimal" else 8)


def _total(values: Column, kind: DataType) -> Column:
    if kind.typeName() in ("array", "map", "struct", "string", "binary"):
        each = lambda total, value: total + F.coalesce(_bytes(value, kind), F.lit(0)).cast("long")
        return F.aggregate(values, F.lit(16).cast("long"), each)
    return F.size(values) * F.lit(16 if kind.typeName() == "decimal" else 8) + 16


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores when the input has fewer splits than cores; otherwise leave it as it is.

    Only small inputs are ever shuffled here: a large scan has more splits than there are cores.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
