"""Intermediate tables in the folder that all machines of a cluster share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_PATHS: dict[int, tuple[DataFrame, str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; only where that is unset on a local master (as in tests) a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = _OWN.setdefault("folder", tempfile.mkdtemp(prefix="tempoweave-"))
    return folder.rstrip("/")


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a folder of tables."""
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001 - the session has ended; the folder's owner clears it
        return


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once as Parquet in the shared folder, so that a lost executor costs no recomputation.

    The table goes when the program ends, or when it is given to `forget`.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(drop, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = (out, path)
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more; others are left alone."""
    for table in tables:
        held = _PATHS.pop(id(table), None)
        if held:
            drop(table.sparkSession, held[1])


def least_hashed(rows: DataFrame, key: str, most: int) -> DataFrame:
    """The `most` rows with the least hash of their key, null keys last.

    Where there are many more, rows far above the expected hash of the last one
    are left out before they are ordered, so no task sends on `most` rows of its
    own; if that leaves too few (many rows of one key), all are ordered.
    """
    hashed = F.xxhash64(key)
    n, nulls = rows.select(F.count(F.lit(1)), F.count_if(F.col(key).isNull())).first()
    share = 4 * (most + 100) / max(n - nulls, 1)
    if share < 1:
        near = rows.filter(F.col(key).isNotNull() & (hashed <= F.lit(int(-(1 << 63) + share * ((1 << 64) - 1)))))
        if near.select(key).limit(most).count() == most:
            rows = near
    return rows.orderBy(F.col(key).isNull(), hashed, key).limit(most)
