"""Session helpers: tables, shared scratch space and the Python workers' import path."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

_own_scratch: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` under `sf_dir`, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def reach_workers(spark: SparkSession) -> None:
    """Put this repository on the import path of Python workers started from now on.

    Where executors have no such path (a cluster without a shared install), ship the
    package with --py-files; the extra entry is then harmless.
    """
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join(p for p in [ROOT, *paths] if p)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local session may leave it unset; it then gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_scratch:
        _own_scratch[app] = tempfile.mkdtemp(prefix="glossa-")
        atexit.register(shutil.rmtree, _own_scratch[app], ignore_errors=True)
    return "file://" + _own_scratch[app]


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs no lineage.

    `cut` writes a frame and reads it back. `drop` removes tables by name once nothing
    reads them; tables that a returned lazy frame still reads must stay.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.at = f"{shared_dir(spark)}/glossa-{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.at}/{name}"

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def settle(self) -> None:
        """Let Spark remove the shuffle files of plans that nothing refers to any more."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: What may be broadcast at most, by a measure of the rows' values.
BROADCAST_BYTES = 64 << 20


def row_bytes(df: DataFrame) -> F.Column:
    """About how many bytes a row's values take."""
    total = F.lit(16)
    for field in df.schema.fields:
        c, kind = F.col(f"`{field.name}`"), field.dataType.typeName()
        if kind in ("string", "binary"):
            size = F.octet_length(c)
        elif kind == "array" and field.dataType.elementType.typeName() in ("byte", "short", "integer", "long", "float", "double", "boolean"):
            size = F.greatest(F.size(c), F.lit(0)) * 8
        elif kind in ("array", "struct", "map"):
            size = F.octet_length(F.to_json(F.struct(c)))
        else:
            size = F.lit(8)
        total = total + F.coalesce(size, F.lit(0))
    return total


def broadcast_if_small(df: DataFrame, most_rows: int, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """`df` marked for broadcast if it holds at most `most_rows` and `most_bytes`, else unchanged (a shuffle join)."""
    n, size = df.limit(most_rows + 1).agg(F.count("*"), F.coalesce(F.sum(row_bytes(df)), F.lit(0))).first()
    return F.broadcast(df) if n <= most_rows and size <= most_bytes else df


Query = Callable[[SparkSession, str], DataFrame]
