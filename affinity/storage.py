"""What driver and executors share: tables in the folder for it, and this package."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from affinity.errors import StorageError

#: While a table is written: its shuffle files go with the query that made them, and
#: batches for Python are small, since texts make rows long.
_WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the one that driver and executors share.

    The session's ``spark.checkpoint.dir`` decides.  Where it is unset, a temporary
    folder stands in for it on one machine, and a cluster is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise StorageError("spark.checkpoint.dir must name a folder that driver and executors share.")
        base = "file://" + tempfile.mkdtemp(prefix="affinity-")
    return f"{base.rstrip('/')}/affinity-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """The rows of ``df`` as a table in the shared folder, reread.

    This cuts the lineage: later jobs, and tasks that run again after a lost
    executor, read the files instead of computing the rows anew.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    before = {k: spark.conf.get(k, None) for k in _WHILE_WRITING}
    try:
        for k, v in _WHILE_WRITING.items():
            spark.conf.set(k, v)
        df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def bucketed(df: DataFrame, key: str, buckets: int) -> Iterator[DataFrame]:
    """``df`` as a table in ``buckets`` buckets by ``key`` in the shared folder, gone at the end.

    Grouped with rows that are repartitioned by the same key and number, it is
    not shuffled, however often that is done.
    """
    spark, name = df.sparkSession, f"affinity_{uuid.uuid4().hex}"
    before = spark.conf.get("spark.sql.sources.bucketing.maxBuckets")
    try:
        spark.conf.set("spark.sql.sources.bucketing.maxBuckets", str(max(int(before), buckets)))
        df.write.bucketBy(buckets, key).sortBy(key).option("path", f"{shared_dir(spark)}/{name}").option("compression", "zstd").saveAsTable(name)
        table = spark.table(name)
        yield table
        forget(table)
    finally:
        spark.conf.set("spark.sql.sources.bucketing.maxBuckets", before)
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def forget(df: DataFrame) -> None:
    """Delete a table made by :func:`written` once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once for each application: their Python may not find it otherwise."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    home = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="affinity-")) / "affinity-package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f.relative_to(home.parent))
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)
