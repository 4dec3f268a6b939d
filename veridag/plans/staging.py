"""Tables in the cluster's shared folder, which end a lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a local session without that setting, as in tests, gets one of its
    own; on a cluster a machine's own folder would not do."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        folder = _local.setdefault(app, "") or "file://" + tempfile.mkdtemp(prefix="veridag-")
        _local[app] = folder
    return folder.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def parted(df: DataFrame, column: str) -> DataFrame:
    """staged(), in a folder for each value of a column: filters on it read only theirs."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    df.write.partitionBy(column).option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def bucketed(df: DataFrame, column: str, once: bool = False) -> DataFrame:
    """staged(), in as many buckets by a column as shuffles have partitions: a join on it moves the other side alone. With
    `once`, rows that are equal are kept once, where they meet in their bucket."""
    spark = df.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"veridag_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/staged-{name}"
    df = df.repartition(n, column)
    (df.distinct() if once else df).write.bucketBy(n, column).sortBy(column).option("compression", "zstd").option("path", path).saveAsTable(name)
    out = spark.table(name)
    out._staged_at, out._table = path, name
    return out


def dropped(*frames: DataFrame) -> None:
    """Delete tables made by staged(), parted() or bucketed() that no later step reads."""
    for df in frames:
        spark = df.sparkSession
        if hasattr(df, "_table"):
            spark.sql(f"drop table if exists {df._table}")
        path = spark._jvm.org.apache.hadoop.fs.Path(df._staged_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """files, newest modification and bytes of what lies at path, without reading any of it: unchanged means that nothing needs rebuilding."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "modificationTime", "length")
    return files.agg(F.count("*").alias("files"), F.max("modificationTime").alias("newest"), F.sum("length").alias("bytes"))


def forgotten(owner: object) -> None:
    """Delete every stored table that owner keeps, in its own columns, among its shared tables, and in what it is made of."""
    held = list(owner.__dict__.values()) + list(owner.__dict__.get("_shared", {}).values())
    held += [y for x in held if isinstance(x, tuple) for y in x]
    for x in held:
        if isinstance(x, DataFrame):
            if hasattr(x, "_staged_at"):
                dropped(x)
        elif "_shared" in getattr(x, "__dict__", {}):
            forgotten(x)


def shared(owner: object, name: str, make: Callable[[], DataFrame], keep: Callable[[DataFrame], DataFrame] = staged) -> DataFrame:
    """A table that several operators of one library walk or read: written once, by keep."""
    kept = owner.__dict__.setdefault("_shared", {})
    if name not in kept:
        kept[name] = keep(make())
    return kept[name]
