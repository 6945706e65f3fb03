"""Tables written between jobs, in the folder that all executors share.

``spark.checkpoint.dir`` names that folder on a cluster; without it a cluster is refused.
Where it is unset on one machine (tests) a temporary folder of this process is used.
A written table, unlike a cached one, survives the loss of any executor. What a result
still reads stays until the application ends, and is then removed.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``, else, on one machine, one of our own."""
    configured = spark.conf.get("spark.checkpoint.dir", "")
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="quillfold-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return "file://" + _LOCAL[0]


class Scratch:
    """Parquet tables of one operator run; ``drop`` frees those no later step reads."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
        self.n = 0
        system, path = self._at(self.root)
        system.mkdirs(path)
        system.deleteOnExit(path)

    def write(self, df: DataFrame, by: str | None = None) -> tuple[DataFrame, str]:
        self.n += 1
        path = f"{self.root}/t{self.n}"
        writer = df.write.option("compression", "zstd")
        if by:
            writer = writer.partitionBy(by)
        writer.parquet(path)
        reader = self.spark.read
        if by:
            schema = df.select(*[c for c in df.columns if c != by], by).schema
            reader = reader.schema(schema)
        else:
            reader = reader.schema(df.schema)
        return reader.parquet(path), path

    def table(self, df: DataFrame, by: str | None = None) -> DataFrame:
        return self.write(df, by)[0]

    def bucketed(self, df: DataFrame, by: str, buckets: int) -> DataFrame:
        """Written in buckets of a column, so that joins on it do not shuffle this side again."""
        self.n += 1
        name = f"quillfold_{uuid.uuid4().hex}"
        writer = df.repartition(buckets, by).write.option("compression", "zstd").bucketBy(buckets, by).sortBy(by)
        writer.option("path", f"{self.root}/t{self.n}").saveAsTable(name)
        out = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")  # the name alone: the files stay, and out knows its buckets
        return out

    def drop(self, path: str) -> None:
        system, p = self._at(path)
        system.delete(p, True)

    def _at(self, path: str):
        """(file system, path) of the JVM."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: A side this small (rows x bytes, counted before the join) is broadcast, a larger one is shuffled.
BROADCAST_BYTES = 48 << 20
