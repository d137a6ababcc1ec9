"""Reading tables and keeping working tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a temporary folder on a single machine, as in tests. On a cluster it has to be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[[^\]]*\])?$", spark.conf.get("spark.master", "local")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lemmata-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again, which cuts its lineage."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """A table that grows by whole directories, ``part=0``, ``part=1`` and so on: what is there is never written again."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.n, self.schema = spark, new_path(spark, name), 0, None

    def add(self, df: DataFrame) -> DataFrame:
        """Write ``df`` as the next directory; what was written."""
        self.schema = self.schema or df.schema
        df.write.parquet(f"{self.path}/part={self.n}")
        self.n += 1
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/part={self.n - 1}")

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/part={k}" for k in range(self.n)))


def read_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Tab-separated text without header, all columns strings: (s, p, o) facts or (s, p, o, truth) claims."""
    return spark.read.csv(path, sep="\t", header=False, schema=", ".join(f"`{c}` string" for c in columns))


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.csv(path, sep="\t", header=False)
