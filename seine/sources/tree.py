"""Source trees as tables, and generations of stored tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seine.functions import text as X
from seine.operators.retrieve import glob_regex

MOST_BYTES = 2 << 20


def scan(spark: SparkSession, root: str, ignore: list[str] | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(file_path, content, size, mtime) of the indexable files below a folder of any Hadoop file system.

    Hidden files, excluded folders, files that match an ignore glob and files above
    `most_bytes` are left out before their content is decoded.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^[a-z]+:/*", "/")
    full = F.regexp_replace("path", "^[a-z]+:/*", "/")
    path = F.expr("substring(full, length(base) + 2)")
    named = found.where(F.col("length") <= most_bytes).withColumn("full", full).withColumn("base", base).withColumn("file_path", path)
    kept = named.where(X.indexable(F.col("file_path")) & ~F.exists(F.split("file_path", "/"), lambda p: p.startswith(".")))
    for glob in ignore or ():
        rule = glob_regex(glob.rstrip("/") + ("/**" if glob.endswith("/") else ""))
        kept = kept.where(~(F.col("file_path").rlike(rule) | X.basename(F.col("file_path")).rlike(rule)))
    return kept.select("file_path", F.decode("content", "UTF-8").alias("content"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


class Generations:
    """Tables in numbered generations below one folder; a pointer file names the active one.

    A new generation is written beside the active one and then switched to by renaming the
    pointer, so readers keep a whole snapshot and a failed writer leaves nothing visible.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def active(self) -> int | None:
        at = self._path(f"{self.folder}/active")
        if not self._fs.exists(at):
            return None
        row = self.spark.read.text(f"{self.folder}/active").first()
        return json.loads(row[0])["generation"]

    def publish(self, tables: dict[str, DataFrame]) -> int:
        number = (self.active() or 0) + 1
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.folder}/gen={number}/{name}")
        new = self._path(f"{self.folder}/active-{uuid.uuid4().hex}")
        out = self._fs.create(new)
        out.write(bytearray(json.dumps({"generation": number, "tables": sorted(tables)}).encode()))
        out.close()
        at = self._path(f"{self.folder}/active")
        self._fs.delete(at, False)
        self._fs.rename(new, at)
        return number

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/gen={self.active()}/{name}")

    def prune(self, keep: int = 2) -> None:
        now = self.active() or 0
        for n in range(1, now - keep + 1):
            self._fs.delete(self._path(f"{self.folder}/gen={n}"), True)
