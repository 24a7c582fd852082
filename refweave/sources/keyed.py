"""Tables that are written by key: whole rows, single columns, or anew.

A table is a folder of versions. A write makes the next version beside the last
and readers take the highest one that is complete, so that a write that is cut
short changes nothing. There is no update in place: a changed row is a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class KeyedTable:
    """Rows with a unique, non-null key in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path, key

    def _versions(self) -> list[int]:
        hadoop = self.spark._jvm.org.apache.hadoop.fs  # noqa: SLF001
        where = hadoop.Path(self.path)
        files = where.getFileSystem(self.spark._jsc.hadoopConfiguration())  # noqa: SLF001
        if not files.exists(where):
            return []
        names = [s.getPath().getName() for s in files.listStatus(where)]
        done = [n for n in names if n.startswith("version=") and files.exists(hadoop.Path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(int(n.partition("=")[2]) for n in done)

    def _write(self, rows: DataFrame) -> DataFrame:
        number = (self._versions() or [0])[-1] + 1
        rows.write.mode("overwrite").parquet(f"{self.path}/version={number}")
        return self.read()

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/version={self._versions()[-1]}")

    def create(self, rows: DataFrame) -> DataFrame:
        """The first version; an error where there is one. Rows without a key are left out."""
        if self._versions():
            raise FileExistsError(self.path)
        return self._write(rows.where(F.col(self.key).isNotNull()))

    def overwrite(self, rows: DataFrame, order: list[Column]) -> DataFrame:
        """Whole rows by key: the last in ``order`` of each key stands in the place of what was there."""
        last = rows.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("_row")).select("_row.*")
        old = self.read()
        return self._write(old.join(last.select(self.key), self.key, "left_anti").select(*old.columns).unionByName(last))

    def update(self, changes: DataFrame) -> DataFrame:
        """Single columns by key, one row a key: nulls overwrite too; keys that aren't there change nothing."""
        old = self.read()
        fields = [c for c in changes.columns if c != self.key]
        new = changes.select(self.key, F.struct(*fields).alias("_new"))
        joined = old.join(new, self.key, "left")
        return self._write(joined.select(*[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in old.columns]))


def write_samples(samples: DataFrame, folder: str, name: str) -> None:
    """One training file: lines of comma-separated values."""
    samples.write.mode("overwrite").csv(f"{folder}/{name}")


def read_samples(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All training files of a folder, one after another."""
    return spark.read.schema(schema).csv(f"{folder}/*")
